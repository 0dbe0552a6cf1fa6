"""Best-fit packing of tokenised documents into sequences (op8).

Documents become pieces of at most ``capacity`` tokens (a document that fits is
one piece; of a longer one only the first piece may be shorter).  Only the
histogram of piece lengths matters for the packing, and it has at most
``capacity`` rows whatever the input.  On it, the configuration linear program
(how often to use each filling of a sequence) is solved by multiplicative
weights: every length has a price, an unbounded knapsack by dynamic programming
finds the filling of highest price, the filling is used, and the prices of the
lengths it serves fall.  The fractional solution is rounded down, the rest is
solved once more and then packed by best fit decreasing, all on counts.

Pieces get a rank within their length from distributed counts, and the plan (a
table of rank intervals, bounded by the number of fillings) turns length and
rank into sequence and offset.  No piece passes through the driver.

Null text is empty; an empty text is one piece that holds the end token.  Rows
are packed one by one, so repeated rows and ids are all packed.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowbook.llm.store import columns, lean, shuffle_parts, stored

_UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space by any definition other than space and line feed.
_ODD = [chr(c) for c in (9, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
#: White space that is no single sign between two words.
_UNEVEN = ["  ", " \n", "\n ", "\n\n\n"]
#: Units in a generation of a worker's cache; two of them take some 40 MB.
_CACHE = 100_000
#: Fixed value: the split pattern of the byte-level tokenizer.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level BPE by bytes, if ids rise with the merges."""
    with open(path) as f:
        model = json.load(f)
    if model["model"].get("type") != "BPE" or (model.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or model.get("normalizer"):
        return None
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    place = {chr(b): b for b in plain}
    place |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in model.get("added_tokens", [])}
    vocab = model["model"]["vocab"]
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["model"]["merges"]]
    if merged != sorted(merged):
        return None
    return {bytes(place[c] for c in t): i for t, i in vocab.items() if t not in special}


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, equal to those of the
    library ``tokenizers`` with the file at ``path``.

    A byte-level BPE splits a text before each run of white space that follows
    something else, whatever stands around it.  So a text is the concatenation of
    its units (white space and the run after it); units repeat, and their ids are
    kept in two generations of a bounded cache.  New units are encoded with the
    same vocabulary by ``tiktoken``, which is quicker on short strings.  A text
    with white space other than spaces and line feeds, and any text under a
    tokenizer of another kind, is encoded whole by ``tokenizers``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        ranks = _byte_ranks(path)
        self.units = None
        if ranks is not None:
            import tiktoken

            self.units = _Units(tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.units is None or any(c in text for c in _ODD):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if any(c in text for c in _UNEVEN):
            return b"".join([self.units["\0" + u] for u in _UNIT.findall(text)])
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.units["\0" + first] + b"".join(map(self.units.__getitem__, rest))


class _Units(dict):
    """Ids of a unit: as it stands after a zero sign or before a line feed, else with a space in front."""

    def __init__(self, encoding):
        super().__init__()
        self.one, self.old = encoding.encode_ordinary, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            ids = np.array(self.one(unit[1:] if unit[:1] == "\0" else unit if unit[:1] == "\n" else " " + unit), "<u4").tobytes()
        if len(unit) <= 40:
            if len(self) >= _CACHE:
                self.old = dict(self)
                self.clear()
            self[unit] = ids
        return ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker, so that its cache outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
           text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row a piece: the id, ``piece``, ``start``, ``length``, ``ids_crc32`` and, with ``keep_ids``, ``ids``."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    all_ids = encode(text) + end
                    for k, (s, n) in enumerate(cut(len(all_ids) // 4, capacity)):
                        own = all_ids[4 * s:4 * (s + n)]
                        row.append(i), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(own))
                        if keep_ids:
                            ids.append(np.frombuffer(own, "<u4").astype(np.int64))
                cols = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.list_(pa.int64()))] if keep_ids else []),
                                                 names=[id_col, "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(lean(run), schema)


Filling = tuple[tuple[int, int], ...]  # (length, times) of a sequence


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> Filling:
    """The filling of highest price within the capacity; a length may repeat."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    lengths, prices = lengths[::-1], prices[::-1]  # of equal fillings, one with the longest piece
    fits = np.searchsorted(-lengths, -np.arange(capacity + 1), side="left")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if (k := fits[c]) < len(lengths):
            worth = best[c - lengths[k:]] + prices[k:]
            j = int(worth.argmax())
            if worth[j] > best[c]:
                best[c], take[c] = worth[j], k + j
    times: dict[int, int] = {}
    c = capacity
    while c:
        if take[c] < 0:
            c -= 1
        else:
            n = int(lengths[take[c]])
            times[n] = times.get(n, 0) + 1
            c -= n
    return tuple(sorted(times.items(), reverse=True))


def solve(need: dict[int, int], capacity: int, rounds: int = 800) -> dict[Filling, float]:
    """A fractional solution of the configuration program by multiplicative weights."""
    lengths = np.array(sorted(need))
    demand = np.array([need[n] for n in lengths.tolist()], float)
    place = {n: i for i, n in enumerate(lengths.tolist())}
    left, prices = demand.copy(), (lengths / capacity) ** 1.1  # long pieces are harder to place
    out: dict[Filling, float] = {}
    for _ in range(rounds):
        short = left > 0
        if not short.any():
            break
        filling = knapsack(lengths[short], prices[short], capacity)
        at = np.array([place[n] for n, _ in filling])
        times = np.array([k for _, k in filling], float)
        use = float((left[at] / times).min())
        use = max(use, min(1.0, float((left[at] / times).max())))
        out[filling] = out.get(filling, 0.0) + use
        left[at] -= times * use
        prices[at] *= np.exp(-0.05 * np.minimum(1.0, times * use / demand[at]))
    return out


def best_fit(need: dict[int, int], capacity: int) -> dict[Filling, int]:
    """Best fit decreasing on counts: sequences with equal contents are one entry."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for n in sorted(need, reverse=True):
        k = need[n]
        while k:
            room = min((r for r, of in open_.items() if r >= n and of), default=None)
            if room is None:
                full = capacity // n
                for size, count in ((full, k // full), (k % full, 1)):
                    if size and count:
                        of = open_.setdefault(capacity - size * n, {})
                        of[(n,) * size] = of.get((n,) * size, 0) + count
                break
            own, count = next(iter(open_[room].items()))
            used = min(k, count)
            if used == count:
                del open_[room][own]
            else:
                open_[room][own] = count - used
            of = open_.setdefault(room - n, {})
            of[(*own, n)] = of.get((*own, n), 0) + used
            k -= used
    out: dict[Filling, int] = {}
    for of in open_.values():
        for own, count in of.items():
            filling = tuple((n, own.count(n)) for n in sorted(set(own), reverse=True))
            out[filling] = out.get(filling, 0) + count
    return out


def plan(need: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Fillings and how many sequences use each; together they hold ``need`` exactly."""
    out: dict[Filling, int] = {}
    left = {n: k for n, k in need.items() if k}
    for _ in range(2):
        for filling, use in sorted(solve(left, capacity).items(), key=lambda x: (-x[1], x[0])) if left else ():
            count = min(int(use), *(left.get(n, 0) // k for n, k in filling))
            if count > 0:
                out[filling] = out.get(filling, 0) + count
                for n, k in filling:
                    left[n] -= k * count
        left = {n: k for n, k in left.items() if k}
    for filling, count in best_fit(left, capacity).items():
        out[filling] = out.get(filling, 0) + count
    return sorted(out.items(), reverse=True)


@dataclass(frozen=True)
class Intervals:
    """Of each length, which ranks go to which sequences: sorted by ``key`` = length << 40 | first rank."""

    key: np.ndarray
    sequence: np.ndarray
    times: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(fillings: list[tuple[Filling, int]]) -> Intervals:
        rank: dict[int, int] = {}
        rows, sequence = [], 0
        for filling, count in fillings:
            offset = 0
            for n, k in filling:
                rows.append(((n << 40) | rank.get(n, 0), sequence, k, offset))
                rank[n] = rank.get(n, 0) + k * count
                offset += n * k
            sequence += count
        rows.sort()
        return Intervals(*(np.array([r[i] for r in rows], np.int64) for i in range(4)))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << 40) | rank
        at = np.searchsorted(self.key, key, side="right") - 1
        inside = key - self.key[at]
        return self.sequence[at] + inside // self.times[at], self.offset[at] + inside % self.times[at] * length


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
         keep_ids: bool = False) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.  The texts are read and
    tokenised once; the pieces are kept in the shared folder."""
    spark = docs.sparkSession
    made = stored(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    histogram = made.groupBy("length").count().collect()  # at most ``capacity`` rows
    fillings = plan({r["length"]: r["count"] for r in histogram}, capacity)
    sent = spark.sparkContext.broadcast(Intervals.of(fillings))
    # a length may hold a third of all pieces: ranks are numbered within buckets of a length
    bucket = F.pmod(F.xxhash64(f"`{id_col}`", "piece", "ids_crc32"), F.lit(4 * shuffle_parts(spark))).cast("int")
    rows = made.withColumn("flowbook_bucket", bucket)
    key = ["length", "flowbook_bucket"]
    before = Window.partitionBy("length").orderBy("flowbook_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*key).count().select(*key, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("flowbook_base"))
    own = Window.partitionBy(*key).orderBy(f"`{id_col}`", "piece")
    ranked = rows.withColumn("flowbook_rank", F.row_number().over(own) - 1).join(base, key).withColumn("flowbook_rank", F.col("flowbook_rank") + F.col("flowbook_base"))
    n = len(made.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            sequence, offset = sent.value.place(length, b.column("flowbook_rank").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:n], "sequence_id", "offset"])

    return ranked.select(*[F.col(f"`{c}`") for c in made.columns], "flowbook_rank").mapInArrow(lean(run), f"{columns(made)}sequence_id long, offset long")
