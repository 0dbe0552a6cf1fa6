"""Language-model scores by a hierarchical Pitman-Yor model (op12).

A token is a word or the end of a text.  Every context is a restaurant whose
customers are the tokens that follow it, and whose tables send a customer each to
the parent restaurant: the contexts are the start of a text and every word; all share
one parent, the restaurant without context, whose own parent is uniform over the known
words and one more.  What all tasks know of a context, its customers and tables, is a
table for the start and the words that make up at least 1 in ``contexts`` of the
training tokens, so at most ``contexts`` of them.  The totals of rarer words, as many
as there are, are exchanged between the buckets that hold them.

Spark deals the corpus twice.  Texts are read in chunks; a chunk sends each of its
distinct (word, context) with its training count to the word's bucket, where the
counts of all chunks are added up.  All of a word's restaurants are thus in one
place, a context's dishes are spread over all buckets, and neither a common word
nor a common context makes a large group (a word has at most one number for each
context and chunk).  Gibbs sampling runs in every bucket: all customers of a dish leave
their restaurant and are seated again at once (``tables``), level by level; after each sweep the tables of every
context are summed over all buckets and given to the next: those of rarer words by
ranges of their hashes, to which each bucket sends one number for each of its contexts
and from which it gets the sums of these.  A sweep is replayed
from its seed, so a bucket keeps no state that could be lost.  The predictive
probabilities of the sweeps are averaged, and sent back to the chunks that asked;
there they are added up by text.

Training texts are those whose crc32(doc_id as text) modulo 7 is not 2; null doc_id
counts as the empty text.  Null text is empty: its one token is the end.  Words are
told apart by 64 bits of a hash.  Repeated rows are texts of their own.  Without
training tokens every token has probability 1 in 1.  Other columns are not read.  A
text is held whole by a task; so is a chunk (``chunk_bytes``) and a bucket
(``bucket_tokens`` training tokens, on average).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbook.llm.scan import BLANKS, CHUNK_BYTES as SCAN_BYTES, Chunk, chunks
from flowbook.llm.store import dropped, lean, lean_group, shared_path, shuffle_parts, stored
from flowbook.llm.tables import seated

CONTEXTS = 20_000
CHUNK_BYTES, BUCKET_TOKENS = 8 << 20, 3_000_000
SWEEPS, SEED = 2, 12
STRENGTH = 1.0
_END = np.uint64(0)
_START = 1  # context 0 is none


@dataclass(frozen=True)
class Corpus:
    """What all tasks know: training tokens, distinct ones, the frequent words (sorted
    hashes; word k is context k + 2) and the number of buckets.  Contexts from ``contexts``
    on are the rarer words of a chunk or bucket, numbered there by their hashes."""

    tokens: int
    words: int
    frequent: np.ndarray
    buckets: int

    @property
    def contexts(self) -> int:
        return len(self.frequent) + 2

    def bucket(self, words: np.ndarray) -> np.ndarray:
        """Rises with the hash."""
        return ((words >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)


def packed(a: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), "zstd", asbytes=True) if len(a) else b""


def unpacked(data: bytes | pa.Buffer, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, n * size, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(kind)


def _framed(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _parts(data: bytes | pa.Buffer) -> list[memoryview]:
    data, out, at = memoryview(data), [], 0
    while at < len(data):
        n = int.from_bytes(data[at:at + 8], "little")
        out.append(data[at + 8:at + 8 + n])
        at += 8 + n
    return out


def _steps(a: np.ndarray) -> np.ndarray:
    """Rising numbers as differences."""
    return np.diff(a, prepend=a.dtype.type(0))


def _tokens(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash of each token, number of tokens of each text, place of each text's first token).
    Read in runs of texts of about ``SCAN_BYTES``, since a scan takes some 50 times the bytes of its texts."""
    words, counts, lo = [], [], 0
    while lo < c.n:
        hi = max(lo + 1, int(np.searchsorted(c.off, c.off[lo] + SCAN_BYTES, side="right")) - 1)
        w = Chunk(c.raw[c.off[lo]:c.off[hi]], c.off[lo:hi + 1] - c.off[lo], 0).words(BLANKS)
        out = np.full(len(w.hash) + hi - lo, _END)
        out[np.arange(len(w.hash)) + w.doc] = w.hash
        words.append(out)
        counts.append(w.count + 1)
        lo = hi
    count = np.concatenate(counts)
    return np.concatenate(words), count, np.cumsum(count) - count


def word_counts(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """``word`` (hash), ``n``: tokens in training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(2), chunk_bytes):
                words, count, _ = _tokens(c)
                u, n = np.unique(words[np.repeat(~held[c.first:c.first + c.n], count)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.mapInArrow(lean(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def corpus(counts: DataFrame, contexts: int, bucket_tokens: int) -> Corpus:
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = counts.filter((F.col("n") * contexts >= n) & (F.col("word") != 0)).select("word").collect()  # at most ``contexts`` rows
    frequent = np.sort(np.array([r["word"] for r in often], np.int64).view(np.uint64))
    return Corpus(n, v, frequent, n // bucket_tokens + 1)


def _encode(known: Corpus, chunk_bytes: int, ids_type: pa.DataType) -> Callable:
    """Of each chunk a row of kind 0, its texts as places in its sorted distinct (word, context),
    and for each bucket a row of kind 1, those of the bucket's words with their training counts
    and the hashes of their rarer contexts."""
    names = ["kind", "chunk", "bucket", "n", "ids", "a", "b", "c", "d"]

    def pairs(c: Chunk, held: np.ndarray) -> tuple:
        words, count, first = _tokens(c)
        u, word = np.unique(words, return_inverse=True)
        follows = known.contexts + np.arange(len(u))
        if len(known.frequent):
            at = np.searchsorted(known.frequent, u)
            at[at == len(known.frequent)] = 0
            follows = np.where(known.frequent[at] == u, at + 2, follows)
        context = np.empty(len(words), np.int64)
        context[1:] = follows[word[:-1]]
        context[first] = _START
        every = known.contexts + len(u)
        key, place = np.unique(word * every + context, return_inverse=True)
        n = np.bincount(place, np.repeat(~held, count), len(key)).astype(np.uint32)
        return count, place, u, key // every, key % every, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            held_all = batch.column(1).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(2), chunk_bytes):
                here = slice(c.first, c.first + c.n)
                count, place, u, word, context, n = pairs(c, held_all[here])
                new = np.diff(word, prepend=-1) > 0
                rows = [(0, number, 0, len(word), batch.column(0)[here].to_pylist(), packed(place.astype(np.uint32)), np.packbits(new).tobytes(),
                         packed(count.astype(np.uint32)), len(place).to_bytes(8, "little"))]
                bucket = known.bucket(u)
                starts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1)))
                for i, j in zip(starts, [*starts[1:], len(u)], strict=True):
                    lo, hi = np.searchsorted(word, [i, j])
                    here_context = context[lo:hi]
                    rare = here_context >= known.contexts
                    rarer, at = np.unique(here_context[rare], return_inverse=True)
                    here_context[rare] = known.contexts + at
                    rows.append((1, number, int(bucket[i]), int(hi - lo), None, packed(_steps(u[i:j])), packed(np.diff(word[lo:hi], prepend=i).astype(np.uint8)),
                                 _framed(packed(here_context.astype(np.uint32)), len(rarer).to_bytes(8, "little"), packed(_steps(u[rarer - known.contexts]))), packed(n[lo:hi])))
                cols = list(zip(*rows, strict=True))
                types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(ids_type), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=names)
                number += 1

    return run


def _gather(known: Corpus) -> Callable:
    """A bucket's rows of all chunks to one: its distinct (word, context) with counts,
    its rarer contexts, and which (word, context) each chunk asked for.  The rows are read
    in place, twice: first their words and rarer contexts, then each chunk's entries into one array."""
    def run(rows: pa.Table) -> pa.Table:
        chunk = rows.column("chunk").to_numpy()
        order = np.argsort(chunk, kind="stable")
        chunk, sizes = chunk[order], rows.column("n").to_numpy()[order]
        read = lambda name, i: rows.column(name)[int(i)].as_buffer()
        words, rarer = [], []
        for i, m in zip(order, sizes, strict=True):
            distinct = int(unpacked(read("b", i), int(m), np.uint8).sum(dtype=np.int64)) + 1
            words.append(np.cumsum(unpacked(read("a", i), distinct, np.uint64)))
            _, n_rare, hashes = _parts(read("c", i))
            rarer.append(np.cumsum(unpacked(hashes, int.from_bytes(n_rare, "little"), np.uint64)))
        u, rare = np.unique(np.concatenate(words)), np.unique(np.concatenate(rarer))
        every = known.contexts + len(rare)
        ends = np.cumsum(sizes)
        key, n = np.empty(ends[-1], np.int64), np.empty(ends[-1], np.uint32)
        for k, i in enumerate(order):
            m = int(sizes[k])
            here = slice(int(ends[k]) - m, int(ends[k]))
            context = unpacked(_parts(read("c", i))[0], m, np.uint32).astype(np.int64)
            at = context >= known.contexts
            context[at] = known.contexts + np.searchsorted(rare, rarer[k])[context[at] - known.contexts]
            place = np.searchsorted(u, words[k])[np.cumsum(unpacked(read("b", i), m, np.uint8), dtype=np.int64)]
            key[here] = place * every + context
            n[here] = unpacked(read("d", i), m, np.uint32)
            words[k] = rarer[k] = None
        key, place = np.unique(key, return_inverse=True)
        count = np.bincount(place, n, len(key)).astype(np.int64)
        asked = [packed(_steps(p.astype(np.uint32))) for p in np.split(place, ends[:-1])]
        return pa.table({
            "bucket": pa.array([rows.column("bucket")[0].as_py()], pa.int32()), "n": pa.array([len(key)], pa.int64()), "word": pa.array([packed(_steps((key // every).astype(np.uint32)))], pa.binary()),
            "context": pa.array([packed((key % every).astype(np.uint32))], pa.binary()), "count": pa.array([packed(count)], pa.binary()),
            "n_rare": pa.array([len(rare)], pa.int64()), "rare": pa.array([packed(_steps(rare))], pa.binary()),
            "chunks": pa.array([chunk], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int64())), "asked": pa.array([asked], pa.list_(pa.binary()))})

    return lean_group(run)


_BUCKET = "bucket int, n long, word binary, context binary, count binary, n_rare long, rare binary, chunks array<long>, sizes array<long>, asked array<binary>"


class Seats:
    """Restaurants side by side: the customers at each table, tables in order of their restaurant and dish (entry).
    The plain sampler, customer by customer: its sweeps tend to what ``seated`` draws from, and tests compare both."""

    def __init__(self, customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator):
        """Customers seated one after the other, later ones in blocks of an eighth of those before."""
        self.d, self.rng = discount, rng
        tables, seated = (customers > 0).astype(np.int64), (customers > 0).astype(np.int64)
        active = np.flatnonzero(seated < customers)
        while len(active):
            block = np.minimum(np.maximum(1, seated[active] // 8), customers[active] - seated[active])
            p = new[active] / (new[active] + seated[active] - discount * tables[active])
            tables[active] += rng.binomial(block, p)
            seated[active] += block
            active = active[seated[active] < customers[active]]
        self.customers = customers.astype(np.int64)
        self.tables = tables
        owner = np.repeat(np.arange(len(tables)), tables)
        rank = np.arange(len(owner)) - self._ptr()[owner]
        share = (rank + 1.0) ** (-1 / discount)
        total = np.bincount(owner, share, len(tables))
        self.sizes = 1 + ((customers - tables)[owner] * share / total[owner]).astype(np.int64)
        first = np.flatnonzero(rank == 0)
        self.sizes[first] += (customers - np.bincount(owner, self.sizes, len(tables)).astype(np.int64))[owner[first]]

    def _ptr(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.tables)])

    def remove(self, e: np.ndarray) -> None:
        """A random customer leaves each entry of ``e`` (distinct, each with a customer)."""
        ends = np.cumsum(self.sizes)
        ptr = self._ptr()
        below = np.where(ptr[e] > 0, ends[ptr[e] - 1], 0)
        at = np.searchsorted(ends, below + (self.rng.random(len(e)) * self.customers[e]).astype(np.int64), side="right")
        self.sizes[at] -= 1
        self.customers[e] -= 1
        empty = self.sizes[at] == 0
        self.tables[e[empty]] -= 1
        self.sizes = np.delete(self.sizes, at[empty])

    def add(self, e: np.ndarray, new: np.ndarray) -> None:
        """A customer comes to each entry of ``e``; ``new`` is the weight of a new table."""
        old = self.customers[e] - self.d * self.tables[e]
        opens = self.rng.random(len(e)) * (new + old) >= old
        ptr = self._ptr()
        s = e[~opens]
        ends = np.cumsum(self.sizes - self.d)
        below = np.where(ptr[s] > 0, ends[ptr[s] - 1], 0)
        at = np.searchsorted(ends, below + self.rng.random(len(s)) * old[~opens], side="right")
        self.sizes[np.clip(at, ptr[s], ptr[s + 1] - 1)] += 1
        o = e[opens]
        self.sizes = np.insert(self.sizes, ptr[o + 1], 1)
        self.customers[e] += 1
        self.tables[o] += 1

    def reseat(self, e: np.ndarray, customers: np.ndarray, new: np.ndarray) -> None:
        """The entries ``e`` (distinct) get ``customers`` in place of those they have, seated anew."""
        owner = np.repeat(np.arange(len(self.tables)), self.tables)
        stay = ~np.isin(owner, e)
        fresh = Seats(customers, new, self.d, self.rng)
        owner = np.concatenate([owner[stay], np.repeat(e, fresh.tables)])
        self.sizes = np.concatenate([self.sizes[stay], fresh.sizes])[np.argsort(owner, kind="stable")]
        self.tables[e], self.customers[e] = fresh.tables, fresh.customers

    def sweep(self, new: np.ndarray, times: int) -> None:
        """Up to ``times`` customers of each entry, one after the other, leave and come back."""
        for k in range(times):
            e = np.flatnonzero(self.customers > max(k, 1))
            if len(e):
                self.remove(e)
                self.add(e, new[e])


@dataclass(frozen=True)
class Totals:
    """Over all buckets: customers and tables of the contexts (0: the parent restaurant)."""

    customers: np.ndarray
    tables: np.ndarray


@dataclass(frozen=True)
class Model:
    corpus: Corpus
    discount: float
    root_discount: float
    history: tuple[Totals, ...]
    seed: int
    rare: dict[int, list[Totals]] | None = None  # by bucket, of its rarer contexts, where the model is all in one place

    def totals(self, bucket: int, rare: list[Totals] | None = None) -> list[Totals]:
        """Of all contexts of a bucket, before the first sweep and after each."""
        rare = self.rare[bucket] if rare is None else rare
        return [Totals(np.concatenate([a.customers, b.customers]), np.concatenate([a.tables, b.tables])) for a, b in zip(self.history, rare, strict=True)]


def _bucket_arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = row["n"]
    return np.cumsum(unpacked(row["word"], n, np.uint32).astype(np.int64)), unpacked(row["context"], n, np.uint32).astype(np.int64), unpacked(row["count"], n, np.int64)


def replay(m: Model, bucket: int, word: np.ndarray, context: np.ndarray, count: np.ndarray, sweeps: int, rare: list[Totals] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """After each sweep: tables of every (word, context), customers and tables of every word
    in the parent, and the averaged part of it all, p(word | context) before the totals of
    that sweep are known is left to ``predictive``.  ``rare``: totals of the bucket's rarer
    contexts, where the model does not hold them."""
    rng = np.random.default_rng([m.seed, bucket])
    history = m.totals(bucket, rare)
    n_words = int(word[-1]) + 1
    total = np.bincount(word, count, n_words)
    leaf = np.flatnonzero(count > 1)
    single = count == 1
    was = history[0]
    base = 1 / (m.corpus.words + 1)

    def seats(totals: Totals, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All customers seated, of the words' restaurants and then of the parent."""
        tables = single.astype(np.int64)
        tables[leaf] = seated(count[leaf], (STRENGTH + m.discount * totals.tables[context[leaf]]) * p[word[leaf]], m.discount, rng)
        sends = np.bincount(word, tables, n_words).astype(np.int64)
        return tables, sends, seated(sends, np.full(n_words, (STRENGTH + m.root_discount * totals.tables[0]) * base), m.root_discount, rng)

    tables, sends, parents = seats(was, total / max(1, m.corpus.tokens))
    for s in range(sweeps):
        was = history[s]
        tables, sends, parents = seats(was, root_predictive(m, was, sends, parents))
        yield tables, sends, parents, total


def root_predictive(m: Model, totals: Totals, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    c, t = totals.customers[0], totals.tables[0]
    return (customers - m.root_discount * tables + (STRENGTH + m.root_discount * t) / (m.corpus.words + 1)) / (STRENGTH + c)


def predictive(m: Model, totals: Totals, word: np.ndarray, context: np.ndarray, count: np.ndarray, tables: np.ndarray, customers: np.ndarray, parent_tables: np.ndarray) -> np.ndarray:
    """p(word | context) of every entry, given the seating."""
    p = root_predictive(m, totals, customers, parent_tables)[word]
    c, t = totals.customers[context], totals.tables[context]
    inner = (count - m.discount * tables + (STRENGTH + m.discount * t) * p) / (STRENGTH + c)
    return np.where(context > 0, inner, p)


def _table(rows: Iterator[tuple], schema: str, types: list[pa.DataType]) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


#: What a bucket sends: sums over buckets are wanted of ``n`` by (kind, at), and of the numbers of the rarer contexts in a range of hashes.
_SENT = "kind int, at int, n long, part int, bucket int, hashes binary, customers binary, tables binary"
_SENT_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_RARE = -1  # the kind of the latter
#: What it gets back, of a sweep and range.
_TOTALS = "bucket int, sweep int, part int, n long, customers binary, tables binary"


def _sent(known: Corpus, row: dict, sums: dict[int, np.ndarray], customers: np.ndarray, tables: np.ndarray) -> Iterator[tuple]:
    """``customers`` and ``tables`` of the bucket's rarer contexts."""
    for kind, a in sums.items():
        at = np.flatnonzero(a)
        yield from ((kind, i, n, None, None, None, None, None) for i, n in zip(at.tolist(), a[at].astype(np.int64).tolist(), strict=True))
    rare = np.cumsum(unpacked(row["rare"], row["n_rare"], np.uint64))
    part = known.bucket(rare)
    starts = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1)))
    for i, j in zip(starts, [*starts[1:], len(rare)], strict=True):
        yield _RARE, None, int(j - i), int(part[i]), row["bucket"], packed(_steps(rare[i:j])), packed(customers[i:j].astype(np.int64)), packed(tables[i:j].astype(np.int64))


def _summed(sweep: int) -> Callable:
    """A range's numbers of all buckets, summed by context, to each bucket those of its contexts."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket").to_pydict()
        join = lambda name, kind: np.concatenate([unpacked(x, n, kind) for x, n in zip(rows[name], rows["n"], strict=True)])
        u, place = np.unique(np.concatenate([np.cumsum(unpacked(x, n, np.uint64)) for x, n in zip(rows["hashes"], rows["n"], strict=True)]), return_inverse=True)
        cut = np.cumsum(rows["n"])[:-1]
        back = lambda name: [packed(x) for x in np.split(np.bincount(place, join(name, np.int64), len(u)).astype(np.int64)[place], cut)]
        k = len(rows["n"])
        return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "sweep": pa.array([sweep] * k, pa.int32()), "part": pa.array(rows["part"], pa.int32()), "n": pa.array(rows["n"], pa.int64()),
                         "customers": pa.array(back("customers"), pa.binary()), "tables": pa.array(back("tables"), pa.binary())})

    return run


def _exchanged(sent: DataFrame, sweep: int, contexts: int, kinds: int) -> tuple[list[np.ndarray], DataFrame]:
    """The sums by kind (at most ``kinds * contexts`` rows come back), and the totals of rarer contexts by bucket."""
    out = [np.zeros(contexts, np.int64) for _ in range(kinds)]
    for r in sent.filter(F.col("kind") != _RARE).groupBy("kind", "at").agg(F.sum("n").alias("n")).collect():
        out[r["kind"]][r["at"]] = r["n"]
    totals = sent.filter(F.col("kind") == _RARE).select("part", "bucket", "n", "hashes", "customers", "tables")
    return out, stored(totals.groupBy("part").applyInArrow(lean_group(_summed(sweep)), _TOTALS), "lm-totals")


def _history(rows: list[dict], sweeps: int) -> list[Totals]:
    """A bucket's rows of totals as arrays, before the first sweep and after each of ``sweeps``."""
    by = [[] for _ in range(sweeps + 1)]
    for r in sorted(rows, key=lambda r: (r["sweep"], r["part"])):
        by[r["sweep"]].append((unpacked(r["customers"], r["n"], np.int64), unpacked(r["tables"], r["n"], np.int64)))
    none = np.zeros(0, np.int64)
    return [Totals(np.concatenate([none, *(c for c, _ in x)]), np.concatenate([none, *(t for _, t in x)])) for x in by]


def _with_totals(buckets: DataFrame, totals: DataFrame, sweeps: int, each: Callable[[dict, list[Totals]], Iterator[tuple]], schema: str, types: list[pa.DataType]) -> DataFrame:
    """``each`` of a bucket and the totals of its rarer contexts."""
    def run(bucket: pa.Table, rare: pa.Table) -> pa.Table:
        (row,) = bucket.to_pylist()
        return _table(each(row, _history(rare.to_pylist(), sweeps)), schema, types)

    return buckets.groupBy("bucket").cogroup(totals.groupBy("bucket")).applyInArrow(lean_group(run), schema)


def fit(buckets: DataFrame, known: Corpus, sweeps: int = SWEEPS, seed: int = SEED) -> tuple[Model, DataFrame]:
    """Discounts from the numbers of entries seen once and twice, and the totals after each
    sweep: of the frequent contexts in the model, of the others as rows by bucket."""
    state = buckets.select("bucket", "n", "word", "context", "count", "n_rare", "rare")
    k = known.contexts

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                yield from _table(counted(row), _SENT, _SENT_TYPES).to_batches()

    def counted(row: dict) -> Iterator[tuple]:
        word, context, count = _bucket_arrays(row)
        by = lambda w: np.bincount(context, w, k + row["n_rare"])
        customers, tables = by(count), by(count > 0)
        sends = np.bincount(word, count > 0)
        customers[0], tables[0] = sends.sum(), (sends > 0).sum()
        few = np.array([(count == 1).sum(), (count == 2).sum()])
        few_sent = np.array([(sends == 1).sum(), (sends == 2).sum()])
        return _sent(known, row, {0: customers[:k], 1: tables[:k], 2: few, 3: few_sent}, customers[k:], tables[k:])

    (customers, tables, few, sent), totals = _exchanged(stored(state.mapInArrow(lean(first), _SENT), "lm-sent"), 0, k, 4)
    discount = lambda x: float(np.clip(x[0] / (x[0] + 2 * x[1]), 0.05, 0.95)) if x[0] else 0.5
    model = Model(known, discount(few), discount(sent), (Totals(customers, tables),), seed)
    for s in range(1, sweeps + 1):
        def after(row: dict, rare: list[Totals], m: Model = model, s: int = s) -> Iterator[tuple]:
            word, context, count = _bucket_arrays(row)
            *_, (tables, sends, parents, _) = replay(m, row["bucket"], word, context, count, s, rare)
            t = np.bincount(context, tables, k + row["n_rare"])
            c = np.zeros(k)
            c[0], t[0] = sends.sum(), parents.sum()
            # the customers of a context stay as they are
            return _sent(known, row, {0: c, 1: t[:k]}, np.bincount(context, count, k + row["n_rare"])[k:], t[k:])

        (c, t), more = _exchanged(stored(_with_totals(state, totals, s - 1, after, _SENT, _SENT_TYPES), "lm-sent"), s, k, 2)
        now = customers.copy()
        now[0] = c[0]
        model = replace(model, history=(*model.history, Totals(now, t)))
        totals = totals.union(more)
    return model, totals


def sample(buckets: DataFrame, known: Corpus, sweeps: int = SWEEPS, seed: int = SEED) -> Model:
    """``fit`` with all totals in one place, for a small corpus."""
    model, totals = fit(buckets, known, sweeps, seed)
    rows: dict[int, list[dict]] = {r["bucket"]: [] for r in buckets.select("bucket").collect()}
    for r in totals.collect():
        rows[r["bucket"]].append(r.asDict())
    return replace(model, rare={b: _history(x, sweeps) for b, x in rows.items()})


def answers(buckets: DataFrame, m: Model, totals: DataFrame) -> DataFrame:
    """For each bucket and chunk that asked: ``logs``, log10 p of the asked (word, context), and ``counts`` of their words."""
    sweeps = len(m.history) - 1

    def each(row: dict, rare: list[Totals]) -> Iterator[tuple]:
        word, context, count = _bucket_arrays(row)
        p = np.zeros(len(word))
        history = m.totals(row["bucket"], rare)
        for s, (tables, customers, parents, total) in enumerate(replay(m, row["bucket"], word, context, count, sweeps, rare), 1):
            p += predictive(m, history[s], word, context, count, tables, customers, parents) / sweeps
        logs = np.log10(p).astype(np.float32)
        for chunk, n, asked in zip(row["chunks"], row["sizes"], row["asked"], strict=True):
            at = np.cumsum(unpacked(asked, n, np.uint32).astype(np.int64))
            counts = total[np.unique(word[at])].astype(np.int64)
            yield chunk, row["bucket"], n, len(counts), packed(logs[at]), packed(counts)

    return _with_totals(buckets.drop("n_rare", "rare"), totals, sweeps, each, "chunk long, bucket int, n long, n_words long, logs binary, counts binary", [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()])


def _score(known: Corpus, doc_id: str) -> Callable:
    def run(texts: pa.Table, got: pa.Table) -> pa.Table:
        (row,), got = texts.to_pylist(), got.sort_by("bucket").to_pydict()
        logs = np.concatenate([unpacked(x, n, np.float32) for x, n in zip(got["logs"], got["n"], strict=True)]).astype(np.float64)
        counts = np.concatenate([unpacked(x, n, np.int64) for x, n in zip(got["counts"], got["n_words"], strict=True)])
        word = np.cumsum(np.unpackbits(np.frombuffer(row["b"], np.uint8), count=row["n"]).astype(np.int64)) - 1
        place = unpacked(row["a"], int.from_bytes(row["d"], "little"), np.uint32)
        tokens = unpacked(row["c"], len(row["ids"]), np.uint32).astype(np.int64)
        starts = np.cumsum(tokens) - tokens
        base = np.log10((counts + 1.0) / (known.tokens + (known.words + 1.0)))
        add = lambda x: np.add.reduceat(x[place], starts)
        return pa.table({doc_id: texts.column("ids").combine_chunks().flatten(), "n_tokens": tokens, "n_known": add((counts > 0).astype(np.int64)[word]), "base_score": add(base[word]), "score": add(logs)})

    return lean_group(run)


def score_all(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", contexts: int = CONTEXTS, sweeps: int = SWEEPS, seed: int = SEED,
              chunk_bytes: int = CHUNK_BYTES, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each text."""
    spark = docs.sparkSession
    held = (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7) == 2
    rows = docs.select(F.col(doc_id), held.alias("held"), F.col(text_col).cast("string").alias("text"))
    known = corpus(stored(word_counts(rows, chunk_bytes), "lm-words"), contexts, bucket_tokens)
    kind = rows.schema[doc_id].dataType
    path = shared_path(spark, "lm-chunks", keep=True)
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"kind int, chunk long, bucket int, n long, ids array<{kind.simpleString()}>, a binary, b binary, c binary, d binary"
    rows.mapInArrow(lean(_encode(known, chunk_bytes, to_arrow_type(kind))), schema).write.partitionBy("kind").parquet(path)
    read = lambda k: spark.read.schema(schema.replace("kind int, ", "")).parquet(f"{path}/kind={k}")
    if rows.isEmpty():
        return rows.select(doc_id, "held", *[F.lit(0).cast(t).alias(c) for c, t in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"))]).withColumnRenamed("held", "held_out")
    asks = read(1).select("chunk", "bucket", "n", "a", "b", "c", "d")
    buckets = stored(asks.groupBy("bucket").applyInArrow(_gather(known), _BUCKET), "lm-buckets")
    dropped(spark, f"{path}/kind=1")
    model, totals = fit(buckets, known, sweeps, seed)
    result = f"`{doc_id}` {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double"
    scored = read(0).select("chunk", "n", "ids", "a", "b", "c", "d").groupBy("chunk").cogroup(answers(buckets, model, totals).groupBy("chunk")).applyInArrow(_score(known, doc_id), result)
    return scored.select(doc_id, ((F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7) == 2).alias("held_out"), "n_tokens", "n_known",
                         F.lit(known.tokens).cast("long").alias("train_tokens"), "base_score", "score")
