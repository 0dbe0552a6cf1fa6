"""Benchmark decontamination (op4).

The benchmark's items become windows of 13 normalised words (an item of fewer
words is one window).  Their hashes are broadcast as a set, all documents are
scanned once with rolling hashes, each hit is verified word by word, and the
words inside any verified occurrence are marked.  A contaminated document can be
dropped, or the marked spans removed.

The broadcast holds at most ``max_block_words`` words of items.  A larger
benchmark is split by item into blocks below that bound, and the documents are
scanned once a block; the hits of a document are carried along as spans, so the
result does not depend on the number of blocks.

Null text has no words.  Null or wordless items have no window; a null item_id is
reported as the empty string; equal items are all reported.  Repeated rows are
judged one by one.  Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbook.llm.scan import NOT_ALNUM, Chunk, Words, chunks, covered
from flowbook.llm.store import columns, lean, stored

WINDOW = 13
MAX_BLOCK_WORDS = 5_000_000
_FILTER_BITS = 22


@dataclass
class Grouped:
    """Windows of one length: the hash and first word of each distinct one, by hash,
    and its items, ``items[lo[i]:lo[i + 1]]``; ``seen`` is a filter by the low bits."""

    hashes: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    items: np.ndarray
    seen: np.ndarray


class Windows:
    """Windows of a block of items, in arrays: the items' bytes and words stand once,
    a window is a hash, a word number and its items' numbers."""

    def __init__(self, rows: list[tuple[str, str]], window: int = WINDOW):
        self.names = [item for item, _ in rows]
        low, start, end = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        n_bytes = n_words = 0
        for c in chunks(pa.array([text for _, text in rows], pa.large_string())):
            w = c.words(NOT_ALNUM)
            for n in {window, *np.unique(w.count[(w.count > 0) & (w.count < window)]).tolist()}:
                at, h = w.windows(n)
                doc = w.doc[at]
                if n < window:
                    whole = w.count[doc] == n
                    at, h, doc = at[whole], h[whole], doc[whole]
                if len(at):
                    parts.setdefault(n, []).append((h, at + n_words, (doc + c.first).astype(np.int32)))
            low.append(w.low)
            start.append(w.start + n_bytes)
            end.append(w.end + n_bytes)
            n_bytes, n_words = n_bytes + len(w.low), n_words + len(w.start)
        self.low, self.start, self.end = np.concatenate(low), np.concatenate(start), np.concatenate(end)
        self.by_length = {n: self._grouped(n, *map(np.concatenate, zip(*p, strict=True))) for n, p in sorted(parts.items())}

    def text(self, i: int, n: int) -> bytes:
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.start[i:i + n], self.end[i:i + n], strict=True))

    def _grouped(self, n: int, h: np.ndarray, at: np.ndarray, item: np.ndarray) -> Grouped:
        order = np.lexsort((item, h))
        h, at, item = h[order], at[order], item[order]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
        text_no = np.zeros(len(h), np.int32)  # among the texts of one hash
        for k in np.flatnonzero(np.diff(edge) > 1).tolist():
            texts: dict[bytes, int] = {}
            for i in range(int(edge[k]), int(edge[k + 1])):
                text_no[i] = texts.setdefault(self.text(int(at[i]), n), len(texts))
        order = np.lexsort((item, text_no, h))
        h, at, item, text_no = h[order], at[order], item[order], text_no[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (text_no[1:] != text_no[:-1])])
        kept = new | np.concatenate([[True], item[1:] != item[:-1]])  # an item once a window
        lo = np.concatenate([(np.cumsum(kept) - 1)[new], [kept.sum()]])
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[h & np.uint64((1 << _FILTER_BITS) - 1)] = True
        return Grouped(h[new], at[new], lo, item[kept], seen)

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray, list[tuple[int, str]]]:
        """First word and length of each verified occurrence, and (text number, item) pairs."""
        first, length, items = [], [], set()
        for n, of in self.by_length.items():
            at, h = w.windows(n)
            maybe = np.flatnonzero(of.seen[h & np.uint64((1 << _FILTER_BITS) - 1)])
            at, h = at[maybe], h[maybe]
            begin, stop = np.searchsorted(of.hashes, h), np.searchsorted(of.hashes, h, side="right")
            sure = begin < stop
            for i, g, last in zip(at[sure].tolist(), begin[sure].tolist(), stop[sure].tolist(), strict=True):
                words = w.text(i, i + n)
                while g < last and self.text(int(of.at[g]), n) != words:
                    g += 1
                if g < last:
                    first.append(i)
                    length.append(n)
                    doc = int(w.doc[i])
                    items.update((doc, self.names[k]) for k in of.items[of.lo[g]:of.lo[g + 1]].tolist())
        return np.array(first, np.int64), np.array(length, np.int64), sorted(items)


_ADDED = "n_words long, hit_start array<long>, hit_end array<long>, hit_items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
         window: int = WINDOW, max_block_words: int = MAX_BLOCK_WORDS, keep_text: bool = True) -> DataFrame:
    """``docs`` (with ``keep_text`` false, without the text) with ``n_words``, the
    hit words as runs ``hit_start`` / ``hit_end`` (word numbers from 0, end
    exclusive) and the sorted ``hit_items``."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")).filter("text IS NOT NULL")
    # half the characters, rounded up, bound an item's words; blocks are made of whole items by hash
    total = items.agg(F.sum(F.ceil(F.length("text") / 2))).first()[0] or 0
    blocks = 1 + int(total // max_block_words)
    n, text_at = len(docs.columns), docs.columns.index(text_col)
    out = docs
    for k in range(blocks):
        # one block is collected at a time, each within the bound but for the hash's unevenness
        rows = [(r["item"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()]
        last = k + 1 == blocks
        own = [i for i in range(n) if i != text_at or keep_text or not last]
        schema = columns(docs.select(*[F.col(f"`{docs.columns[i]}`") for i in own])) + _ADDED
        out = out.mapInArrow(lean(_scanner(spark.sparkContext.broadcast(rows), window, own, text_at, n if k else None)), schema)
        if not last:
            out = stored(out, "decontaminate")
    return out


def _scanner(sent, window: int, own: list[int], text_at: int, before_at: int | None):
    """``before_at``: where the columns of the blocks before begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Windows(sent.value, window)
        for b in batches:
            for c in chunks(b.column(text_at)):
                part = b.slice(c.first, c.n)
                before = None if before_at is None else [part.column(before_at + i).to_pylist() for i in (1, 2, 3)]
                made = _marked(c, known, before)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in own], *made.values()], names=[*[b.schema.names[i] for i in own], *made])

    return run


def _marked(c: Chunk, known: Windows, before: list | None) -> dict[str, pa.Array]:
    w = c.words(NOT_ALNUM)
    first, length, pairs = known.find(w)
    items: list[set[str]] = [set(x) for x in before[2]] if before else [set() for _ in range(c.n)]
    for d, item in pairs:
        items[d].add(item)
    if before:
        more = [(w.lo[d] + s, e - s) for d in range(c.n) for s, e in zip(before[0][d], before[1][d], strict=True)]
        first = np.concatenate([first, np.array([x for x, _ in more], np.int64)])
        length = np.concatenate([length, np.array([x for _, x in more], np.int64)])
    hit = covered(first, length, len(w.start))
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    cut = hit[1:] & hit[:-1] & (w.doc[1:] != w.doc[:-1]) if len(hit) else np.zeros(0, bool)  # a run ends with its text
    start = np.sort(np.concatenate([np.flatnonzero(edge == 1), np.flatnonzero(cut) + 1]))
    end = np.sort(np.concatenate([np.flatnonzero(edge == -1), np.flatnonzero(cut) + 1]))
    doc = w.doc[start] if len(start) else np.zeros(0, np.int64)
    at = np.searchsorted(doc, np.arange(c.n + 1))
    own = w.lo[doc] if len(doc) else np.zeros(0, np.int64)
    return {"n_words": pa.array(w.count.astype(np.int64)),
            "hit_start": pa.ListArray.from_arrays(at.astype(np.int32), pa.array((start - own).astype(np.int64))),
            "hit_end": pa.ListArray.from_arrays(at.astype(np.int32), pa.array((end - own).astype(np.int64))),
            "hit_items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}


def n_hit():
    """Marked words of a scanned document."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return total(F.col("hit_end")) - total(F.col("hit_start"))


def contaminated(percent: int = 5):
    """At least ``percent`` of the words, and one at least, are marked."""
    return (n_hit() > 0) & (100 * n_hit() >= percent * F.col("n_words"))


def drop_documents(docs: DataFrame, benchmark: DataFrame, percent: int = 5, **names) -> DataFrame:
    """``docs`` without the contaminated ones; the others are as they were."""
    return scan(docs, benchmark, **names).filter(~contaminated(percent)).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """``docs`` with the marked words, and what stands between them, cut out of the text."""
    found = scan(docs, benchmark, text_col=text_col, **names)
    n, k = len(docs.columns), docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(k)):
                part, w = b.slice(c.first, c.n), c.words(NOT_ALNUM)
                runs = zip(part.column(n + 1).to_pylist(), part.column(n + 2).to_pylist(), part.column(k).to_pylist(), strict=True)
                texts = [t if not s else _without(c, w, d, s, e) for d, (s, e, t) in enumerate(runs)]
                own = list(part.columns[:n])
                own[k] = pa.array(texts, own[k].type)
                yield pa.RecordBatch.from_arrays(own, names=b.schema.names[:n])

    return found.mapInArrow(lean(cut), columns(docs)[:-2])


def _without(c: Chunk, w: Words, d: int, starts: list[int], ends: list[int]) -> str:
    raw, at, out = c.raw, int(c.off[d]), []
    for s, e in zip(starts, ends, strict=True):
        out.append(raw[at:w.start[w.lo[d] + s]].tobytes())
        at = int(w.end[w.lo[d] + e - 1])
    return b"".join([*out, raw[at:c.off[d + 1]].tobytes()]).decode()


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
