"""Quality rules with cross-document line frequency (op10).

Base rules look at one text: too few words, or too many words in windows that
repeat.  The method looks across documents: lines are normalised (A-Z lowered,
blanks as one space) and hashed, and for each host (``documents.source``) the
distinct texts that hold a line are counted.  A line held by more than
``max(min_docs, share of the host's distinct texts)`` is above the limit and is
removed from every document but the host's first (smallest id) that holds it, so
that text never disappears from all its holders.  A document whose words are
mostly removed is depleted and rejected.  ``clean_col`` names a column for the text
without the removed lines; the other lines stay byte for byte.

Null text has no words.  A null host is a host of its own.  Rows with one id are
judged each by its own text; exact copies count as one text; ties for the first
holder are all first.  Other columns pass through ``quality_rules`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbook.llm.scan import BLANKS, Chunk, Words, between, chunks, covered, mix, per_doc, prefix, raw_prefix
from flowbook.llm.store import columns, lean, stored

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_KEY = "flowbook_host"  # names of ours that a caller's table is not expected to have


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    repeat_window: int = 8
    max_repeat_percent: int = 30
    min_docs: int = 10          # a line in at most so many texts of a host is never removed
    host_percent: int = 5       # nor one in at most so many percent of the host's texts
    depleted_percent: int = 30  # fewer words left than this share: depleted
    max_broadcast_lines: int = 1_000_000  # 16 bytes each; more lines above the limit are joined


def _lines(chunk: Chunk, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the ``\\n``-split lines with a word: byte start, end, first word, word after the last."""
    first = np.zeros(len(chunk.raw) + 1, bool)
    first[np.flatnonzero(chunk.raw == 10) + 1] = True
    first[chunk.off[:-1]] = True
    first[-1] = False
    start = np.flatnonzero(first)
    stop = np.append(start[1:], len(chunk.raw))
    feed = chunk.raw[stop - 1] == 10 if len(start) else np.zeros(0, bool)
    stop = stop - feed  # without the line feed
    lo, hi = np.searchsorted(words.start, start), np.searchsorted(words.start, stop)
    some = hi > lo
    return start[some], stop[some], lo[some], hi[some]


def _found_twice(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which values occur twice or more in their text."""
    keys = values ^ mix(doc.astype(np.uint64))
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def _seen_before(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which values occur earlier in their text."""
    order = np.lexsort((values, doc))  # stable: the first of equals is the earliest
    v, d = values[order], doc[order]
    out = np.zeros(len(v), bool)
    out[order[1:]] = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
    return out


def text_stats(chunk: Chunk, words: Words, rules: Rules) -> dict[str, np.ndarray]:
    """The per-text counts of the base rules."""
    raw, off = chunk.raw, chunk.off
    point = (raw & 0xC0) != 0x80
    plain = raw_prefix(chunk)  # the base rules compare words and lines as they stand
    at, h = words.windows(rules.repeat_window, prefix(between(plain, words.start, words.end)))
    hit = covered(at[_found_twice(h, words.doc[at])], rules.repeat_window, len(words.start))
    s, e, _, _ = _lines(chunk, words)
    line_doc = np.searchsorted(off, s, side="right") - 1
    later = _seen_before(between(plain, s, e), line_doc)
    return {
        "n_words": words.count.astype(np.int64),
        "word_chars": per_doc(words.inside & point, off[:-1], off[1:]),
        "n_symbols": per_doc(_SYMBOL[raw], off[:-1], off[1:]),
        "n_dup_lines": np.bincount(line_doc[later], minlength=chunk.n).astype(np.int64),
        "n_repeat_words": per_doc(hit, words.lo, words.hi),
    }


def _line_hashes(chunk: Chunk, words: Words, host: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, key of host and normalised line, words, first byte) of each line with a word."""
    s, _, lo, hi = _lines(chunk, words)
    doc = np.searchsorted(chunk.off, s, side="right") - 1
    return doc, mix(between(words.sums, lo, hi) ^ mix(host[doc])), hi - lo, s


def _cut(chunk: Chunk, texts: pa.Array, doc: np.ndarray, start: np.ndarray) -> pa.Array:
    """The chunk's ``texts`` without the lines of text ``doc`` that begin at byte ``start``; null stays null."""
    if not len(doc):
        return texts
    out = texts.to_pylist()
    for d in np.unique(doc).tolist():
        gone = set((start[doc == d] - chunk.off[d]).tolist())
        at, kept = 0, []
        for line in chunk.raw[chunk.off[d]:chunk.off[d + 1]].tobytes().split(b"\n"):
            if at not in gone:
                kept.append(line)
            at += len(line) + 1
        out[d] = b"\n".join(kept).decode()
    return pa.array(out, texts.type)


def _hosts(batch: pa.RecordBatch, chunk: Chunk) -> np.ndarray:
    return batch.column(_KEY).to_numpy(zero_copy_only=False)[chunk.first:chunk.first + chunk.n].astype(np.uint64)


def line_holders(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(host, line, text_hash, doc): the distinct normalised lines of each document;
    ``line`` is a key of host and line."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc").to_numpy(zero_copy_only=False)
            hosts = b.column(_KEY).to_numpy(zero_copy_only=False)
            for c in chunks(b.column("text")):
                w = c.words(BLANKS)
                d, key, _, _ = _line_hashes(c, w, _hosts(b, c))
                own = between(raw_prefix(c), c.off[:-1], c.off[1:])
                pairs = np.unique(np.rec.fromarrays([d, key]))
                d, key = pairs.f0 + c.first, pairs.f1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hosts[d]), pa.array(key.view(np.int64)), pa.array(own[d - c.first].view(np.int64)), pa.array(ids[d])],
                    names=["host", "line", "text_hash", "doc"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), _host(docs)).filter(
        "doc IS NOT NULL").mapInArrow(lean(lines), "host long, line long, text_hash long, doc long")


def _host(docs: DataFrame, host_col: str = "source"):
    return F.xxhash64(F.col(host_col).cast("string") if host_col in docs.columns else F.lit(None).cast("string")).alias(_KEY)


def frequent_lines(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(line, first): keys of host and line above the limit, and the host's first holder.

    Texts are counted in two steps, so that a hot line is summed from partial
    counts and never gathered."""
    held = line_holders(docs, id_col, text_col).groupBy("host", "line", "text_hash").agg(F.min("doc").alias("doc"))
    counts = held.groupBy("host", "line").agg(F.count("*").alias("n"), F.min("doc").alias("first")).filter(F.col("n") > rules.min_docs)
    sizes = docs.select(_host(docs).alias("host"), F.xxhash64(text_col).alias("t")).distinct().groupBy("host").agg(F.count("*").alias("size"))
    return counts.join(sizes, "host").filter(F.col("n") * 100 > F.col("size") * rules.host_percent).select("line", "first")


def _verdict(stats: dict[str, np.ndarray], removed: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    n = stats["n_words"]
    failed = (n < rules.min_words) | (100 * stats["n_repeat_words"] > rules.max_repeat_percent * n)
    depleted = 100 * (n - removed) < rules.depleted_percent * n
    return failed, ~failed & ~depleted


def quality_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text",
                  keep_text: bool = True, clean_col: str | None = None) -> DataFrame:
    """``docs`` (with ``keep_text`` false, without the text) with the stats, ``n_removed_words``, ``base_failed``, ``kept`` and,
    if ``clean_col`` names it, the text without the removed lines.

    Two scans of the texts; only hashes of lines are shuffled.  The lines above
    the limit are broadcast if there are at most ``rules.max_broadcast_lines``;
    if there are more, they are joined to the lines of the documents."""
    spark = docs.sparkSession
    lines = stored(frequent_lines(docs, rules, id_col, text_col), "frequent-lines")
    if lines.count() <= rules.max_broadcast_lines:
        return _narrow(spark, docs, lines, rules, id_col, text_col, keep_text, clean_col)
    return _joined(docs, lines, rules, id_col, text_col, keep_text, clean_col)


def without_frequent_lines(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines above the limit cut from the text of all but their
    first holders; no document goes, and texts without such a line are as they were."""
    clean = "flowbook_clean"
    out = quality_rules(docs, rules, id_col, text_col, keep_text=False, clean_col=clean)
    return out.select(*[F.col(clean).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def _with(docs: DataFrame, scan, id_col: str, text_col: str, extra: str, keep_text: bool) -> DataFrame:
    """``docs`` with the columns that ``scan`` makes for each chunk."""
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns], _host(docs), F.col(f"`{id_col}`").cast("long").alias("flowbook_doc"))
    k = docs.columns.index(text_col)
    kept = [i for i in range(len(docs.columns)) if keep_text or i != k]
    names = [docs.columns[i] for i in kept]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(k)):
                part = b.slice(c.first, c.n)
                made = scan(b, c)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], *[pa.array(v) for v in made.values()]], names=[*names, *made])

    return own.mapInArrow(lean(add), f"{columns(docs.select(*[F.col(f'`{c}`') for c in names]))}{extra}")


_STAT_SCHEMA = ", ".join(f"{c} long" for c in STATS)


def _narrow(spark: SparkSession, docs: DataFrame, lines: DataFrame, rules: Rules, id_col: str, text_col: str, keep_text: bool, clean_col: str | None) -> DataFrame:
    got = lines.toPandas().sort_values("line")
    k = docs.columns.index(text_col)
    sent = spark.sparkContext.broadcast((got["line"].to_numpy(np.int64).view(np.uint64).copy(), got["first"].to_numpy(np.int64)))

    def scan(b: pa.RecordBatch, c: Chunk) -> dict[str, np.ndarray]:
        keys, first = sent.value
        order = np.argsort(keys)
        keys, first = keys[order], first[order]
        w = c.words(BLANKS)
        stats = text_stats(c, w, rules)
        doc, key, n, start = _line_hashes(c, w, _hosts(b, c))
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        ids = b.column("flowbook_doc")[c.first:c.first + c.n].fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        gone = (keys[at] == key) & (first[at] != ids[doc]) if len(keys) else np.zeros(len(key), bool)
        removed = np.bincount(doc[gone], weights=n[gone], minlength=c.n).astype(np.int64)
        failed, kept = _verdict(stats, removed, rules)
        clean = {clean_col: _cut(c, b.column(k).slice(c.first, c.n), doc[gone], start[gone])} if clean_col else {}
        return stats | {"n_removed_words": removed, "base_failed": failed, "kept": kept} | clean

    extra = f", `{clean_col}` string" if clean_col else ""
    return _with(docs, scan, id_col, text_col, f"{_STAT_SCHEMA}, n_removed_words long, base_failed boolean, kept boolean{extra}", keep_text)


def _joined(docs: DataFrame, lines: DataFrame, rules: Rules, id_col: str, text_col: str, keep_text: bool, clean_col: str | None) -> DataFrame:
    """The same rows where the lines above the limit are too many to broadcast."""

    def scan(b: pa.RecordBatch, c: Chunk) -> dict[str, np.ndarray]:
        w = c.words(BLANKS)
        doc, key, n, _ = _line_hashes(c, w, _hosts(b, c))
        cut = np.searchsorted(doc, np.arange(1, c.n))
        return text_stats(c, w, rules) | {
            "flowbook_lines": [x.view(np.int64) for x in np.split(key, cut)], "flowbook_counts": [x.astype(np.int64) for x in np.split(n, cut)]}

    base = stored(_with(docs, scan, id_col, text_col, f"{_STAT_SCHEMA}, flowbook_lines array<long>, flowbook_counts array<long>", keep_text or clean_col is not None).withColumn(
        "flowbook_row", F.monotonically_increasing_id()), "line-stats")
    at = base.select("flowbook_row", F.col(id_col).cast("long").alias("doc"), F.explode(F.arrays_zip("flowbook_lines", "flowbook_counts")).alias("l"))
    removed = (at.select("flowbook_row", "doc", F.col("l.flowbook_lines").alias("line"), F.col("l.flowbook_counts").alias("k"))
               .join(lines, "line").filter(~F.col("doc").eqNullSafe(F.col("first")))
               .groupBy("flowbook_row").agg(F.sum("k").alias("n_removed_words"), F.collect_set("line").alias("flowbook_gone")))
    n, gone = F.col("n_words"), F.coalesce("n_removed_words", F.lit(0))
    failed = (n < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * n)
    kept = [c for c in docs.columns if keep_text or c != text_col]
    made = [*STATS, "n_removed_words", "base_failed", "kept"]
    out = base.join(removed, "flowbook_row", "left").select(
        *[base[f"`{c}`"] for c in kept], *STATS, gone.alias("n_removed_words"), failed.alias("base_failed"),
        (~failed & ~(100 * (n - gone) < rules.depleted_percent * n)).alias("kept"),
        *([base[f"`{text_col}`"].alias("flowbook_text"), "flowbook_gone", _host(docs)] if clean_col else ()))
    if not clean_col:
        return out

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column("flowbook_text")):
                part = b.slice(c.first, c.n)
                doc, key, _, start = _line_hashes(c, c.words(BLANKS), _hosts(b, c))
                above = part.column("flowbook_gone").to_pylist()
                hit = np.zeros(len(key), bool)
                for d in (i for i, x in enumerate(above) if x):
                    lo, hi = np.searchsorted(doc, [d, d + 1])
                    hit[lo:hi] = np.isin(key[lo:hi], np.array(above[d], np.int64).view(np.uint64))
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept) + len(made)], _cut(c, part.column("flowbook_text"), doc[hit], start[hit])], names=[*kept, *made, clean_col])

    return out.mapInArrow(lean(clean), f"{columns(out.select(*[F.col(f'`{c}`') for c in [*kept, *made]]))}`{clean_col}` string")
