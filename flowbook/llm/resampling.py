"""Importance resampling towards a target distribution (op13).

An untrained ``Split`` of ``tokenizers`` cuts the text, A-Z in lower case, into
words with their offsets.  A feature is a run of 1 to ``max_words`` consecutive
words joined by one space; neighbouring offset pairs give its windows, and the
CRC-32 of its bytes modulo ``buckets`` its bucket.  The texts are cut once: each
document keeps its buckets as packed integers, the histograms of the raw and of
the target texts are partial sums of every task, and a document's weight is the
sum of its buckets' gains.  Gumbel noise that follows from ``doc_id`` turns the
highest scores into a draw without replacement.

Ranks are given by key range: rows are dealt by (score, doc_id), counted range by
range, and numbered inside theirs from the number of rows above it, so no task
sees all rows.  Only the ranges' counts and the gains (``buckets`` numbers) reach
the driver.

Null text has no words.  A null doc_id draws its noise from the empty string and
ties after all others; equal doc_ids are documents of their own.  Tables without
rows, of either kind, count as nothing.  Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from flowbook.llm.store import shuffle_parts, stored

#: Fixed value: what stands between words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, SEED, PERCENT, MIN_WORDS = 10_000, 2024, 10, 20
_LOWER = {i: i + 32 for i in range(0x41, 0x5B)}
#: Words whose bucket a task remembers at once.
_KNOWN = 1 << 19


class Cutter:
    """Texts to buckets of their features."""

    def __init__(self, max_words: int, buckets: int):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split, self.max_words, self.buckets, self.known = Split(Regex(SEPARATORS), "removed"), max_words, buckets, {}

    def words(self, text: str | None) -> list[tuple[str, tuple[int, int], None]]:
        """(word, byte offsets in the lower-cased text, None) in order."""
        from tokenizers import PreTokenizedString

        p = PreTokenizedString((text or "").translate(_LOWER))
        self.split.pre_tokenize(p)
        return p.get_splits(offset_referential="normalized", offset_type="byte")

    def bucket(self, word: str) -> int:
        b = self.known.get(word)
        if b is None:
            if len(self.known) >= _KNOWN:
                self.known.clear()
            b = self.known[word] = zlib.crc32(word.encode()) % self.buckets
        return b

    def features(self, text: str | None) -> tuple[int, np.ndarray]:
        """(words, buckets of all features of the text)."""
        found = self.words(text)
        if self.max_words == 1:
            return len(found), np.fromiter((self.bucket(w[0]) for w in found), np.uint32, len(found))
        words = [w[0] for w in found]
        runs = [self.bucket(" ".join(words[i:i + n])) for n in range(1, self.max_words + 1) for i in range(len(words) - n + 1)]
        return len(found), np.array(runs, np.uint32)


def cut(df: DataFrame, text_col: str, keys: list[str], max_words: int, buckets: int) -> DataFrame:
    """``keys``, ``n_words``, ``n_features`` and ``buckets`` (32-bit little-endian numbers) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(max_words, buckets)
        for batch in batches:
            cut = [cutter.features(t) for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keys)], pa.array([n for n, _ in cut], pa.int64()), pa.array([len(b) for _, b in cut], pa.int64()),
                 pa.array([b.astype("<u4").tobytes() for _, b in cut], pa.binary())], names=[*keys, "n_words", "n_features", "buckets"])

    rows = df.select(*keys, F.col(text_col).cast("string").alias("_text"))
    types = "".join(f"`{k}` {t}, " for k, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{types}n_words long, n_features long, buckets binary")


def histogram(features: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket, over all rows: every task sends its own sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in batch.column(0):
                total += np.bincount(np.frombuffer(b.as_py(), "<u4"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: floor(1000 ln of the smoothed target share over the smoothed raw share)."""
    size, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t + 1) * float(s_all + size)) / (float(s + 1) * float(t_all + size))))
                     for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(features: DataFrame, gain: np.ndarray, key: str) -> DataFrame:
    """``key, n_words, n_features, weight``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [int(gain[np.frombuffer(b.as_py(), "<u4")].sum()) for b in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(w, pa.int64())], names=[key, "n_words", "n_features", "weight"])

    kind = features.schema[key].dataType.simpleString()
    return features.select(key, "n_words", "n_features", "buckets").mapInArrow(run, f"`{key}` {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256(``seed:doc_id``)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000) * F.log(-F.log(u))).cast("long")


def ranked(scored: DataFrame, draw: int, doc_id: str = "doc_id") -> DataFrame:
    """``rank`` 1, 2, .. of the ``draw`` rows of highest ``score``, ties to the smaller ``doc_id``; null for the rest."""
    order = [F.col("score").desc(), F.col(doc_id).asc_nulls_last()]
    dealt = stored(scored.repartitionByRange(shuffle_parts(scored.sparkSession), *order).select("*", F.spark_partition_id().alias("_range")), "ranges")
    above, first = 0, {}
    for r in dealt.groupBy("_range").count().orderBy("_range").collect():
        first[r["_range"]], above = above, above + r["count"]
    if not first:
        return dealt.select("*", F.lit(None).cast("long").alias("rank")).drop("_range")
    at = F.element_at(F.create_map(*[x for k, v in first.items() for x in (F.lit(k), F.lit(v).cast("long"))]), F.col("_range"))
    place = at + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.select("*", F.when(place <= draw, place.cast("long")).alias("rank")).drop("_range")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = PERCENT,
             min_words: int = MIN_WORDS, max_words: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document: ``doc_id, n_words, n_features, weight, score, rank``; ``rank``
    is set for the drawn, ``percent`` of the documents of ``min_words`` words or more."""
    raw = stored(cut(docs, text_col, [doc_id], max_words, buckets), "features")
    gain = gains(histogram(raw, buckets), histogram(cut(target, target_text, [], max_words, buckets), buckets))
    scored = stored(weighted(raw, gain, doc_id).withColumn("score", F.col("weight") + noise(F.col(doc_id), seed)), "weights")
    able = scored.filter(F.col("n_words") >= min_words)
    draw = percent * able.count() // 100
    out = ranked(able, draw, doc_id).unionByName(scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(doc_id, "n_words", "n_features", "weight", "score", "rank")
