"""Text sources.

Any Hadoop-compatible path works (``hdfs://``, ``s3a://``, local); the readers
only add a ``line_no`` that rises in file order (by path, then by place in the
file), which the factor dedup (J1) and the analysis-date rule (S3) need.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbook.functions import parsing as P


def read_lines(spark: SparkSession, path: str | list[str], min_partitions: int | None = None) -> DataFrame:
    """One row per text line: ``line_no, value STRING``.

    ``line_no`` is a struct (path, start of the split, counter) whose order is the
    order of files by path and of lines in them, whatever tasks read them: a task
    reads a split from its start, and splits are packed into tasks by size.
    ``min_partitions`` (H1) spreads the lines round-robin if the scan has fewer.
    """
    df = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("n"))
    lines = df.select(place.alias("line_no"), "value")
    return ensure_min_partitions(lines, min_partitions) if min_partitions else lines


#: Bytes of text from a byte of a compressed file (contract lines by gzip: 6.5).
TEXT_PER_COMPRESSED_BYTE = 6


def input_bytes(spark: SparkSession, path: str | list[str]) -> int:
    """Bytes of text in the files at ``path`` (patterns allowed), from their file system's
    metadata; a compressed file, told by its name, counts ``TEXT_PER_COMPRESSED_BYTE`` times."""
    conf, total = spark._jsc.hadoopConfiguration(), 0
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    for p in [path] if isinstance(path, str) else path:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = where.getFileSystem(conf)
        for x in fs.globStatus(where) or []:
            files = fs.listFiles(x.getPath(), True)
            while files.hasNext():
                f = files.next()
                total += f.getLen() * (TEXT_PER_COMPRESSED_BYTE if codecs.getCodec(f.getPath()) else 1)
    return total


def ensure_min_partitions(df: DataFrame, n: int | None = None) -> DataFrame:
    """H1: at least ``n`` partitions (default: the session's default parallelism).

    A text file is split by size, but a small parquet file may be a single
    row group, i.e. one task for everything before the first exchange.  Only
    then spread it round-robin; an input with enough splits (any large one)
    is returned unchanged, with no extra exchange.
    """
    n = n or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def analysis_date_tokens(lines: DataFrame) -> DataFrame:
    """Every ``;`` token of every time-spec line with its place."""
    return lines.select(
        "line_no", F.posexplode(P.java_split(F.col("value"))).alias("pos", "token"))


def analysis_date(lines: DataFrame) -> DataFrame:
    """S3: one row ``t0 DATE``: the first non-empty token over all lines, in line order.

    A global ``min_by`` (partial aggregation per task, one row to merge), not a
    sort or a collect.
    """
    toks = analysis_date_tokens(lines).filter(F.trim("token") != "")
    first = toks.agg(F.min_by("token", F.struct("line_no", "pos")).alias("t0_text"))
    return first.select(P.parse_date(F.col("t0_text")).alias("t0"))


def read_analysis_date(spark: SparkSession, path: str) -> _dt.date:
    """S3 as a driver scalar (one value), so later plans fold it as a literal.

    Raises when no token parses as a date (the reference printed and went on
    with an empty date).
    """
    row = analysis_date(read_lines(spark, path)).first()
    if row is None or row["t0"] is None:
        raise ValueError(f"no analysis date in {path}")
    return row["t0"]


def to_date_value(t0) -> _dt.date:
    """An analysis date given as ``date``/``datetime`` or text (``2015-04-01T00``)."""
    if isinstance(t0, _dt.datetime):
        return t0.date()
    if isinstance(t0, _dt.date):
        return t0
    return _dt.date.fromisoformat(str(t0)[:10])
