"""Broadcast only behind a size check.

The factor side of every lookup is market data, not contracts, so it is
usually small; but nothing bounds it by construction.  ``bounded`` measures its
rows and bytes, arrays included (two sums, one row per task), and hints a
broadcast only under both bounds.  Beyond them the callers fall back to shuffle
joins whose hot keys are salted (see ``operators.factors``), and AQE splits
skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

MAX_ROWS_CONF = "flowbook.broadcast.maxRows"
DEFAULT_MAX_ROWS = 2_000_000
MAX_BYTES_CONF = "flowbook.broadcast.maxBytes"
DEFAULT_MAX_BYTES = 256 << 20


def max_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(MAX_ROWS_CONF, str(DEFAULT_MAX_ROWS)))


def max_bytes(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(MAX_BYTES_CONF, str(DEFAULT_MAX_BYTES)))


def _width(t: DataType) -> int:
    """Bytes of one value of fixed size: eight, or a struct's sum."""
    return sum(_width(f.dataType) for f in t.fields) if isinstance(t, StructType) else 8


def _bytes(c: Column, t: DataType) -> Column:
    if isinstance(t, StringType):
        return F.lit(16) + F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(t, ArrayType):
        return F.lit(32) + F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * (_width(t.elementType) + 16)
    return F.lit(_width(t))


def fits(df: DataFrame, limit: int | None = None) -> bool:
    limit = max_rows(df) if limit is None else limit
    row = F.lit(0).cast("long")
    for f in df.schema.fields:
        row = row + _bytes(F.col(f.name), f.dataType)
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row), F.lit(0))).first()
    return rows <= limit and size <= max_bytes(df)


def bounded(df: DataFrame, limit: int | None = None) -> tuple[DataFrame, bool]:
    """(df with a broadcast hint if it has at most ``limit`` rows and is within the
    bound in bytes, whether hinted)."""
    if fits(df, limit):
        return F.broadcast(df), True
    return df, False
