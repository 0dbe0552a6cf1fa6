"""Sinks and SQL access (K1-K6, H3)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbook.operators.assemble import NESTED_FIELDS


def row_text(nested: DataFrame, decimals: int | None = None) -> DataFrame:
    """K1: one printable line per contract: the seven arrays as ``[a,b,..]``
    joined by ``;``, doubles in full or with ``decimals``.  Spark's text sink
    takes strings only, so arrays are rendered first."""
    parts = []
    for f in NESTED_FIELDS:
        col = F.col(f)
        if f in ("value", "nominal", "accrued"):
            col = col.cast("array<string>") if decimals is None else F.transform(col, lambda x: F.format_string(f"%.{decimals}f", x))
        parts.append(F.concat(F.lit("["), F.array_join(col, ",", "null"), F.lit("]")))
    return nested.select(F.concat_ws(";", *parts).alias("line"))


def id_text(nested: DataFrame) -> DataFrame:
    """K6: the id array of each contract as one text line."""
    return nested.select(F.array_join("id", ",").alias("line"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """The lines of ``row_text`` read back to the seven arrays (ids hold no comma or semicolon)."""
    lines = spark.read.text(path).select(F.split("value", ";").alias("p"))
    inner = lambda i: F.substring(F.get("p", F.lit(i)), F.lit(2), F.length(F.get("p", F.lit(i))) - 2)
    items = lambda i: F.when(inner(i) == "", F.array().cast("array<string>")).otherwise(F.split(inner(i), ","))
    kinds = {f: "array<double>" if f in ("value", "nominal", "accrued") else "array<string>" for f in NESTED_FIELDS}
    return lines.select(*[items(i).try_cast(kinds[f]).alias(f) for i, f in enumerate(NESTED_FIELDS)])


def write_text(nested: DataFrame, path: str, compression: str | None = None) -> None:
    """K1: the lines of ``row_text``, files compressed by a codec of Spark's text writer (``gzip``)
    or by its default; readers go by the files' names.  A line repeats its id, dates and amounts."""
    writer = row_text(nested).write.mode("errorifexists")
    (writer.option("compression", compression) if compression else writer).text(path)


def write_parquet(nested: DataFrame, path: str) -> None:
    """K2: with the schema; fails if the path exists, as the reference's default."""
    nested.write.mode("errorifexists").parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for materialised intermediates:
    ``spark.checkpoint.dir`` from the session.  Where it is unset, a local master
    (tests) gets a folder of its own; on a cluster that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile
        d = tempfile.mkdtemp(prefix="flowbook-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


#: Places of the tables that ``materialise`` wrote, in order, and have not been released.
_MADE: list[str] = []


def materialise(df: DataFrame, name: str = "events") -> DataFrame:
    """Write ``df`` as parquet under the shared folder and read it back: cuts
    the lineage so a lost executor recomputes from the files, not the plan.
    ``release`` removes the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flowbook-{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    write_parquet(df, path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A moment for ``release``."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove the tables materialised after the moment ``since`` (``mark``); what is
    derived from them can't be computed any more."""
    conf = spark._jsc.hadoopConfiguration()
    for path in _MADE[since:]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    del _MADE[since:]


def count_events_view(spark: SparkSession, view: str = "events") -> DataFrame:
    """K4: ``SELECT COUNT(*)`` over the nested view = number of contracts."""
    return spark.sql(f"SELECT COUNT(*) AS n FROM {view}")
