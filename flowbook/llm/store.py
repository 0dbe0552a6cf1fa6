"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where it is unset, a local master
    (tests) gets a folder of its own; any other master is an error, since a
    machine-local folder is not shared by the executors."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="flowbook-llm-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def shared_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new place in the shared folder; with ``keep`` it is known to ``release``."""
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    if keep:
        _MADE.append(path)
    return path


def dropped(spark: SparkSession, path: str) -> None:
    """Removes an intermediate table of ours that nothing reads again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Places of the stored tables that have not been released, in order.
_MADE: list[str] = []


def mark() -> int:
    """A moment for ``release``."""
    return len(_MADE)


def release(spark: SparkSession, since: int, until: int) -> None:
    """Removes what was stored between two moments; nothing may read it any more."""
    for path in _MADE[since:until]:
        dropped(spark, path)
    del _MADE[since:until]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as parquet to the shared folder and read again: its lineage
    is cut, a lost executor re-reads files, and a second use costs a scan."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Free memory that Arrow and the C library hold back goes to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, and ``give_back`` once its task is over: Python workers
    outlive their tasks, and each would keep the most that any task took."""
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def lean_group(run: Callable) -> Callable:
    """``run`` for ``applyInArrow`` with one table or two, and ``give_back`` after each group."""
    two = len(inspect.signature(run).parameters) == 2  # Spark goes by the number of parameters

    def one_table(rows: pa.Table) -> pa.Table:
        out = run(rows)
        give_back()
        return out

    def two_tables(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        give_back()
        return out

    return two_tables if two else one_table


def columns(df: DataFrame) -> str:
    """``df``'s columns as the beginning of a schema string."""
    return "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in df.schema.fields)
