"""Connected components by alternating large and small stars, as joins and
pre-aggregated minima; nothing is gathered by node or on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbook.llm.store import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``edges`` (a, b): component is the smallest node reachable."""
    now = stored(_down(edges, "a", "b"), "edges")
    state = _state(now)
    while state[0]:
        sym = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _down(sym.filter("b > a").join(least, "a"), "b", "m")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = stored(_down(small.select("b", "m").union(low.select("a", "m")), "b", "m"), "edges")
        state, before = _state(now), state
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _down(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct edges, the larger node first, without loops."""
    return df.filter(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()


def _state(df: DataFrame) -> tuple:
    r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]
