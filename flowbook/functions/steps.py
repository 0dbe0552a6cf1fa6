"""Projections that are steps of their own.

Spark joins neighbouring operators into one generated method.  The JVM does not compile
a method of over 8,000 bytes of code: it is interpreted, row by row, at a tenth of the
speed.  A projection with a function that has no generated code (``from_json``) stays out
of the joint method and gets its own code, cut into short methods.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def own_step(name: str, kind: str) -> Column:
    """Column ``name`` (of type ``kind``) as it is; the projection that selects it becomes a step of its own.
    It should be a column that is always needed and can be NULL, and no key that the rows are
    dealt by.  The function is run for NULL only, and gives NULL."""
    c = F.col(name)
    return F.coalesce(c, F.get(F.from_json(c.cast("string"), "array<string>"), F.lit(0)).cast(kind)).alias(name)


def but(columns: list[str], *names: str) -> list[str]:
    return [c for c in columns if c not in names]
