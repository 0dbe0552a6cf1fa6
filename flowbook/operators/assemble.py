"""Flat events <-> one row per contract with seven parallel arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbook.operators.state import contract_key

EVENT_COLUMNS = ["contract_id", "event_date", "seq", "type", "currency", "value", "nominal", "accrued"]
NESTED_FIELDS = ["id", "date", "type", "currency", "value", "nominal", "accrued"]


def date_text(d: Column) -> Column:
    """Event date as text, ``yyyy-MM-ddT00:00Z`` [D: the exact text of the
    reference's date library is not in the checkout]."""
    return F.concat(d.cast("string"), F.lit("T00:00Z"))


def nest(events: DataFrame) -> DataFrame:
    """One row per contract, arrays in event order.

    Takes all events of every contract (with ``reported``), so a contract with
    nothing to report still gets a row with empty arrays, without a join.
    One row per input line: lines that share an id stay apart, and a rejected
    line has empty arrays.  Grouping reuses the partitioning of the windows; ids and
    dates are rendered before it, and a field of the gathered events is an array as
    it stands.  Events arrive in order, so the sort of a contract's list only checks.
    """
    e = F.when(F.col("reported"), F.struct(
        F.col("event_date").alias("d"), F.col("seq").alias("seq"), F.col("contract_id").alias("id"),
        date_text(F.col("event_date")).alias("date"), *NESTED_FIELDS[2:]))
    key = contract_key(events)
    g = events.select(*key, e.alias("e")).groupBy(*key).agg(F.sort_array(F.collect_list("e")).alias("ev"))
    return g.select(*[F.col(f"ev.{f}").alias(f) for f in NESTED_FIELDS])


def flatten(nested: DataFrame) -> DataFrame:
    """Back to one row per event (``inline`` of the zipped arrays), with the
    position in the contract as ``idx``."""
    z = F.arrays_zip(*[F.col(c) for c in NESTED_FIELDS])
    return nested.select(F.posexplode(z).alias("idx", "e")).select(
        "idx", *[F.col("e")[c].alias(c) for c in NESTED_FIELDS])
