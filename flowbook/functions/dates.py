"""Date arithmetic by cycle: always from the anchor (``anchor + k*n`` units), never
step by step, so month ends do not drift."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowbook.functions.parsing import unit_days, unit_months


def shift(anchor: Column, steps: Column, n: Column, unit: Column) -> Column:
    """``anchor`` moved by ``steps * n`` cycle units (negative steps move back)."""
    months = unit_months(unit)
    days = unit_days(unit)
    return (F.when(months.isNotNull(), F.add_months(anchor, steps * n * months))
            .otherwise(F.date_add(anchor, steps * n * days)))


def month_index(d: Column) -> Column:
    """Months since year 0: the bucket key of the as-of joins."""
    return F.year(d) * 12 + F.month(d) - 1
