"""Year fraction between two dates per day-count convention.

Fixed values: the convention codes ``A/360``, ``A/365``, ``30E/360``, ``A/AISDA``.
Any other code gives NULL (and is rejected when the contract is parsed).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day-count convention codes.
DAY_COUNT_CODES = ("A/360", "A/365", "30E/360", "A/AISDA")


def _year_len(y: Column) -> Column:
    return F.datediff(F.make_date(y + 1, F.lit(1), F.lit(1)), F.make_date(y, F.lit(1), F.lit(1)))


def year_fraction(d1: Column, d2: Column, dcc: Column, codes: Sequence = DAY_COUNT_CODES) -> Column:
    """``codes``: what stands for ``DAY_COUNT_CODES`` in ``dcc``, in their order."""
    days = F.datediff(d2, d1).cast("double")
    y1, y2 = F.year(d1), F.year(d2)
    e30 = ((y2 - y1) * 360 + (F.month(d2) - F.month(d1)) * 30
           + (F.least(F.dayofmonth(d2), F.lit(30)) - F.least(F.dayofmonth(d1), F.lit(30)))
           ).cast("double") / F.lit(360.0)
    head = (F.datediff(F.make_date(y1 + 1, F.lit(1), F.lit(1)), d1).cast("double")
            / _year_len(y1).cast("double"))
    tail = (F.datediff(d2, F.make_date(y2, F.lit(1), F.lit(1))).cast("double")
            / _year_len(y2).cast("double"))
    aisda = (F.when(y1 == y2, days / _year_len(y1).cast("double"))
             .otherwise(head + (y2 - y1 - 1).cast("double") + tail))
    return (F.when(dcc == codes[0], days / F.lit(360.0))
            .when(dcc == codes[1], days / F.lit(365.0))
            .when(dcc == codes[2], e30)
            .when(dcc == codes[3], aisda))
