"""Column expressions that read the contract and risk-factor text formats.

Fixed values (formats and patterns of the input files):
  field separator ``;``, array separator ``!``, missing-value token ``NULL``,
  date text ``yyyy-MM-dd'T'HH`` (for example ``2015-04-01T00``),
  cycle text ``[P]<n><unit>[L][stub]`` with unit one of D W M Q H Y and
  stub ``-`` / ``L1`` (short) or ``+`` / ``L0`` (long).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the text formats.
FIELD_SEP = ";"
ARRAY_SEP = "!"
NULL_TOKEN = "NULL"
DATE_TEXT_FORMAT = "yyyy-MM-dd'T'HH"
CYCLE_PATTERN = r"^P?(\d+)([DWMQHY])(L?[-+01]?)$"
PERIOD_PATTERN = r"^P?(\d+)([DWMQHY])()$"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}(T([01]\d|2[0-3])(:[0-5]\d){0,2})?$"
LONG_STUBS = ("+", "L0")
#: Stands between the parts of a cycle text once it is cut; no token of a line holds it.
_CUT = "\u0001"


def java_split(text: Column, sep: str = FIELD_SEP) -> Column:
    """Split like ``String.split``: trailing empty tokens are dropped, so a line of
    separators only has no token, and an empty line has one empty token.

    Spark's ``split`` keeps them, so separators at the end are trimmed first.
    """
    trimmed = F.when(F.endswith(text, F.lit(sep)), F.rtrim(text, F.lit(sep))).otherwise(text)
    return F.when((trimmed == "") & (text != ""), F.array().cast("array<string>")).otherwise(F.split(trimmed, re.escape(sep)))


def token(tokens: Column, i: int) -> Column:
    """Token ``i`` (0-based) or NULL when the line is too short."""
    return F.get(tokens, F.lit(i))


def is_null_token(x: Column) -> Column:
    """True for a missing, empty or ``NULL`` token."""
    return x.isNull() | (F.trim(x) == "") | (x == NULL_TOKEN)


def null_if_token(x: Column) -> Column:
    return F.when(~is_null_token(x), x)


def parse_double(x: Column) -> Column:
    """Text to double; NULL when it does not parse (``NULL`` does not)."""
    return x.try_cast("double")


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def parse_date(x: Column) -> Column:
    """``yyyy-MM-ddTHH`` (or ISO date) text to DATE; NULL when unparseable.

    Spark's date cast reads ``yyyy-MM-dd`` followed by ``T`` and any text, and
    parts of a date; the pattern admits whole dates with or without a time only.
    """
    return F.when(x.rlike(DATE_PATTERN), x.try_cast("date"))


def cycle_parts(x: Column, pattern: str = CYCLE_PATTERN) -> Column:
    """A cycle text cut into its parts by one regular expression: an array of four,
    read with ``n_of``, ``unit_of``, ``stub_of``, and of one (the text) when it is no cycle.

    Kept as a column, it is computed once a row, whatever is read from it."""
    return F.split(F.regexp_replace(x, pattern, f"{_CUT}$1{_CUT}$2{_CUT}$3"), _CUT)


def period_parts(x: Column) -> Column:
    """The same for a period text, a cycle text without stub."""
    return cycle_parts(x, PERIOD_PATTERN)


def n_of(parts: Column) -> Column:
    return F.get(parts, F.lit(1)).try_cast("int")


def unit_of(parts: Column) -> Column:
    return F.get(parts, F.lit(2))


def stub_of(parts: Column) -> Column:
    return F.get(parts, F.lit(3))


def is_cut(parts: Column) -> Column:
    """The text was a cycle (a period)."""
    return F.size(parts) == 4


def cycle_n(x: Column) -> Column:
    return n_of(cycle_parts(x))


def cycle_unit(x: Column) -> Column:
    return unit_of(cycle_parts(x))


def cycle_stub(x: Column) -> Column:
    """The stub text ('' when the cycle has none); NULL when the text is no cycle."""
    return stub_of(cycle_parts(x))


def is_long(parts: Column) -> Column:
    return F.coalesce(stub_of(parts).isin(*LONG_STUBS), F.lit(False))


def cycle_is_long(x: Column) -> Column:
    return is_long(cycle_parts(x))


def period_n(x: Column) -> Column:
    return n_of(period_parts(x))


def period_unit(x: Column) -> Column:
    return unit_of(period_parts(x))


def unit_months(unit: Column) -> Column:
    """Months per cycle unit (NULL for day units)."""
    return (F.when(unit == "M", 1).when(unit == "Q", 3)
            .when(unit == "H", 6).when(unit == "Y", 12))


def unit_days(unit: Column) -> Column:
    """Days per cycle unit (NULL for month units)."""
    return F.when(unit == "D", 1).when(unit == "W", 7)


def period_years(text: Column) -> Column:
    """Period text (curve tenor, rate term) as a year fraction: n months / 12, n days / 365."""
    return years_of(period_parts(text))


def years_of(parts: Column) -> Column:
    n = n_of(parts).cast("double")
    unit = unit_of(parts)
    return F.coalesce(n * unit_months(unit).cast("double") / F.lit(12.0),
                      n * unit_days(unit).cast("double") / F.lit(365.0))
