"""The library's date rules as SQL functions, for queries over a view.

They are SQL-defined (``CREATE TEMPORARY FUNCTION .. RETURN``): a call is inlined
into the query's plan as built-in expressions, with no UDF and no row-wise code.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_LEN = "datediff(make_date({y} + 1, 1, 1), make_date({y}, 1, 1))"


def _year_fraction() -> str:
    days, y1, y2 = "CAST(datediff(d2, d1) AS DOUBLE)", "year(d1)", "year(d2)"
    thirty = "CAST((year(d2) - year(d1)) * 360 + (month(d2) - month(d1)) * 30 + least(day(d2), 30) - least(day(d1), 30) AS DOUBLE) / 360D"
    head = f"CAST(datediff(make_date({y1} + 1, 1, 1), d1) AS DOUBLE) / CAST({_LEN.format(y=y1)} AS DOUBLE)"
    tail = f"CAST(datediff(d2, make_date({y2}, 1, 1)) AS DOUBLE) / CAST({_LEN.format(y=y2)} AS DOUBLE)"
    return f"""CASE dcc WHEN 'A/360' THEN {days} / 360D WHEN 'A/365' THEN {days} / 365D WHEN '30E/360' THEN {thirty}
      WHEN 'A/AISDA' THEN CASE WHEN {y1} = {y2} THEN {days} / CAST({_LEN.format(y=y1)} AS DOUBLE)
                               ELSE {head} + CAST({y2} - {y1} - 1 AS DOUBLE) + {tail} END END"""


#: Name -> (parameters, type, body).
FUNCTIONS = {
    "fb_year_fraction": ("d1 DATE, d2 DATE, dcc STRING", "DOUBLE", _year_fraction()),
    "fb_cycle_n": ("cycle STRING", "INT", r"try_cast(nullif(regexp_extract(cycle, '^P?(\\d+)([DWMQHY])(L?[-+01]?)$', 1), '') AS INT)"),
    "fb_cycle_unit": ("cycle STRING", "STRING", r"nullif(regexp_extract(cycle, '^P?(\\d+)([DWMQHY])(L?[-+01]?)$', 2), '')"),
    "fb_cycle_date": ("anchor DATE, k INT, cycle STRING", "DATE", """CASE fb_cycle_unit(cycle)
      WHEN 'D' THEN date_add(anchor, k * fb_cycle_n(cycle)) WHEN 'W' THEN date_add(anchor, 7 * k * fb_cycle_n(cycle))
      WHEN 'M' THEN add_months(anchor, k * fb_cycle_n(cycle)) WHEN 'Q' THEN add_months(anchor, 3 * k * fb_cycle_n(cycle))
      WHEN 'H' THEN add_months(anchor, 6 * k * fb_cycle_n(cycle)) WHEN 'Y' THEN add_months(anchor, 12 * k * fb_cycle_n(cycle)) END"""),
    "fb_role_sign": ("role STRING", "INT", "CASE role WHEN 'RPA' THEN 1 WHEN 'RPL' THEN -1 END"),
}


def register(spark: SparkSession) -> list[str]:
    """Define the functions in the session; their names."""
    for name, (params, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
