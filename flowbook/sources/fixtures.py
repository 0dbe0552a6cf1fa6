"""The contract book, risk factors and time spec derived from the driver's tables.

The reference ships no data, so the book is computed from ``orders`` (one
contract per order) and the reference-rate series from ``lineitem``, by
integer arithmetic that DuckDB can repeat (see FIXTURES.md).  All of it is
DataFrame code over the input tables: the work grows with them.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbook.functions.steps import own_step

# Fixed values of the fixture book.
#: Contracts in a task, at least a task for each core: with their events some 100 MB.
CONTRACTS_PER_TASK = 1 << 16
FIXTURE_T0 = _dt.date(1998, 1, 1)
STATUS_DATE_TEXT = "1998-01-01T00"
PRIORITY_CYCLE = {  # order priority -> (interest cycle text, cycle in months)
    "1-URGENT": ("1M-", 1),
    "2-HIGH": ("1Q-", 3),
    "3-MEDIUM": ("1H-", 6),
    "4-NOT SPECIFIED": ("7M-", 7),
    "5-LOW": ("5M+", 5),
}
DAY_COUNTS = ["A/360", "A/365", "30E/360", "A/AISDA"]  # by k % 4
CURRENCIES = ["USD", "EUR", "CHF", "JPY"]  # by o_custkey % 4
RESET_CODES = {1: "RATE_A", 3: "RATE_N", 5: "CURVE_1"}  # by k % 6
FIXED_FACTOR_LINES = [
    "CURVE_1;x;TermStructure;1M!3M!6M!1Y!2Y!5Y!10Y;0.01!0.012!0.015!0.02!0.024!0.03!0.035",
    "IDX_1;x;ReferenceIndex;1995-01-01T00!1996-01-01T00!1997-01-01T00!1998-01-01T00!"
    "1999-01-01T00!2000-01-01T00!2001-01-01T00!1999-01-01T00!2002-01-01T00;100!102!104!107!109!111!115!108!118",
    "FX_EUR;x;ForeignExchangeRate;1995-01-01T00!1996-01-01T00!1997-01-01T00!1998-01-01T00!"
    "1999-01-01T00!2000-01-01T00!2001-01-01T00!2002-01-01T00;1.25!1.26!1.13!1.1!1.17!1!0.94!0.89",
    "FX_CHF;x;ForeignExchangeRate;1995-01-01T00!1996-01-01T00!1997-01-01T00!1998-01-01T00!"
    "1999-01-01T00!2000-01-01T00!2001-01-01T00!2002-01-01T00;0.76!0.86!0.74!0.69!0.73!0.63!0.62!0.6",
    "FX_JPY;x;ForeignExchangeRate;1995-01-01T00!1996-01-01T00!1997-01-01T00!1998-01-01T00!"
    "1999-01-01T00!2000-01-01T00!2001-01-01T00!2002-01-01T00;0.01!0.0097!0.0086!0.0077!0.0088!0.0098!0.0088!0.0076",
    "ODD_1;x;SomethingElse;1995-01-01T00;1.0",
    "BAD_1;x;ReferenceRate;1995-01-01T00!oops!1997-01-01T00;0.01!0.02!0.03",
    "UNEVEN_1;x;ReferenceIndex;1995-01-01T00!1996-01-01T00;100",
]
# An earlier line for RATE_A that the derived series must override.
SHADOWED_FACTOR_LINE = "RATE_A;x;ReferenceRate;1995-01-01T00!2002-01-01T00;0.99!0.99"
TIME_SPEC_FIRST_LINE = "1998-01-01T00;fixture"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_book_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as the source of the contract book, with at least the
    session's parallelism in partitions (H1), and more for a large book."""
    from flowbook.sources.text import ensure_min_partitions
    return ensure_min_partitions(load(spark, sf_dir, "orders"), book_partitions(spark, sf_dir))


def book_partitions(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for the book and its events, by its rows."""
    rows = load(spark, sf_dir, "orders").count()
    return max(-(-rows // CONTRACTS_PER_TASK), spark.sparkContext.defaultParallelism)


def _dtext(d: Column) -> Column:
    """A DATE as ``yyyy-MM-ddTHH`` (its hour is 00)."""
    return F.concat(d.cast("string"), F.lit("T00"))


def _num(x: Column) -> Column:
    return x.cast("double").cast("string")


def _pick(key: Column, mapping: dict, default: Column | str | None = None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    if default is not None:
        out = out.otherwise(default if isinstance(default, Column) else F.lit(default))
    return out


def _tokens(orders: DataFrame, defects: bool) -> tuple[DataFrame, list[Column]]:
    k = F.col("o_orderkey")
    d0 = F.to_date("o_orderdate")
    cyc_text = _pick(F.col("o_orderpriority"), {p: c for p, (c, _) in PRIORITY_CYCLE.items()}, "NULL")
    cyc_m = _pick(F.col("o_orderpriority"), {p: m for p, (_, m) in PRIORITY_CYCLE.items()})
    rate = (F.lit(10) + (k % 9) * 5).cast("double") / F.lit(1000).cast("double")
    t = [F.lit("x")] * 40
    t[4] = F.lit(STATUS_DATE_TEXT)
    t[5] = F.when(F.col("o_orderstatus") == "P", "RPL").otherwise("RPA")
    t[7] = F.concat(F.lit("C"), k.cast("string"))
    t[9] = F.when(k % 4 == 0, "NULL").otherwise(_dtext(F.add_months(d0, cyc_m)))
    t[10] = cyc_text
    t[11] = _num(rate)
    if defects:
        t[11] = F.when((k > 0) & (k % 997 == 0), "abc").otherwise(t[11])
    t[12] = _pick(k % 4, dict(enumerate(DAY_COUNTS)))
    t[16] = _pick(F.col("o_custkey") % 4, dict(enumerate(CURRENCIES)))
    t[17] = _dtext(F.date_sub(d0, (k % 3).cast("int")))
    t[18] = _dtext(d0)
    t[19] = _dtext(F.add_months(d0, (12 * (1 + k % 5)).cast("int")))
    t[20] = _num(F.col("o_totalprice"))
    if defects:
        t[19] = F.when((k > 0) & (k % 971 == 0), "NULL").otherwise(t[19])
        t[20] = F.when((k > 0) & (k % 977 == 0), "NaN").otherwise(t[20])
    t[21] = F.when(k % 11 == 0, _dtext(F.date_add(d0, 45))).otherwise("NULL")
    t[22] = F.when(k % 11 == 0, _num(F.col("o_totalprice"))).otherwise("NaN")
    t[23] = F.when(k % 13 == 0, _dtext(F.date_add(d0, 200))).otherwise("NULL")
    t[24] = F.when(k % 13 == 0, _num(F.col("o_totalprice"))).otherwise("NaN")
    t[25] = (F.when(k % 70 == 0, "UNEVEN_1").when(k % 30 == 0, "ODD_1").when(k % 10 == 0, "IDX_1")
             .otherwise("NULL"))
    t[26] = F.lit("100.0")
    t[30] = F.when(k % 2 == 1, _dtext(F.add_months(d0, 6))).otherwise("NULL")
    t[31] = F.when(k % 2 == 1, "6M-").otherwise("NULL")
    t[32] = _num((k % 3).cast("double") / F.lit(1000).cast("double"))
    t[33] = (F.when(k % 101 == 0, "MISSING").when(k % 103 == 0, "BAD_1").when(k % 107 == 0, "ODD_1")
             .otherwise(_pick(k % 6, RESET_CODES, "NULL")))
    t[34] = F.when(k % 4 == 1, "E").otherwise("B")
    t[35] = F.lit("2D")
    t[36] = F.when(k % 7 == 0, "0.03").otherwise("NaN")
    t[37] = F.lit("1.0")
    t[38] = F.lit("6M")
    t[39] = _num((-10 * (k % 5)).cast("double"))
    return orders, t


def contract_lines(orders: DataFrame, layout: str = "full", defects: bool = False) -> DataFrame:
    """The fixture book as text lines ``(line_no, value)``, one per order.

    ``defects=True`` adds the parser test rows: ``k%997=0`` rate ``abc``,
    ``k%991=0`` line cut after 20 tokens, ``k%983=0`` trailing ``;;;``,
    ``k%977=0`` notional ``NaN``, ``k%971=0`` maturity ``NULL``.
    """
    _, t = _tokens(orders, defects)
    if layout == "short":
        # 0-12 as in the full layout, 13-16 unread, 17-21 currency .. notional.
        t = t[:13] + [F.lit("x")] * 4 + [t[16], t[17], t[18], t[19], t[20]]
    k, arr = F.col("o_orderkey"), F.col("_t")
    orders = orders.select(own_step("o_orderkey", orders.schema["o_orderkey"].dataType.simpleString()), F.array(*t).alias("_t"))
    if defects:
        arr = F.when((k > 0) & (k % 991 == 0), F.slice(arr, 1, 20)).otherwise(arr)
    value = F.array_join(arr, ";")
    if defects:
        value = F.when((k > 0) & (k % 983 == 0), F.concat(value, F.lit(";;;"))).otherwise(value)
    return orders.select(k.alias("line_no"), value.alias("value"))


def factor_lines(spark: SparkSession, lineitem: DataFrame) -> DataFrame:
    """Risk-factor lines ``(line_no, value)``: three reference-rate series from
    ``lineitem`` (mean discount per return flag and ship month), a shadowed
    earlier ``RATE_A`` line, a curve, an index (one date twice), three FX series,
    a line of an unknown type and two lines that do not read."""
    month = F.trunc(F.to_date("l_shipdate"), "month")
    pts = (lineitem.groupBy("l_returnflag", month.alias("m"))
           .agg((F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).cast("double")
                 / (F.count(F.lit(1)) * 100).cast("double")).alias("v")))
    # One line per series: the points of one code are bounded by its months.
    series = (pts.groupBy("l_returnflag")
              .agg(F.array_sort(F.collect_list(F.struct("m", "v"))).alias("p")))
    rate_lines = series.select(
        (F.lit(1) + F.ascii("l_returnflag")).cast("bigint").alias("line_no"),
        F.concat_ws(";", F.concat(F.lit("RATE_"), F.col("l_returnflag")), F.lit("x"),
                    F.lit("ReferenceRate"),
                    F.array_join(F.transform("p", lambda x: _dtext(x["m"])), "!"),
                    F.array_join(F.transform("p", lambda x: x["v"].cast("string")), "!")).alias("value"))
    fixed = [(0, SHADOWED_FACTOR_LINE)] + [(1000 + i, s) for i, s in enumerate(FIXED_FACTOR_LINES)]
    fixed_df = spark.createDataFrame(fixed, "line_no bigint, value string")
    return rate_lines.unionByName(fixed_df)


def time_spec_lines(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """Time-spec lines: a first line with the fixture t0, then one per order
    (``date;priority;status``, every 7th only separators)."""
    k = F.col("o_orderkey")
    body = F.when(k % 7 == 0, F.lit(";;")).otherwise(
        F.concat_ws(";", _dtext(F.to_date("o_orderdate")), F.col("o_orderpriority"), F.col("o_orderstatus")))
    first = spark.createDataFrame([(-1, TIME_SPEC_FIRST_LINE)], "line_no bigint, value string")
    return first.unionByName(orders.select(k.alias("line_no"), body.alias("value")))


FILES = ("contracts", "short", "factors", "time")


def write_files(spark: SparkSession, sf_dir: str, folder: str, defects: bool = False, names: tuple[str, ...] = FILES, compression: str = "none") -> dict[str, str]:
    """The fixture as text files under ``folder``: contracts in both layouts, factor lines
    and time spec, the latter two in the order of their lines over their files.  ``names``:
    those wanted.  A compressed file is read whole by a task, which reads as much as one wrote."""
    orders = load_book_source(spark, sf_dir)
    paths = {name: f"{folder}/{name}" for name in names}
    write = lambda lines, name: lines.select("value").write.option("compression", compression).text(paths[name])
    if "contracts" in names:
        write(contract_lines(orders, defects=defects), "contracts")
    if "short" in names:
        write(contract_lines(orders, layout="short"), "short")
    if "factors" in names:
        write(in_order(factor_lines(spark, load(spark, sf_dir, "lineitem")), 4), "factors")
    if "time" in names:
        write(in_order(time_spec_lines(spark, load(spark, sf_dir, "orders")), max(4, book_partitions(spark, sf_dir))), "time")
    return paths


def in_order(lines: DataFrame, files: int) -> DataFrame:
    """Lines in their order over ``files`` partitions."""
    return lines.repartitionByRange(files, "line_no").sortWithinPartitions("line_no")
