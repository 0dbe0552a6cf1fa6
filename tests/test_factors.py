"""Risk factors: dedup, unknown types, as-of edges, curve interpolation, fallback path."""

import datetime as dt

from pyspark.sql import functions as F

from flowbook.operators import broadcast as B
from flowbook.operators import factors as FX

LINES = [
    "A;x;ReferenceRate;2015-01-01T00!2015-03-01T00;0.01!0.02",
    "C;x;TermStructure;1M!1Y;0.01!0.02",
    "A;x;ReferenceRate;2015-01-01T00!2015-02-01T00!2015-06-01T00;0.03!0.04!0.05",
    "Z;x;SomethingElse;2015-01-01T00;1",
]


def tables(spark, lines_df):
    return FX.FactorTables(lines_df(LINES))


def test_dedup_last_line_wins_and_unknown_type_ignored(spark, lines_df):
    d = {r.code: r for r in FX.dedup(FX.factor_records(lines_df(LINES))).collect()}
    assert d["A"].line_no == 2 and len(d["A"].keys) == 3
    pts = FX.factor_points(lines_df(LINES))
    assert sorted({r.code for r in pts.collect()}) == ["A", "C"]


def probe(spark, lines_df, dates, code="A"):
    f = tables(spark, lines_df)
    m = f.meta.filter(F.col("code") == code).first()
    df = spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "id int, at date")
    out = FX.asof_value(df, f, F.lit(code), F.col("at"), F.lit(m.first_date), F.lit(m.last_date),
                        F.lit(m.last_value), "v", spread_key=F.col("id"))
    return [r.v for r in out.orderBy("id").collect()]


def test_asof_edges(spark, lines_df):
    got = probe(spark, lines_df, [dt.date(2014, 12, 31), dt.date(2015, 1, 1), dt.date(2015, 1, 31),
                                  dt.date(2015, 2, 1), dt.date(2015, 5, 31), dt.date(2015, 6, 1),
                                  dt.date(2030, 1, 1)])
    assert got == [None, 0.03, 0.03, 0.04, 0.04, 0.05, 0.05]


def test_asof_without_broadcast_matches(spark, lines_df):
    spark.conf.set(B.MAX_ROWS_CONF, "0")
    try:
        assert not tables(spark, lines_df).intervals_broadcast
        got = probe(spark, lines_df, [dt.date(2014, 12, 31), dt.date(2015, 2, 15), dt.date(2030, 1, 1)])
    finally:
        spark.conf.unset(B.MAX_ROWS_CONF)
    assert got == [None, 0.04, 0.05]


def test_curve_interpolation(spark, lines_df):
    f = tables(spark, lines_df)
    curve = f.meta.filter("code = 'C'").select("curve")
    r = curve.select(*[FX.curve_rate(F.col("curve"), F.lit(t)).alias(f"t{i}")
                       for i, t in enumerate([0.0, 1 / 12, 6.5 / 12, 1.0, 3.0])]).first()
    assert r.t0 == 0.01 and r.t1 == 0.01 and abs(r.t2 - 0.015) < 1e-12 and r.t3 == 0.02 and r.t4 == 0.02


def test_hot_code_spreads_over_month_keys(spark, lines_df):
    """One code for every probe (a third of a book or all of it): the shuffle
    path joins on (code, month), so the hot code is split by month."""
    dates = [dt.date(2000, 1, 1) + dt.timedelta(days=30 * i) for i in range(60)]
    line = "HOT;x;ReferenceRate;" + "!".join(d.isoformat() + "T00" for d in dates) + ";" + \
        "!".join(str(0.01 + i / 1000) for i in range(60))
    probes = spark.range(0, 3000).select(
        F.col("id"), F.date_add(F.lit(dt.date(1999, 12, 1)), (F.col("id") % 1900).cast("int")).alias("at"))

    def run():
        f = FX.FactorTables(lines_df([line]))
        m = f.meta.first()
        out = FX.asof_value(probes, f, F.lit("HOT"), F.col("at"), F.lit(m.first_date), F.lit(m.last_date),
                            F.lit(m.last_value), "v", spread_key=F.col("id"))
        rows = sorted((r.id, r.v) for r in out.collect())
        return rows, out._jdf.queryExecution().executedPlan().toString()

    ref, _ = run()
    spark.conf.set(B.MAX_ROWS_CONF, "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, plan = run()
    finally:
        spark.conf.unset(B.MAX_ROWS_CONF)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == ref
    assert "SortMergeJoin" in plan and "year(_k_at" in plan
    # ids cycle modulo 1900 over 3000 rows: two sets of 31 December-1999 probes precede the data
    assert sum(v is None for _, v in ref) == 62


def contracts(spark, rows):
    return spark.createDataFrame(rows, "contract_id string, rr_moc string, sc_moc string, rr_term string")


def test_unknown_and_unreadable_lines(spark, lines_df):
    from flowbook.plans import pipeline as PL
    lines = LINES + ["BAD;x;ReferenceRate;2015-01-01T00!2015-02-30T00;0.1!0.2", "ONE;x;ReferenceIndex;2015-01-01T00!2015-02-01T00;1",
                     "NAN;x;TermStructure;1M!1Y;0.1!x", "END;x;ReferenceIndex;2015-01-01T00!!;7!!"]
    book = contracts(spark, [("1", "Z", "A", "6M"), ("2", "BAD", "A", "6M"), ("3", None, "Z", "6M"), ("4", "A", "ONE", "6M"),
                             ("5", "A", "C", "6M"), ("6", "gone", "gone", "6M"), ("7", "NAN", None, "6M"), ("8", None, "END", "6M")])
    got = PL.with_factors(book, FX.FactorTables(lines_df(lines)))
    errors = sorted(tuple(r)[:1] + tuple(r)[2:] for r in FX.lookup_errors(got).collect())
    assert errors == [("2", "reset", "unreadable"), ("2", "scaling", "skipped"), ("4", "scaling", "unreadable"), ("5", "scaling", "unreadable"),
                      ("6", "reset", "missing"), ("6", "scaling", "skipped"), ("7", "reset", "unreadable")]
    bad = sorted((r.code, r.reason) for r in FX.factor_rejects(lines_df(lines)).collect())
    assert bad == [("BAD", "value"), ("NAN", "value"), ("ONE", "length")]


def test_last_of_equal_dates_wins(spark, lines_df):
    f = FX.FactorTables(lines_df(["D;x;ReferenceRate;2015-01-01T00!2015-02-01T00!2015-01-01T00!2015-02-01T00;0.05!0.2!0.03!0.1"]))
    assert f.meta.first().last_value == 0.1
    assert [(str(r.d_from), r.value) for r in f.intervals.collect()] == [("2015-01-01", 0.03)]


def test_bytes_bound_the_broadcast(spark, lines_df):
    wide = "W;x;ReferenceRate;" + "!".join(f"{2000 + i // 12}-{i % 12 + 1:02d}-01T00" for i in range(240)) + ";" + "!".join(["0.1"] * 240)
    spark.conf.set(B.MAX_BYTES_CONF, "2000")
    try:
        f = FX.FactorTables(lines_df([wide]))
        assert f.meta_broadcast and not f.intervals_broadcast
    finally:
        spark.conf.unset(B.MAX_BYTES_CONF)


def test_hot_code_is_salted_in_the_shuffle_lookup(spark, lines_df):
    from flowbook.plans import pipeline as PL
    book = contracts(spark, [(f"c{i}", "A" if i % 10 else "C", None, "6M") for i in range(2000)])
    pick = lambda df: sorted(tuple(r) for r in df.select("contract_id", "rr_found", "rr_type", "rr_curve_rate").collect())
    ref = pick(PL.with_factors(book, tables(spark, lines_df)))
    for k, v in ((B.MAX_ROWS_CONF, "0"), ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(k, v)
    try:
        out = PL.with_factors(book, tables(spark, lines_df))
        assert pick(out) == ref
        where = out.filter("rr_moc = 'A'").select(F.spark_partition_id().alias("p"))
        assert "SortMergeJoin" in FX.lookup_code(book, tables(spark, lines_df), "rr_moc", "rr")._jdf.queryExecution().executedPlan().toString()
        reset_only = FX.lookup_code(book, tables(spark, lines_df), "rr_moc", "rr").filter("rr_moc = 'A'").select(F.spark_partition_id().alias("p"))
        assert reset_only.distinct().count() >= 4 and where.count() == 1800
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        for k in (B.MAX_ROWS_CONF, "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)
