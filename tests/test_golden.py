"""Hand-computed contracts (FIXTURES.md section 5) and single-rule checks."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import BASE_TERMS, line
from flowbook.operators import contracts as C
from flowbook.operators import factors as FX
from flowbook.plans import pipeline as PL

FACTOR = "R;x;ReferenceRate;2015-01-01T00;0.05"


def run(spark, lines_df, terms, factor_lines=(FACTOR,), t0="2014-12-31"):
    book = C.parse_contracts(lines_df([line(**terms)]))
    f = FX.FactorTables(lines_df(list(factor_lines))) if factor_lines else None
    ev = book.transform(PL.cashflow_events(t0, f)).filter("reported")
    return [(str(r.event_date), r.type, r.value, r.nominal, r.accrued)
            for r in ev.orderBy("event_date", "seq").collect()]


def approx(rows, expected):
    assert len(rows) == len(expected), rows
    for got, exp in zip(rows, expected):
        assert got[:2] == exp[:2], (got, exp)
        for a, b in zip(got[2:], exp[2:]):
            assert abs(a - b) < 1e-9, (got, exp)


def test_golden_rpa(spark, lines_df):
    approx(run(spark, lines_df, BASE_TERMS), [
        ("2015-01-01", "IED", -1000.0, 1000.0, 0.0),
        ("2015-04-01", "RR", 0.0, 1000.0, 10.0),
        ("2015-07-01", "IP", 22.63888888888889, 1000.0, 0.0),
        ("2016-01-01", "IP", 25.555555555555557, 1000.0, 0.0),
        ("2016-01-01", "MD", 1000.0, 0.0, 0.0),
    ])


def test_golden_rpl_opposite_sign(spark, lines_df):
    rows = run(spark, lines_df, dict(BASE_TERMS, role="RPL"))
    approx(rows, [
        ("2015-01-01", "IED", 1000.0, -1000.0, 0.0),
        ("2015-04-01", "RR", 0.0, -1000.0, -10.0),
        ("2015-07-01", "IP", -22.63888888888889, -1000.0, 0.0),
        ("2016-01-01", "IP", -25.555555555555557, -1000.0, 0.0),
        ("2016-01-01", "MD", -1000.0, 0.0, 0.0),
    ])


def test_next_reset_rate_makes_rrf(spark, lines_df):
    rows = run(spark, lines_df, dict(BASE_TERMS, rr_next="0.06"))
    assert [r[1] for r in rows] == ["IED", "RRF", "IP", "IP", "MD"]
    approx(rows[2:3], [("2015-07-01", "IP", 10.0 + 1000 * 0.06 * 91 / 360, 1000.0, 0.0)])


def test_missing_factor_keeps_rate(spark, lines_df):
    rows = run(spark, lines_df, dict(BASE_TERMS, rr_moc="NOPE"))
    approx(rows[2:3], [("2015-07-01", "IP", 1000 * 0.04 * 181 / 360, 1000.0, 0.0)])


def test_running_contract_not_reported_before_t0(spark, lines_df):
    rows = run(spark, lines_df, BASE_TERMS, t0="2015-05-01")
    # RR before t0 is dropped: rate stays 4 %; IP accrues from IED.
    approx(rows, [
        ("2015-07-01", "IP", 1000 * 0.04 * 181 / 360, 1000.0, 0.0),
        ("2016-01-01", "IP", 1000 * 0.04 * 184 / 360, 1000.0, 0.0),
        ("2016-01-01", "MD", 1000.0, 0.0, 0.0),
    ])


def test_termination_drops_later_events(spark, lines_df):
    rows = run(spark, lines_df, dict(BASE_TERMS, td="2015-10-01T00", ptd="990"))
    assert [r[1] for r in rows] == ["IED", "RR", "IP", "TD"]
    acc = 1000 * 0.05 * 92 / 360
    approx(rows[3:], [("2015-10-01", "TD", 990 + acc, 0.0, 0.0)])


def test_purchase_hides_earlier_events(spark, lines_df):
    rows = run(spark, lines_df, dict(BASE_TERMS, prd="2015-05-01T00", pprd="1001"))
    assert [r[1] for r in rows] == ["PRD", "IP", "IP", "MD"]
    acc = 10.0 + 1000 * 0.05 * 30 / 360
    approx(rows[:1], [("2015-05-01", "PRD", -(1001 + acc), 1000.0, acc)])


def test_long_stub_merges_last_period(spark, lines_df):
    t = dict(BASE_TERMS, ip_anchor="2015-02-01T00", ip_cycle="5M+", rr_anchor="NULL", rr_moc="NULL")
    dates = [r[0] for r in run(spark, lines_df, t, factor_lines=()) if r[1] == "IP"]
    # 2015-02-01, 2015-07-01 (and 2015-12-01 dropped: long stub), md
    assert dates == ["2015-02-01", "2015-07-01", "2016-01-01"]
    t["ip_cycle"] = "5M-"
    dates = [r[0] for r in run(spark, lines_df, t, factor_lines=()) if r[1] == "IP"]
    assert dates == ["2015-02-01", "2015-07-01", "2015-12-01", "2016-01-01"]


def test_month_end_anchor_does_not_drift(spark, lines_df):
    t = dict(BASE_TERMS, ied="2015-01-31T00", ip_anchor="2015-01-31T00", ip_cycle="1M-",
             md="2015-06-30T00", rr_anchor="NULL", rr_moc="NULL")
    dates = [r[0] for r in run(spark, lines_df, t, factor_lines=()) if r[1] == "IP"]
    assert dates == ["2015-01-31", "2015-02-28", "2015-03-31", "2015-04-30", "2015-05-31", "2015-06-30"]


def test_end_point_fixing_observes_next_date(spark, lines_df):
    t = dict(BASE_TERMS, rr_anchor="2015-04-01T00", rr_cycle="3M-", rr_point="E", rr_fixing="2D")
    book = C.parse_contracts(lines_df([line(**t)]))
    from flowbook.operators import schedule as S
    rows = S.schedule_table(book, F.lit(dt.date(2014, 12, 31))).filter("type = 'RR'") \
        .orderBy("event_date").collect()
    assert [(str(r.event_date), str(r.obs_date)) for r in rows] == [
        ("2015-04-01", "2015-06-29"), ("2015-07-01", "2015-09-29"), ("2015-10-01", "2015-12-30")]


def test_day_counts():
    import duckdb  # noqa: F401  (only to keep imports uniform)
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    from flowbook.functions.daycount import year_fraction
    df = spark.createDataFrame([(dt.date(2015, 12, 15), dt.date(2016, 3, 31))], "a date, b date")
    r = df.select(*[year_fraction(F.col("a"), F.col("b"), F.lit(c)).alias(c.replace("/", "_"))
                    for c in ("A/360", "A/365", "30E/360", "A/AISDA")]).first()
    assert abs(r[0] - 107 / 360) < 1e-12
    assert abs(r[1] - 107 / 365) < 1e-12
    assert abs(r[2] - (360 * 1 + 30 * (3 - 12) + (30 - 15)) / 360) < 1e-12
    assert abs(r[3] - (17 / 365 + 0 + 90 / 366)) < 1e-12
