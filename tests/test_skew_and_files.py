"""Measured salts, the parse barrier, counters, plan shape and the life of intermediate tables."""

import datetime as dt
import os
from statistics import median

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowbook.functions import parsing as P
from flowbook.operators import broadcast as B
from flowbook.operators import factors as FX
from flowbook.operators import skew
from flowbook.plans import pipeline as PL
from flowbook.plans import queries as Q
from flowbook.plans import sinks as K


@pytest.fixture
def shuffled(spark):
    """No broadcast, no adaptive re-planning."""
    was = {"spark.sql.adaptive.enabled": "true"}
    for k, v in ((B.MAX_ROWS_CONF, "0"), ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(k, v)
    yield
    for k in (B.MAX_ROWS_CONF, "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.unset(k)
    for k, v in was.items():
        spark.conf.set(k, v)


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_stays_out_of_the_parser(spark):
    b = Q.book(spark, SF_SMALL)
    plain, filtered = optimised(b), optimised(b.filter("dcc = 'A/360' AND md > ied"))
    assert filtered.count("split(") == plain.count("split(") == 1
    assert len(filtered) < 1.1 * len(plain) + 500


def test_no_lambda_and_one_sort_in_the_valuation(spark):
    from flowbook.operators import assemble as A
    n = A.nest(Q.pam(spark, SF_SMALL))
    assert "lambda" not in optimised(n)
    plan = n._jdf.queryExecution().executedPlan().toString()
    assert sum("Sort [" in x for x in plan.splitlines()) == 1


def share_of_tasks(df):
    """Largest and median number of rows in the tasks of the last stage."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(n), median(n)


def test_hot_and_null_codes_spread_evenly(spark, lines_df, shuffled):
    dates = [dt.date(2000, 1, 1) + dt.timedelta(days=30 * i) for i in range(24)]
    series = ";x;ReferenceRate;" + "!".join(f"{d}T00" for d in dates) + ";" + "!".join(str(0.01 + i / 1000) for i in range(24))
    f = FX.FactorTables(lines_df(["HOT" + series, *[f"C{i}{series}" for i in range(40)]]))
    assert not f.broadcast
    code = F.when(F.col("id") % 20 < 18, "HOT").when(F.col("id") % 20 == 18, F.concat(F.lit("C"), (F.col("id") % 40).cast("string")))
    rows = spark.range(40_000).select(F.lit(None).cast("string").alias("contract_id"), F.col("id").alias("line_key"), code.alias("rr_moc"),
                                      F.lit(dt.date(2000, 7, 9)).alias("at"))
    hot = skew.measure(rows, key=F.col("rr_moc"))["key"]
    assert set(hot.salts) >= {"HOT"} and hot.salts["HOT"] >= 0.9 * 8 * 8 and all(n < 8 for k, n in hot.salts.items() if k != "HOT")
    joined = FX.lookup_code(rows, f, "rr_moc", "rr")
    most, mid = share_of_tasks(joined)
    assert joined.count() == 40_000 and most <= 3 * mid
    assert joined.filter("rr_found").count() == 38_000
    asof = FX.asof_value(joined, f, F.col("rr_moc"), F.col("at"), F.col("rr_first"), F.col("rr_last"), F.col("rr_last_value"), "v")
    most, mid = share_of_tasks(asof)
    assert most <= 3 * mid
    got = {(r.found, r.v): r["count"] for r in asof.groupBy(F.col("rr_found").alias("found"), "v").count().collect()}
    assert got == {(True, 0.01 + 6 / 1000): 38_000, (False, None): 2_000}


def test_lines_without_an_id_are_not_one_key(spark, shuffled):
    """What is rejected before its id parsed has none; the as-of join spreads it by its line."""
    book = Q.book(spark, SF_SMALL, defects=True).withColumn("contract_id", F.lit(None).cast("string"))
    ev = book.transform(PL.cashflow_events(Q.FXT.FIXTURE_T0, Q.factors(spark, SF_SMALL)))
    most, mid = share_of_tasks(ev)
    assert most <= 3 * mid


def test_curve_segments_agree_with_the_array(spark, lines_df):
    lines = ["C;x;TermStructure;1M!6M!6M!2Y!1Y;0.01!0.02!0.05!0.04!0.03", "ONE;x;TermStructure;1Y;0.5", "NONE;x;TermStructure;1Y!x;0.5!1"]
    f = FX.FactorTables(lines_df(lines))
    asked = spark.createDataFrame([(c, t) for c in ("C", "ONE", "NONE", "gone") for t in (0.0, 1 / 12, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 9.0, None)], "contract_id string, term double")
    got = FX.with_curve_rate(asked, f, F.col("contract_id"), F.col("term"), "rate")
    both = got.join(f.meta, F.col("contract_id") == F.col("code"), "left").select("rate", FX.curve_rate(F.col("curve"), F.col("term")).alias("want"))
    rows = both.collect()
    assert len(rows) == 40 and all(r.rate == r.want for r in rows) and sum(r.rate is not None for r in rows) == 18


@pytest.mark.parametrize("text, parts", [
    ("6M-", (6, "M", "-")), ("P6ML1", (6, "M", "L1")), ("12Y", (12, "Y", "")), ("P1QL", (1, "Q", "L")), ("007D+", (7, "D", "+")), ("1W0", (1, "W", "0")),
    ("1M1M", None), ("M", None), ("PM", None), ("+6M", None), (" 6M", None), ("6 M", None), ("6M--", None), ("6m", None), ("", None), (None, None), ("PP6M", None),
    ("1.5M", None), ("6ML2", None), ("99999999999M", (None, "M", "")), ("MD", None), ("6", None)])
def test_cycle_parts(spark, text, parts):
    df = spark.createDataFrame([(text,)], "x string")
    read = lambda c, name: F.struct(P.n_of(c), P.unit_of(c), P.stub_of(c)).alias(name)
    r = df.select(read(P.cycle_parts(F.col("x")), "c"), read(P.period_parts(F.col("x")), "p")).first()
    assert tuple(r.c) == (parts or (None, None, None))
    assert tuple(r.p) == (parts if parts and parts[2] == "" else (None, None, None))


@pytest.mark.parametrize("text, ok", [
    ("2015-04-01", True), ("2015-04-01T00", True), ("2015-04-01T23:59", True), ("2015-04-01T23:59:59", True), ("2015-04-01T24", False), ("2015-04-01T1:", False),
    ("2015-04-01 00", False), ("2015-02-30", False), ("2015-4-011", False), ("2015-04", False), ("2015-04-01T", False), ("+015-04-01", False), ("2015/04/01", False), ("", False)])
def test_whole_dates(spark, text, ok):
    r = spark.createDataFrame([(text,)], "x string").select(P.parse_date(F.col("x")).alias("d")).first()
    assert (r.d is not None) == ok


def test_partitions_follow_the_files(spark, tmp_path):
    small, large = tmp_path / "small", tmp_path / "large"
    small.write_text("x;y\n")
    with large.open("wb") as f:
        f.truncate(3 << 30)  # sparse
    assert PL.partitions_for(spark, str(small)) == spark.sparkContext.defaultParallelism
    assert PL.partitions_for(spark, str(tmp_path / "*")) == 289 == PL.partitions_for(spark, [str(small), str(large)])


def test_intermediate_tables_go_when_the_result_is_written(spark, tmp_path):
    files = Q.FXT.write_files(spark, SF_SMALL, str(tmp_path / "in"))
    shared = K.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    n = PL.run(spark, files["contracts"], factors_path=files["factors"], time_spec_path=files["time"], sink="parquet", output=str(tmp_path / "out"))
    assert set(os.listdir(shared)) <= before and n.count() == 1500
    n = PL.run(spark, files["contracts"], factors_path=files["factors"], time_spec_path=files["time"], sink="text", output=str(tmp_path / "text"), release=True)
    assert set(os.listdir(shared)) <= before and n.filter(F.size("id") > 0).count() > 100
    since = K.mark()
    kept = PL.run(spark, files["contracts"], factors_path=files["factors"], time_spec_path=files["time"])
    assert kept.count() == 1500 and not set(os.listdir(shared)) <= before
    K.release(spark, since)
    assert set(os.listdir(shared)) <= before
