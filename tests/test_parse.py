"""Parser edge rows: trailing separators, bad numbers, short lines, NULL, NaN."""

from conftest import BASE_TERMS, line
from flowbook.functions import parsing as P
from flowbook.operators import contracts as C
from pyspark.sql import functions as F


def test_java_split_drops_trailing_empties(spark):
    r = spark.range(1).select(P.java_split(F.lit("a;b;;")).alias("t"),
                              P.java_split(F.lit(";a")).alias("u")).first()
    assert r.t == ["a", "b"]
    assert r.u == ["", "a"]


def test_prefix_rule_on_bad_number(spark, lines_df):
    df = C.parse_contracts(lines_df([line(**dict(BASE_TERMS, rate="abc"))]))
    r = df.first()
    assert (r.err_pos, r.err_field, r.err_token) == (11, "rate", "abc")
    assert r.ip_cycle == "6M-" and r.contract_id == "G1"
    assert r.rate is None and r.dcc is None and r.notional is None and r.pdied is None


def test_short_line_and_trailing_separators(spark, lines_df):
    full = line(**BASE_TERMS)
    cut = ";".join(full.split(";")[:20])
    df = C.parse_contracts(lines_df([cut, full + ";;;"]))
    rows = df.orderBy("err_pos").collect()
    assert rows[0].err_pos is None and rows[0].pdied == 0.0
    assert rows[1].err_pos == 20 and rows[1].err_token is None and rows[1].md is not None


def test_null_and_nan_tokens(spark, lines_df):
    r = C.parse_contracts(lines_df([line(**BASE_TERMS)])).first()
    assert r.prd is None and r.pprd is None and r.sc_moc is None and r.rr_cycle is None
    assert r.err_pos is None


def test_unknown_day_count_is_rejected(spark, lines_df):
    df = C.parse_contracts(lines_df([line(**dict(BASE_TERMS, dcc="ACT/ACT"))]))
    assert C.rejects(df).first().err_field == "dcc"
    assert C.clean(df).count() == 0


def test_short_layout(spark, lines_df):
    toks = ["x"] * 22
    for p, v in {4: "2014-12-31T00", 5: "RPA", 7: "S1", 9: "NULL", 10: "6M-", 11: "0.04", 12: "A/360",
                 17: "EUR", 18: "2014-12-01T00", 19: "2015-01-01T00", 20: "2016-01-01T00", 21: "1000"}.items():
        toks[p] = v
    r = C.parse_contracts(lines_df([";".join(toks)]), layout="short").first()
    assert r.currency == "EUR" and r.notional == 1000.0 and r.err_pos is None and r.rr_moc is None


def test_cycle_parts(spark):
    r = spark.range(1).select(
        P.cycle_n(F.lit("P3ML0")).alias("n"), P.cycle_unit(F.lit("1Q-")).alias("u"),
        P.cycle_is_long(F.lit("5M+")).alias("l"), P.cycle_is_long(F.lit("6M-")).alias("s"),
        P.period_years(F.lit("10Y")).alias("y"), P.cycle_n(F.lit("junk")).alias("bad")).first()
    assert (r.n, r.u, r.l, r.s, r.y, r.bad) == (3, "Q", True, False, 10.0, None)


def test_required_terms_reject_null_and_nan(spark, lines_df):
    for name, tok, pos in (("rate", "NaN", 11), ("ied", "NULL", 18), ("md", "", 19), ("notional", "NaN", 20)):
        r = C.parse_contracts(lines_df([line(**dict(BASE_TERMS, **{name: tok}))])).first()
        assert (r.err_pos, r.err_field, r.err_token) == (pos, name, tok) and r[name] is None


def test_dates_are_whole(spark):
    texts = ["2015-04-01T00", "2015-04-01", "2015-04-01T23:59:59", "2015", "2015-04", "2015-04-01Tx", "2015-04-01T24", "2015-02-30T00", "NULL", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.d for r in df.select("i", P.parse_date(F.col("t")).alias("d")).orderBy("i").collect()]
    assert [d is not None for d in got] == [True] * 3 + [False] * 7


def test_separators_only(spark):
    r = spark.range(1).select(P.java_split(F.lit(";;;")).alias("a"), P.java_split(F.lit("")).alias("b")).first()
    assert r.a == [] and r.b == [""]
