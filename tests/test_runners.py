"""L1-L4 from text files on disk: text sink, parquet sink with view, short layout."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from conftest import SF_SMALL
from flowbook.plans import pipeline as PL
from flowbook.plans import queries as Q
from flowbook.sources import fixtures as FXT


@pytest.fixture(scope="module")
def files(spark):
    d = tempfile.mkdtemp(prefix="flowbook-run-")
    orders = FXT.load(spark, SF_SMALL, "orders")
    FXT.contract_lines(orders).select("value").write.text(d + "/contracts")
    FXT.contract_lines(orders, layout="short").select("value").write.text(d + "/short")
    FXT.factor_lines(spark, FXT.load(spark, SF_SMALL, "lineitem")).orderBy("line_no") \
        .select("value").coalesce(1).write.text(d + "/factors")
    FXT.time_spec_lines(spark, orders).orderBy("line_no").select("value").coalesce(1).write.text(d + "/time")
    return d


def test_l1_text_sink(spark, files):
    out = files + "/out_l1"
    nested = PL.run(spark, files + "/contracts", factors_path=files + "/factors",
                    time_spec_path=files + "/time", sink="text", output=out)
    assert spark.read.text(out).count() == nested.count() == 1500
    first = spark.read.text(out).first()["value"]
    assert first.startswith("[") and first.count(";") == 6


def test_l2_parquet_view_and_count(spark, files):
    out = files + "/out_l2"
    nested = PL.run(spark, files + "/contracts", factors_path=files + "/factors",
                    time_spec_path=files + "/time", partitions="4.0", sink="parquet", output=out,
                    view="events_l2", cache=True)
    assert spark.sql("SELECT COUNT(*) AS n FROM events_l2").first()["n"] == 1500
    back = spark.read.parquet(out)
    assert back.dtypes == nested.dtypes
    ref = Q.q_events_nested(spark, SF_SMALL)
    rounded = back.select("id", "date", *[F.transform(c, Q.r4).alias(c) for c in ("value", "nominal", "accrued")])
    key = lambda r: (tuple(r["id"]), tuple(r["date"]), tuple(r["value"]))
    assert sorted(map(key, rounded.collect())) == sorted(map(key, ref.collect()))
    with pytest.raises(AnalysisException):
        PL.run(spark, files + "/contracts", t0="1998-01-01", sink="parquet", output=out)
    nested.unpersist()


def test_l3_short_layout_fixed_t0(spark, files):
    nested = PL.run(spark, files + "/short", layout="short", t0="2015-04-01T00")
    # the fixture book matures before 2006: nothing after 2015-04-01 is reported
    assert nested.count() == 1500
    assert nested.filter(F.size("id") > 0).count() == 0
    early = PL.run(spark, files + "/short", layout="short", t0="1990-01-01T00")
    assert early.filter(F.size("id") == 0).count() == 0


def test_l4_load_factors(spark, files):
    f = PL.load_factors(spark, files + "/factors")
    codes = {r.code: r.rf_type for r in f.meta.collect()}
    assert codes["RATE_A"] == "ReferenceRate" and codes["CURVE_1"] == "TermStructure"
    assert codes["ODD_1"] == "SomethingElse" and f.broadcast
    assert f.meta.filter("code = 'RATE_A'").first().first_date.year == 1995
    assert os.path.isdir(files + "/factors")
