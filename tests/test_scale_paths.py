"""Bucketed book (no exchange) and the streaming runner give the batch result."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowbook.operators import assemble as A
from flowbook.plans import pipeline as PL
from flowbook.plans import queries as Q
from flowbook.sources import fixtures as FXT
from flowbook.streaming import start_contract_stream


def _rows(df):
    return sorted(tuple(r) for r in df.select("contract_id", F.col("event_date").cast("string"), "seq",
                                               "type", F.round("value", 6), F.round("accrued", 6)).collect())


def test_bucketed_book_has_no_exchange(spark):
    orders = FXT.load(spark, SF_SMALL, "orders")
    lines = FXT.contract_lines(orders)
    d = tempfile.mkdtemp(prefix="flowbook-bucket-")
    name = "book_" + os.path.basename(d).replace("-", "_")
    table = PL.ingest_contracts(lines, name, 8, path=d + "/t")
    f = Q.factors(spark, SF_SMALL)
    ev = table.transform(PL.cashflow_events(FXT.FIXTURE_T0, f, repartition=False))
    plan = ev._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(contract_id" not in plan and "REPARTITION" not in plan
    assert "SortMergeJoin" not in plan
    ref = Q.book(spark, SF_SMALL).transform(PL.cashflow_events(FXT.FIXTURE_T0, f))
    assert _rows(ev) == _rows(ref)


def test_stream_equals_batch(spark):
    orders = FXT.load(spark, SF_SMALL, "orders")
    lines = FXT.contract_lines(orders)
    src = tempfile.mkdtemp(prefix="flowbook-src-")
    out = tempfile.mkdtemp(prefix="flowbook-out-")
    ck = tempfile.mkdtemp(prefix="flowbook-ck-")
    lines.filter("line_no % 2 = 0").select("value").coalesce(1).write.mode("overwrite").text(src + "/a")
    lines.filter("line_no % 2 = 1").select("value").coalesce(1).write.mode("overwrite").text(src + "/b")
    fl = FXT.factor_lines(spark, FXT.load(spark, SF_SMALL, "lineitem"))
    q = start_contract_stream(spark, src + "/*", out, FXT.FIXTURE_T0, factor_lines=fl, checkpoint=ck + "/c",
                              max_files_per_trigger=1)
    q.awaitTermination(300)
    got = A.flatten(spark.read.parquet(out))
    exp = A.flatten(A.nest(Q.pam(spark, SF_SMALL)))
    cols = ["id", "date", "type", "value"]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == \
        sorted(tuple(r) for r in exp.select(*cols).collect())
