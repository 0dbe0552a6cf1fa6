"""Generated code short enough to be compiled, and partitions that grow with the book."""

import pytest

from flowbook.plans import queries as Q
from flowbook.sources import fixtures as FXT

from conftest import SF_SMALL


def longest_method(df):
    """Bytes of code of the longest method that is generated for a plan's joint stages."""
    jvm = df.sparkSession._jvm
    debug = getattr(getattr(jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["schedule", "ip_schedule", "events_nested", "nested_defects", "pam_defects", "asof_fx", "cash_by_currency_month"])
def test_every_method_is_compiled(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the whole plan at once
    try:
        assert 0 < longest_method(Q.QUERIES[name](spark, SF_SMALL)) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_partitions_grow_with_the_book(spark, monkeypatch):
    assert Q.event_partitions(spark, SF_SMALL) == max(8, spark.sparkContext.defaultParallelism)
    rows = FXT.load(spark, SF_SMALL, "orders").count()
    monkeypatch.setattr(FXT, "CONTRACTS_PER_TASK", 50)
    assert FXT.load_book_source(spark, SF_SMALL).rdd.getNumPartitions() == Q.event_partitions(spark, SF_SMALL) == -(-rows // 50) > 8
    assert Q.event_partitions(spark, SF_SMALL, 2) == 2 * -(-rows // 50)


def test_lines_that_share_an_id_are_sorted_apart(spark):
    assert Q.q_nested_defects(spark, SF_SMALL).count() == 2 * FXT.load(spark, SF_SMALL, "orders").count()


def nodes(plan, name):
    found = [plan] if plan.nodeName() == name else []
    for i in range(plan.children().size()):
        found += nodes(plan.children().apply(i), name)
    return found


@pytest.mark.parametrize("name", ["events_nested", "pam_defects", "asof_fx", "cash_by_currency_month"])
def test_windows_hold_narrow_rows(spark, name):
    plan = Q.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan()
    windows = nodes(plan, "Window")
    assert windows and max(w.children().apply(0).output().size() for w in windows) <= 14


def test_nesting_gathers_ready_events(spark):
    plan = Q.q_events_nested(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan()
    (gathered,) = nodes(plan, "Aggregate")
    assert gathered.children().apply(0).output().size() == 3


def test_time_spec_files_grow_with_the_book(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(FXT, "CONTRACTS_PER_TASK", 50)
    paths = FXT.write_files(spark, SF_SMALL, str(tmp_path / "f"))
    names = [p.name for p in (tmp_path / "f" / "time").iterdir() if p.name.startswith("part-")]
    assert len(names) > 8
    lines = "".join((tmp_path / "f" / "time" / n).read_text() for n in sorted(names)).splitlines()
    assert lines[0] == FXT.TIME_SPEC_FIRST_LINE and len(lines) == 1 + FXT.load(spark, SF_SMALL, "orders").count()
