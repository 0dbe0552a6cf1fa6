"""Archives of several files read record by record; the list join with a hot host."""

import io

import pytest
from pyspark.sql import functions as F

from flowbook.llm import queries as Q
from flowbook.llm import url_filter, warc

SF = "/root/testdata/sf0.001"


def test_small_files_and_batches_give_the_same_captures(spark, monkeypatch):
    pages = Q.table(spark, SF, "pages").select("page_id", "url", "html")
    one = sorted(warc.round_trip(pages).collect(), key=str)
    written = []
    monkeypatch.setattr(warc, "BYTES_PER_FILE", 20_000)
    monkeypatch.setattr(warc, "read", lambda s, path, read=warc.read: written.append(len(s.read.format("binaryFile").load(path).select("path").collect())) or read(s, path))
    assert [r.page_id for r in one] == [r.page_id for r in sorted(warc.round_trip(pages).collect(), key=str)]
    assert written[0] > 3


def test_a_table_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>", "t", "d", 3, "k")], "page_id long, url string, html string, type string, digest string, row int, record_id string")
    r = warc.round_trip(pages).first()
    assert (r.page_id, r.response.type, r.response.block) == (1, "response", "<p>x</p>")


def test_parse_refuses_what_is_cut_off():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <u>\r\nContent-Length: 4\r\n\r\na\r\nb\r\n\r\n"
    assert [(r[0], r[9]) for r in warc.parse(io.BytesIO(record * 2))] == [("<u>", "a\r\nb")] * 2
    for bad in (record[:-5], record[:-1], record + b"x"):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(bad)))


def test_a_hot_host_without_broadcast(spark, monkeypatch):
    """Nine in ten captures are of one host in one month: the rows stay the same, and no task holds them all."""
    t = "timestamp'2024-03-01 00:00:00'"
    caps = spark.range(20_000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("http://h"), (F.col("id") % 70).cast("string"), F.lit(".org/x")))
                                      .otherwise("http://hot.org/x").alias("url"), F.expr(f"{t} + make_dt_interval(0, 0, cast(id as int) % 40000)").alias("fetched_at"))
    entries = spark.sql(f"SELECT * FROM VALUES ('c1','hot.org',timestamp'2024-01-01 00:00:00','add'),('c1','hot.org',{t} + INTERVAL 5 DAYS,'remove'),"
                        f"('c2','h10.org/x',{t},'add'),('c3','h20.org',{t} + INTERVAL 9 DAYS,'add') AS t(category,key,listed_at,action)")
    key = lambda df: sorted((r.page_id, tuple(r.categories)) for r in df.select("page_id", "categories").collect())
    want = key(url_filter.active(caps, entries))
    monkeypatch.setattr(url_filter, "bounded", lambda small: (small, False))
    seen = []
    monkeypatch.setattr(url_filter, "_salted", lambda a, m, salted=url_filter._salted: seen.append(salted(a, m)) or seen[-1])
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}  # so small partitions stay apart
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        assert key(url_filter.active(caps, entries)) == want
        per_task = [r["count"] for r in seen[0].filter("key = 'hot.org'").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert sum(per_task) == 18_000 and max(per_task) < 0.5 * sum(per_task)
