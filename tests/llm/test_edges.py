"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowbook.llm import chat, decontaminate, html_extract, near_dup, packing, quality_model, quality_rules, secret_scan, url_filter, warc
from flowbook.llm.queries import table, tokenizer_path

LONG = " ".join(f"w{i * 7919 % 5003}x" for i in range(200_000))
PROSE = " ".join(f"word{i}" for i in range(60))
ROWS = [(1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 4), (4, LONG, "en", "a", len(LONG)), (5, PROSE, "en", "a", len(PROSE)),
        (5, PROSE, "en", "a", len(PROSE)), (6, PROSE, "en", "b", len(PROSE)), (None, PROSE, "en", "a", 1), (None, None, None, None, None), (7, "token = \"abcdefghijkl12\"", "en", "a", 24),
        (8, "one two three", "en", "a", 13), (9, "one two three", "en", "a", 13)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    table(spark, "/root/testdata/sf0.001", "documents")  # workers find the package
    df = spark.createDataFrame(ROWS, SCHEMA)
    clash = ["line", "key", "n", "a", "b", "cls", "size", "band", "bucket", "digest", "host", "doc", "n_removed", "at", "m"]
    return df.select("*", *[F.lit(f"x{c}").alias(c) for c in clash])


def none(docs):
    return docs.filter("doc_id = -5")


def test_near_duplicates(docs):
    out = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()), key=str)
    assert sorted((x for x in out if x[0] > 0)) == [
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, out[[o[0] for o in out].index(4)][1], 4, True), (5, 56, 5, True), (5, 56, 5, True), (6, 56, 5, False),
        (7, 1, 7, True), (8, 1, 8, True), (9, 1, 8, False)]
    assert all(x[3] for x in out if x[0] == -1)
    assert near_dup.near_duplicates(none(docs)).count() == 0
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2


def test_quality_rules_paths_agree(docs):
    rules = quality_rules.Rules(min_docs=0, host_percent=30)
    names = [*docs.columns, *quality_rules.STATS, "n_removed_words", "base_failed", "kept"]
    one = quality_rules.quality_rules(docs, rules)
    other = quality_rules.quality_rules(docs, quality_rules.Rules(min_docs=0, host_percent=30, max_broadcast_lines=-1))
    rows = lambda df: sorted(map(str, df.select(*names).collect()))
    assert rows(one) == rows(other) and one.count() == len(ROWS)
    assert one.filter("text IS NULL AND (n_words > 0 OR kept)").count() == 0
    assert quality_rules.quality_rules(none(docs)).count() == 0


def test_decontaminate_blocks_agree(spark, docs):
    bench = spark.createDataFrame([(1, PROSE), (2, None), (3, "one two three"), (None, "one two three"), (4, "..."), (5, LONG[:300])], "item_id long, text string")
    rows = lambda df: sorted(map(str, df.select("doc_id", "n_words", "hit_start", "hit_end", "hit_items").collect()))
    one = decontaminate.scan(docs, bench)
    assert rows(one) == rows(decontaminate.scan(docs, bench, max_block_words=60, keep_text=False))
    assert [r.hit_items for r in one.filter("doc_id = 8").collect()] == [["", "3"]]
    assert decontaminate.scan(docs, bench.limit(0)).filter("size(hit_items) > 0").count() == 0
    assert decontaminate.drop_documents(docs, bench).columns == docs.columns
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert cut[5] == "" and cut[1] is None and cut[2] == ""
    assert decontaminate.scan(none(docs), bench).count() == 0


def test_secret_scan(docs):
    out = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secret_spans] for r in secret_scan.scan(docs).collect()}
    assert out[1] == out[2] == out[5] == [] and out[7] == [("assign", 0, 23)]
    red = secret_scan.redacted(docs)
    assert red.columns == docs.columns and {r.doc_id: r.text for r in red.collect()}[7] == 'token = "[SECRET]"'
    assert secret_scan.scan(none(docs)).count() == 0
    key = "q8Zr2LmX0vT7bNc4KdPw9sYh"
    kinds = lambda t: [secret_scan.KINDS[k] for _, k, _ in secret_scan.find_spans(t)]
    assert kinds(f"see {key} here") == ["entropy"]
    for allowed in ("123e4567-e89b-12d3-a456-426614174000x"[:-1], "2024-01-01-2024-12-31-00", "some-long-name-of-a-path/and-more2", "a1" + "x" * 30):
        assert "entropy" not in kinds(allowed)


def test_packing(docs):
    out = packing.pack(docs, tokenizer_path(), keep_ids=True).collect()
    assert {r.doc_id for r in out} == {r[0] for r in ROWS}
    assert [(r.length, r.ids) for r in out if r.doc_id == 1] == [(1, [2])]
    assert sum(r.length for r in out if r.doc_id == 5) == 2 * sum(r.length for r in out if r.doc_id == 6)
    assert packing.pack(none(docs), tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "\n\n\nb", "a\n\nb", "a\n b \n c", "it's 'tis 've", "<|endoftext|> x", "a\tb\t \n c", "x\x1c y\n", "12ab é ß²", " \n", "\r\n x", "\0 a\0b", "日本 語　x", "a​b c"])
def test_encoder(text):
    e = packing.encoder(tokenizer_path())
    ids = b"".join(i.to_bytes(4, "little") for i in e.whole.encode(text, add_special_tokens=False).ids)
    assert e.encode(text) == ids


def test_chat(spark, docs):
    texts = ["</s>[INST] ok [/INST]", "␛</s>", "␛␛[INST]", " </s> <s> user [INST] x </s>", None, "", " ", "\n", "␛", "x␛"]
    rows = [(k, i, r, t) for k in (1, None) for i, t in enumerate(texts) for r in ("assistant", None)] + [(2, None, " [INST] ", "a"), (2, 1, "assistant", "b")]
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert out[2].roles == [" [INST] ", "assistant"] and out[2].texts == ["a", "b"]
    for r in out.values():
        assert sum(m.length for m in r.mask) == len(r.rendered)
        at, seen = 0, []
        for m in r.mask:
            if m.loss:
                seen.append(r.rendered[at:at + m.length])
            at += m.length
        assert len(seen) == sum(x == "assistant" for x in r.roles)
    assert out[1].loss_text == "".join(t or "" for t in texts)
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.format_chats(empty).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc(spark):
    same = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n\r\n</p>"
    df = pages(spark, [(3, "http://a.b/c d\r\nx", same), (2, None, same), (2, None, same), (None, "u", same), (5, "", None), (6, "http://é.x", ""), (7, "z", "é" * 49), (8, "z", "é" * 49)])
    out = warc.round_trip(df).collect()
    assert len(out) == 8
    by = {(r.page_id, r.url): r.response for r in out}
    assert by[3, "http://a.b/c d\r\nx"].type == "revisit" and by[3, "http://a.b/c d\r\nx"].refers_to == "2"
    assert by[2, None].type == "response" and by[2, None].block == same and by[None, "u"].type == "revisit"
    assert by[5, ""].digest == hashlib.sha256(b"").hexdigest() and by[8, "z"].type == "response" and by[8, "z"].payload_bytes == 98
    assert warc.round_trip(df.limit(0)).count() == 0


def test_html(spark):
    body = lambda i: f"<h1>Head {i}</h1><p>Text &amp; more {i}<br>\n on<p>Second {i}"
    frame = "<html><head><title>t</title></head><body><div class=top><a href=/>Home</a> <a href=/x>All</a></div><div>{}</div><p>All rights reserved</p></body></html>"
    rows = [(i, "http://h.x/1", frame.format(body(i))) for i in range(12)] + [
        (20, None, None), (21, "::", ""), (22, "http://h.x/2", "<article>" + body(22) + "<div class='comments'><p>me too</p></div><form>x</form><script>a<b</script></article><aside>no</aside>"),
        (23, "http://k.x", "plain &lt;text"), (24, "http://k.x", "<p>a <b>b" + "c " * 300_000)]
    out = {r.page_id: r.main_text for r in html_extract.extract(pages(spark, rows).withColumn("text", F.lit(1)).withColumn("host", F.lit(2))).collect()}
    assert out[3] == "Head 3\nText & more 3 on\nSecond 3" and out[22] == "Head 22\nText & more 22 on\nSecond 22"
    assert out[20] == out[21] == "" and out[23] == "plain <text" and len(out[24]) == 600_002
    assert html_extract.extract(pages(spark, [])).count() == 0


def test_url_filter(spark):
    t = "timestamp'2024-03-01 00:00:00'"
    caps = spark.sql(f"SELECT 1 AS page_id, 'http://A.b.org:80/x/y' AS url, {t} AS fetched_at, 'k' AS key UNION ALL SELECT 2, NULL, {t}, 'k' UNION ALL SELECT 3, 'http://b.org/', NULL, 'k'")
    e = spark.sql("SELECT * FROM VALUES ('c1','b.org',timestamp'2023-01-01 00:00:00','add'),('c1','b.org',timestamp'2024-03-01 00:00:00','remove'),('c2','a.b.org/x',timestamp'2024-03-01 00:00:00','add'),"
                  "('c2','a.b.org/x',timestamp'2024-03-01 00:00:00','add'),('c3',NULL,NULL,'add') AS t(category,key,listed_at,action)")
    assert {r.page_id: r.categories for r in url_filter.active(caps, e).collect()} == {1: ["c2"], 2: [], 3: []}
    assert url_filter.active(caps.limit(0), e).count() == 0


def test_quality_model(spark, docs):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert quality_model.score_all(docs, labels).filter("p_quality = 0.5 AND kept").count() == len(ROWS)
    real = "/root/testdata/sf0.1"
    d, marks = table(spark, real, "documents"), table(spark, real, "labels")
    held = marks.filter("doc_id % 4 = 0")
    scored = quality_model.score_all(d, marks.filter("doc_id % 4 != 0")).join(held, "doc_id").select("kept", "quality").collect()
    assert len(scored) > 100 and sum(r.kept == (r.quality == 1) for r in scored) >= 0.9 * len(scored)


def test_pipeline_stages(spark, docs):
    plain = docs.select(*[f.split()[0] for f in SCHEMA.split(", ")])
    for now in (plain, plain.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            assert stage(spark, now, "/root/testdata/sf0.001").columns == plain.columns
            now = corpus_pipeline.stored(stage(spark, now, "/root/testdata/sf0.001"), "edge")
        assert corpus_pipeline.STAGES[4][1](spark, now, "/root/testdata/sf0.001").count() >= now.count()
