"""The registered queries of the operators: thin digests of their results over
whole tables.  ``pipeline`` is registered by ``__spark_entry__``."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbook.llm import chat, decontaminate, html_extract, near_dup, packing, pitman_yor, prefix_trie, quality_model, quality_rules, resampling, secret_scan, url_filter, warc


#: The folder that holds the package.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table.  Python workers that share this machine's files find the
    library where the driver does; on a cluster it is installed or sent along."""
    path = spark.sparkContext.environment.setdefault("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [path, ROOT]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """``FLOWBOOK_TOKENIZER``, else the public tokenizer the result is stated for."""
    if path := os.environ.get("FLOWBOOK_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash_near_dedup(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = secret_scan.scan(docs)
    n = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secret_spans", lambda s: s["kind"] != "entropy")
    return spans.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secret_spans")).alias("spans"))


def op3_url_filter(spark, sf_dir):
    captures, entries = url_tables(spark, sf_dir)
    found = url_filter.active(captures, entries)
    return found.select("page_id", "url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"),
                        F.array_join("categories", ",").alias("categories"), (F.size("categories") > 0).alias("blocked"))


def url_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Captures with fetch times, and a dated block list, both derived from ``pages``:
    a page is fetched ``page_id`` * 7919 minutes (modulo two years) after 2023-01-01;
    each host, and each host with its first path segment, enters and leaves a
    category now and then, at times that follow from its characters."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda n: F.expr("timestamp'2023-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), n)
    captures = pages.withColumn("fetched_at", day((F.col("page_id") * 7919 % 1051200).cast("int")))
    keys = pages.select(F.explode(url_filter.keys_of(F.col("url"))).alias("key")).distinct()
    seed = F.length("key") * 31 + F.ascii("key") * 17 + F.ascii(F.substring("key", -2, 1)) * 7
    listed = keys.withColumn("s", seed).filter("s % 3 = 0").select("key", "s", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    entries = listed.select(F.when(F.col("s") % 2 == 0, "adult").otherwise("malware").alias("category"), "key",
                            day(((F.col("s") * 613 + F.col("k") * 175200) % 1051200).cast("int")).alias("listed_at"),
                            F.when(F.col("k") % 2 == 0, "add").otherwise("remove").alias("action"))
    return captures, entries


def op4_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op5_quality_model(spark, sf_dir):
    return quality_model.score_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_extract(spark, sf_dir):
    out = html_extract.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op7_warc(spark, sf_dir):
    got = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "response.payload_bytes", F.coalesce("response.digest", "response.stated_digest").alias("payload_digest"),
                      F.col("response.type").alias("record_type"), F.col("response.refers_to").cast("long").alias("refers_to"))


def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def chat_turns(spark, sf_dir) -> DataFrame:
    """``conversations`` and conversation -1, whose texts look like the template."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return rows.union(extra)


def op9_chat_format(spark, sf_dir):
    out = chat.format_chats(chat_turns(spark, sf_dir))
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, x: F.concat(r, F.lit("\n"), x, F.lit("\n"))), "")
    return out.select("conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                      F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                      F.length("rendered").cast("long").alias("formatted_chars"))


def op10_quality_rules(spark, sf_dir):
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep_text=False)
    return out.select("doc_id", *quality_rules.STATS, "base_failed", "kept")


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(table(spark, sf_dir, "conversations"))))


def op12_lm_score(spark, sf_dir):
    return pitman_yor.score_all(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_resample(spark, sf_dir):
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_secret_scan, op3_url_filter, op4_decontaminate, op5_quality_model, op6_html_extract, op7_warc, op8_packing,
    op9_chat_format, op10_quality_rules, op11_prefix_trie, op12_lm_score, op13_resample)}
