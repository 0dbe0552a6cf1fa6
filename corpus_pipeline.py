"""From raw documents to packed sequences, in five stages over ``documents``.

Each stage is a function of (spark, docs, sf_dir) that works on all rows its
predecessor kept; all but the last return the columns of ``documents``.  ``run``
writes each stage as parquet to the shared folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbook.llm import decontaminate, near_dup, packing, quality_rules, secret_scan
from flowbook.llm.queries import table, tokenizer_path
from flowbook.llm.store import mark, release, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others are as they were."""
    return quality_rules.quality_rules(docs).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id stays."""
    return near_dup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark items go."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; ``n_chars`` follows where it gave the length."""
    old = "flowbook_old_chars"
    changed = secret_scan.redacted(docs.withColumn(old, F.length("text")))
    chars = F.when(F.col("n_chars") == F.col(old), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", chars).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and offset.  Lines above the
    limits of the quality rules are cut first, but at the first holder of a source that
    is still here."""
    clean = stored(quality_rules.without_frequent_lines(docs.select("doc_id", "source", "text")), "clean")
    return packing.pack(clean.select("doc_id", "text"), tokenizer_path())


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("decontaminate", benchmark), ("secret_scan", secrets), ("packing", pack)]
#: The stages are no SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  Once a stage is written, what it was made from goes."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, since, mark() - 1)
    return docs
