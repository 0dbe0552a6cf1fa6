"""Near-dedup of a family of texts just under the limit, whose buckets hold all of them."""

import random

import pytest
from pyspark.sql import functions as F

from flowbook.llm import near_dup
from tests.llm.test_brute_force import near_components

SCHEMA = "doc_id long, text string"


@pytest.fixture
def small_bounds(monkeypatch):
    for name, value in (("BLOCK", 8), ("HOT", 16), ("COMMON", 8)):
        monkeypatch.setattr(near_dup, name, value)


def family(n, own, seed):
    """``n`` texts of 180 words in common and ``own`` words each."""
    dice = random.Random(seed)
    word = lambda: "".join(dice.choices("abcdefghijklmnop", k=7))
    shared = [word() for _ in range(180)]
    return [shared + [word() for _ in range(own)] for _ in range(n)]


def with_copies(words, seed):
    """Of every fifth text a copy of other last words, of every seventh an exact one."""
    dice = random.Random(seed)
    near = [w[:-k] + [f"x{dice.random()}"] * k for w in words[::5] for k in (1, 2)]
    return [" ".join(w) for w in [*words, *near, *words[::7]]]


def test_family_under_the_limit_equals_brute_force(spark, small_bounds, monkeypatch):
    texts = with_copies(family(120, 20, 1), 2) + with_copies(family(60, 17, 3), 4) + ["", "a b", "a b"]
    random.Random(5).shuffle(texts)
    used = []
    plain = near_dup._prefix_buckets
    monkeypatch.setattr(near_dup, "_prefix_buckets", lambda *a: used.append(1) or plain(*a))
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    have = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs).collect()}
    assert used and have == near_components(dict(enumerate(texts)))


def test_rows_of_one_id_keep_the_links_of_each_text(spark, small_bounds):
    words = family(80, 20, 6)
    rows = [(i, " ".join(w)) for i, w in enumerate(words)]
    rows += [(0, " ".join(words[40][:-1] + ["other"])), (7, " ".join(words[50][:-1] + ["other"]))]
    docs = spark.createDataFrame(rows, SCHEMA)
    component = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()}
    assert component == {i: {40: 0, 50: 7}.get(i, i) for i in range(80)}


def test_common_shingles_make_no_buckets(spark, small_bounds):
    rows = [(i, i, " ".join(w)) for i, w in enumerate(family(100, 20, 8))]
    texts = spark.createDataFrame(rows, "cls long, comp long, text string")
    hot = texts.select("cls", "comp")
    assert near_dup._prefix_buckets(hot, texts.select("cls", "text"), 85).count() == 0
    near = texts.union(texts.filter("cls < 10").select((F.col("cls") + 500).alias("cls"), (F.col("comp") + 500).alias("comp"), "text"))
    out = near_dup._prefix_buckets(near.select("cls", "comp"), near.select("cls", "text"), 85)
    assert {r.cls for r in out.select("cls").distinct().collect()} == {*range(10), *range(500, 510)}
    assert out.agg(F.max("size")).first()[0] == 2
