"""Lines above the limits are cut from the text, but at their first holder."""

from collections import defaultdict

import pytest
import corpus_pipeline
from flowbook.llm import packing, quality_rules
from flowbook.llm.queries import table, tokenizer_path

from .test_brute_force import BLANK, LOWER, SF, rows

NOTICE = "All rights reserved by the desk"


def cleaned(docs, min_docs=10, percent=5):
    """[(doc, text)] by the rules' definition."""
    norm = lambda x: tuple(BLANK.findall(x.translate(LOWER)))
    held, texts = defaultdict(dict), defaultdict(set)
    for d, host, t in docs:
        texts[host].add(t)
        for x in (t or "").split("\n"):
            if norm(x) and d is not None:
                held[host, norm(x)].setdefault(t, set()).add(d)
    first = {k: min(min(d) for d in v.values()) for k, v in held.items() if len(v) > min_docs and 100 * len(v) > percent * len(texts[k[0]])}
    return [(d, t if t is None else "\n".join(x for x in t.split("\n") if not norm(x) or first.get((host, norm(x)), d) == d)) for d, host, t in docs]


def made():
    """Notices as first, middle, last, repeated and only line, with blanks and in another case, and texts without one."""
    text = lambda i: [f"{NOTICE}\n own {i} é\n\n x", f"own {i}\r\n  ALL rights\treserved by the desk \nend\n", f"own {i}\n{NOTICE}", f"{NOTICE}\nown {i}\n{NOTICE}\n", f"own {i}"][i % 5]
    return [(i, ("a", None)[i % 2], text(i)) for i in range(200, 0, -1)] + [(201, "a", NOTICE), (202, "a", None), (203, "a", ""), (None, "a", f"{NOTICE}\nz"), (300, "b", NOTICE)]


@pytest.mark.parametrize("limit", [1_000_000, -1])
def test_lines_are_cut(spark, limit):
    table(spark, SF, "documents")  # workers find the package
    rules = quality_rules.Rules(max_broadcast_lines=limit)
    docs = spark.createDataFrame(made(), "doc_id long, source string, text string")
    out = quality_rules.without_frequent_lines(docs, rules)
    assert out.columns == docs.columns
    want = cleaned(made())
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
    assert sum(t != c for (_, _, t), (_, c) in zip(made(), want, strict=True)) > 150
    both = quality_rules.quality_rules(docs, rules, clean_col="clean").collect()
    words = lambda t: len(BLANK.findall(t or ""))
    assert all(words(r.text) - words(r.clean) == r.n_removed_words for r in both) and len(both) == len(want)


def test_the_corpus(spark):
    docs = [(r["doc_id"], r["source"], r["text"]) for r in rows("documents")]
    out = quality_rules.without_frequent_lines(table(spark, SF, "documents"))
    assert {r.doc_id: r.text for r in out.collect()} == dict(cleaned(docs))


def test_the_pipeline_packs_texts_without_them(spark):
    docs = spark.createDataFrame([(*r, "en", len(r[2] or "")) for r in made() if r[0]], "doc_id long, source string, text string, lang string, n_chars long")
    want = spark.createDataFrame(cleaned([r for r in made() if r[0]]), "doc_id long, text string")
    pieces = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert pieces(corpus_pipeline.STAGES[-1][1](spark, docs, SF)) == pieces(packing.pack(want, tokenizer_path()))
