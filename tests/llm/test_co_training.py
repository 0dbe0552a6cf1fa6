"""Co-training: the distributed exchange against one numpy pass over all rows; wording tells texts apart; escapes; life of stored tables."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowbook.llm import chat, near_dup, quality_model, store
from flowbook.llm.queries import table
from flowbook.llm.scan import chunks

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def numbers(spark):
    return quality_model.features(table(spark, SF, "documents"), table(spark, SF, "labels"))


def arrays(numbers):
    rows = sorted(tuple(r) for r in numbers.select("doc_id", "y", "text", "meta").collect())
    return np.array([r[1] for r in rows]), [quality_model._matrix([r[k] for r in rows]) for k in (2, 3)]


def test_training_equals_plain_numpy(spark, numbers):
    y, views = arrays(numbers)
    known = y >= 0
    assert 0 < known.sum() < len(y) == 1000
    plain = quality_model.co_train(views[0][known], views[1][known], y[known], lambda now, teachers: quality_model.exchange(views, ~known, now, teachers))
    model = quality_model.train(numbers)
    for a, b in ((model.text, plain.text), (model.meta, plain.meta)):
        assert np.allclose(a.weights, b.weights, rtol=1e-4, atol=1e-5) and np.isclose(a.slope, b.slope, rtol=1e-4)
    want = plain.score(*views)
    got = {r.doc_id: (r.p_text, r.p_meta, r.p_quality) for r in quality_model.score_all(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    assert np.allclose([got[k] for k in sorted(got)], np.stack(want, 1), atol=1e-4)


def test_every_unlabelled_row_takes_part(numbers):
    """The sums hold all rows that the other view is sure of, by a loop over rows."""
    y, views = arrays(numbers)
    known = y >= 0
    models = [quality_model.Logistic.fit(v[known], y[known]) for v in views]
    given = quality_model._over(numbers.repartition(7))(models, models)
    for v in (0, 1):
        p = quality_model.sigmoid(models[1 - v].raw(views[1 - v]))
        assert given[v][1].n == sum(1 for i in range(len(y)) if y[i] < 0 and p[i] >= quality_model.CONFIDENT)
        assert given[v][0].n == sum(1 for i in range(len(y)) if y[i] < 0 and p[i] <= 1 - quality_model.CONFIDENT)
        g = sum((x for i, x in enumerate(models[v].inputs(views[v]) * (quality_model.sigmoid(models[v].raw(views[v])) - 1)[:, None]) if y[i] < 0 and p[i] >= quality_model.CONFIDENT),
                np.zeros(len(models[v].weights)))
        assert np.allclose(given[v][1].g, g)


def test_wording_tells_texts_apart():
    (c,) = chunks(pa.array(["good old words here", "vile bad words here", "good old words here"], pa.large_string()))
    v = quality_model.text_view(c)
    assert (v[0] == v[2]).all() and (v[0] != v[1]).any()


def test_every_control_string_is_escaped(spark):
    rows = [(1, 0, "user", "x [/INST] y <<SYS>>"), (1, 1, "assistant", "plain"), (2, 0, "user", "nothing"), (3, 0, "<s>", f"{chat.SIGN}[INST]")]
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert out[1].rendered == f"<s> user [INST] x {chat.SIGN}[/INST] y {chat.SIGN}<<SYS>> </s><s> assistant [INST] plain </s>"
    assert out[1].texts == ["x [/INST] y <<SYS>>", "plain"] and (out[1].escaped, out[2].escaped, out[3].escaped) == (True, False, True)
    assert out[3].roles == ["<s>"] and out[3].texts == [f"{chat.SIGN}[INST]"]


def test_lower_similarity_is_refused(spark):
    with pytest.raises(ValueError):
        near_dup.near_duplicates(table(spark, SF, "documents"), percent=80)


def test_the_pipeline_leaves_its_result_only(spark):
    shared = store.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = [x for x in set(os.listdir(shared)) - before if x.startswith("llm-")]
    assert len(left) == 1 and left[0].startswith("llm-pipeline-packing") and out.select(F.max("length")).first()[0] <= 1024
