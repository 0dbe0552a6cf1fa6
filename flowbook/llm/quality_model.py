"""Quality classifier by co-training (op5).

Two logistic models see two views of a document: its text (counts, and its words and
word pairs hashed to ``_WORDS`` places), and its metadata (language, source, length).
Both start from the labelled sample.  In each round both models label every other
document, and the confident pseudo-labels of each view train the other: each task
adds up gradient and Hessian over its documents, and the driver makes a Newton step
from the sums.  A class's pseudo-labels weigh together at most as much as its labels.
Both are then calibrated on labelled rows held out from training, and their evidence
is added to one probability by which all documents are scored.

Texts are read once; the features of each document are numbers in a stored table.
Only the labelled rows are bounded: at most ``MAX_LABELLED``, those of smallest hash of
the id; labelled documents beyond them count as unlabelled.  The exchange covers all
documents, and what reaches the driver is the sums of a fixed number of groups.

Null text is empty; null metadata is a value of its own.  Labels without quality
or document are left out, of several labels of one id the larger counts.  Without
labels of both classes, every probability is 0.5 and all is kept.  Rows are scored
one by one.  Sums are added in the order in which they come, so probabilities repeat to
about 1e-6.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbook.llm.quality_rules import Rules, text_stats
from flowbook.llm.scan import BLANKS, Chunk, chunks, per_doc
from flowbook.llm.store import stored

MAX_LABELLED = 20_000
ROUNDS, STEPS = 3, 3
CONFIDENT = 0.95
_WORDS = 128
#: Groups in which tasks' sums are added before they reach the driver.
_GROUPS = 8
_SOURCES, _LANGS = 32, 16
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def text_view(c: Chunk) -> np.ndarray:
    """Text features, one row a document."""
    w = c.words(BLANKS)
    s = text_stats(c, w, Rules())
    n, chars = np.maximum(1, s["n_words"]), np.maximum(1, s["word_chars"])
    count = lambda table: per_doc(table[c.raw], c.off[:-1], c.off[1:])
    lines = np.maximum(1, per_doc(c.raw == 10, c.off[:-1], c.off[1:]) + 1)
    keys = np.unique(np.rec.fromarrays([w.doc, w.hash]))
    kinds = np.bincount(keys.f0, minlength=c.n) if len(keys) else np.zeros(c.n)
    shape = np.stack([np.log1p(s["n_words"]), s["word_chars"] / n, s["n_symbols"] / n, s["n_dup_lines"] / lines, s["n_repeat_words"] / n, count(_UPPER) / chars,
                     count(_DIGIT) / chars, count(_PUNCT) / chars, n / lines, kinds / n, (s["n_words"] < 20).astype(float),
                     np.log1p(s["n_symbols"]), np.log1p(s["n_dup_lines"]), np.log1p(s["n_repeat_words"])], 1)
    at, pair = w.windows(2)
    hashes, of = np.concatenate([w.hash, pair]), np.concatenate([w.doc, w.doc[at]])
    sign = np.where(hashes >> np.uint64(63) == 1, 1.0, -1.0)
    place = of * _WORDS + (hashes % np.uint64(_WORDS)).astype(np.int64)
    words = np.bincount(place, sign, c.n * _WORDS).reshape(c.n, _WORDS)
    return np.column_stack([shape, words / np.sqrt(n)[:, None]])


def meta_view(lang: list, source: list, n_chars: list) -> np.ndarray:
    out = np.zeros((len(lang), _SOURCES + _LANGS + 10))
    for i, (a, b, n) in enumerate(zip(lang, source, n_chars, strict=True)):
        out[i, crc32(str(b).encode()) % _SOURCES] = 1
        out[i, _SOURCES + crc32(str(a).encode()) % _LANGS] = 1
        size = np.log1p(max(0, n or 0))
        out[i, _SOURCES + _LANGS] = size
        out[i, _SOURCES + _LANGS + 1 + min(8, int(size / 1.5))] = 1
    return out


@dataclass
class Logistic:
    """A logistic model with standardised inputs and a calibration of its score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, decay: float = 1.0) -> Logistic:
        mean, scale = x.mean(0), x.std(0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        out = Logistic(mean, scale, np.zeros(x.shape[1] + 1))
        return replace(out, weights=_newton(out.inputs(x), y, decay))

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        z = np.column_stack([self.raw(x), np.ones(len(x))])
        self.slope, self.shift = map(float, _newton(z, y, 0.1))


def _newton(z: np.ndarray, y: np.ndarray, decay: float) -> np.ndarray:
    w = np.zeros(z.shape[1])
    keep = np.full(z.shape[1], decay)
    keep[-1] = 1e-3
    for _ in range(25):
        p = sigmoid(z @ w)
        g = z.T @ (p - y) + keep * w
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(keep)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    text: Logistic
    meta: Logistic
    prior: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both views' probabilities, and that of their joint evidence (the prior counts once)."""
        a, b = self.text.score(text), self.meta.score(meta)
        return sigmoid(a), sigmoid(b), sigmoid(a + b - self.prior)


@dataclass
class Sums:
    """Of the pseudo-labelled rows of a class: number, gradient and Hessian."""

    n: float
    g: np.ndarray
    h: np.ndarray


def exchange(views: list[np.ndarray], free: np.ndarray, now: list[Logistic], teachers: list[Logistic]) -> list[list[Sums]]:
    """For each view and class the sums over the rows (``free``: unlabelled) that the other view's teacher is sure of."""
    out = []
    for v in (0, 1):
        p = sigmoid(teachers[1 - v].raw(views[1 - v]))
        z = now[v].inputs(views[v])
        q = sigmoid(z @ now[v].weights)
        sums = []
        for label in (0, 1):
            at = free & ((p >= CONFIDENT) if label else (p <= 1 - CONFIDENT))
            zz, qq = z[at], q[at]
            sums.append(Sums(float(at.sum()), zz.T @ (qq - label), (zz * (qq * (1 - qq))[:, None]).T @ zz))
        out.append(sums)
    return out


def _flat(sums: list[list[Sums]]) -> np.ndarray:
    return np.concatenate([np.concatenate([[x.n], x.g, x.h.ravel()]) for view in sums for x in view])


def _shaped(flat: np.ndarray, sizes: list[int]) -> list[list[Sums]]:
    out, at = [], 0
    for k in sizes:
        view = []
        for _ in range(2):
            n, g, h = flat[at], flat[at + 1:at + 1 + k], flat[at + 1 + k:at + 1 + k + k * k]
            view.append(Sums(float(n), g, h.reshape(k, k)))
            at += 1 + k + k * k
        out.append(view)
    return out


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, over_all: Callable[[list[Logistic], list[Logistic]], list[list[Sums]]], rounds: int = ROUNDS, steps: int = STEPS,
             decay: float = 10.0) -> Model | None:
    """The model of labelled rows and of ``over_all``, the ``exchange`` over all other rows.  None without both classes."""
    if len(set(y.tolist())) < 2:
        return None
    held = np.arange(len(y)) % 5 == 4 if min(np.bincount(y)) >= 10 else np.zeros(len(y), bool)
    own = ~held
    views = [text, meta]
    models = [Logistic.fit(views[v][own], y[own], decay) for v in (0, 1)]
    z = [models[v].inputs(views[v][own]) for v in (0, 1)]
    have = np.bincount(y[own], minlength=2)
    for _ in range(rounds):
        teachers = [replace(m) for m in models]
        for _ in range(steps):
            given = over_all(models, teachers)
            for v in (0, 1):
                w = models[v].weights
                q = sigmoid(z[v] @ w)
                keep = np.full(len(w), decay)
                keep[-1] = 1e-3
                g, h = z[v].T @ (q - y[own]) + keep * w, (z[v] * (q * (1 - q))[:, None]).T @ z[v] + np.diag(keep)
                for label, x in enumerate(given[v]):
                    weight = min(1.0, have[label] / max(1.0, x.n))
                    g, h = g + weight * x.g, h + weight * x.h
                models[v] = replace(models[v], weights=w - np.clip(np.linalg.solve(h, g), -5, 5))
    check = held if held.any() else own
    for v in (0, 1):
        models[v].calibrate(views[v][check], y[check])
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    return Model(*models, prior=float(np.log(rate / (1 - rate))))


_FEATURES = "doc_id long, text binary, meta binary"
_META = ["lang", "source", "n_chars"]


def _own(docs: DataFrame) -> DataFrame:
    have = [F.col(c).cast(t).alias(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in zip(_META, ("string", "string", "long"), strict=True)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *have)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = lambda a: pa.array([x.tobytes() for x in a.astype(np.float32)], pa.binary())
    for b in batches:
        for c in chunks(b.column("text")):
            part = b.slice(c.first, c.n)
            meta = meta_view(*[part.column(k).to_pylist() for k in _META])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pack(text_view(c)), pack(meta)], names=["doc_id", "text", "meta"])


def _matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1).astype(np.float64)


def _over(table: DataFrame) -> Callable[[list[Logistic], list[Logistic]], list[list[Sums]]]:
    """``exchange`` over all rows of the features: sums of each task, then of each group of tasks."""
    def over_all(now: list[Logistic], teachers: list[Logistic]) -> list[list[Sums]]:
        sizes = [len(m.weights) for m in now]
        length = sum(2 * (1 + k + k * k) for k in sizes)

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(length)
            for b in batches:
                if b.num_rows:
                    views = [_matrix(b.column(k).to_pylist()) for k in ("text", "meta")]
                    total += _flat(exchange(views, b.column("y").to_numpy(zero_copy_only=False) < 0, now, teachers))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(length)
            for b in batches:
                for x in b.column(0):
                    total += np.frombuffer(x.as_py(), np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        parts = table.select("y", "text", "meta").mapInArrow(own, "sums binary").repartition(_GROUPS).mapInArrow(add, "sums binary").collect()
        return _shaped(sum((np.frombuffer(r[0], np.float64) for r in parts), np.zeros(length)), sizes)

    return over_all


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored: ``doc_id, text, meta`` (32-bit numbers) and ``y``, the label of at most ``MAX_LABELLED`` ids, else -1."""
    marks = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    chosen = marks.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(MAX_LABELLED)  # the documented bound
    numbers = _own(docs).mapInArrow(_features, _FEATURES)
    return stored(numbers.join(F.broadcast(chosen), "doc_id", "left").withColumn("y", F.coalesce("y", F.lit(-1))), "quality")


def train(table: DataFrame, rounds: int = ROUNDS) -> Model | None:
    rows = sorted(tuple(r) for r in table.filter("y >= 0").select("doc_id", "y", "text", "meta").collect())
    if not rows:
        return None
    y = np.array([r[1] for r in rows])
    return co_train(_matrix([r[2] for r in rows]), _matrix([r[3] for r in rows]), y, _over(table), rounds)


def score_all(docs: DataFrame, labels: DataFrame, keep_from: float = 0.5) -> DataFrame:
    """``doc_id``, ``p_text``, ``p_meta``, ``p_quality`` and ``kept`` of every document."""
    table = features(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(train(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                model = sent.value
                scores = model.score(*[_matrix(b.column(k).to_pylist()) for k in ("text", "meta")]) if model else (np.full(b.num_rows, 0.5),) * 3
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, scores), pa.array(scores[2] >= keep_from)],
                                                 names=["doc_id", "p_text", "p_meta", "p_quality", "kept"])

    return table.select("doc_id", "text", "meta").mapInArrow(run, "doc_id long, p_text double, p_meta double, p_quality double, kept boolean")
