"""Python workers outlive their tasks: what they keep is bounded, the rest goes back."""

import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from flowbook.llm import packing, pitman_yor, store


class Plain:
    def encode_ordinary(self, text):
        return [len(text), 1]


def test_cached_units_are_bounded():
    units = packing._Units(Plain())
    for i in range(500_000):
        assert len(units[f"unit-{i}"]) == 8
    size = sum(sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items()) for d in (units, units.old))
    assert size < 48 << 20


@pytest.mark.parametrize("fails", [False, True])
def test_memory_is_given_back_after_a_task(monkeypatch, fails):
    seen = []
    monkeypatch.setattr(store, "give_back", lambda: seen.append(True))

    def run(batches):
        for b in batches:
            assert not seen
            yield b + 1
        if fails:
            raise ValueError

    out = []
    try:
        out.extend(store.lean(run)(iter([1, 2])))
    except ValueError:
        pass
    assert (out, seen) == ([2, 3], [True])


def test_give_back_runs():
    store.give_back()


@pytest.mark.parametrize("tables", [1, 2])
def test_memory_is_given_back_after_a_group(monkeypatch, tables):
    seen = []
    monkeypatch.setattr(store, "give_back", lambda: seen.append(True))
    run = (lambda a: a) if tables == 1 else (lambda a, b: a + b)
    each = store.lean_group(run)
    assert [each(*[k] * tables) for k in (1, 2)] == [tables, 2 * tables]
    assert seen == [True, True]


def test_a_bucket_is_gathered_in_little_memory():
    """20 chunks of 50,000 entries of a word each followed by rarer words, in rows as large as they are."""
    pack, steps, m, words, rare = pitman_yor.packed, pitman_yor._steps, 50_000, 500, 2_000
    known = pitman_yor.Corpus(10 ** 7, 10 ** 6, np.arange(5, dtype=np.uint64), 1)
    rng, rows, want = np.random.default_rng(1), [], {}
    for chunk in range(20):
        word = np.repeat(np.arange(words), m // words)
        context = np.concatenate([np.sort(rng.choice(known.contexts + rare, m // words, replace=False)) for _ in range(words)])
        n = rng.integers(0, 9, m)
        for k, x in zip(zip(word.tolist(), context.tolist(), strict=True), n.tolist(), strict=True):
            want[k] = want.get(k, 0) + x
        c = pitman_yor._framed(pack(context.astype(np.uint32)), rare.to_bytes(8, "little"), pack(steps(np.arange(rare, dtype=np.uint64) * np.uint64(7))))
        rows.append((chunk, 0, m, pack(steps(np.arange(words, dtype=np.uint64) + np.uint64(3))), pack(np.diff(word, prepend=0).astype(np.uint8)), c, pack(n.astype(np.uint32))))
    table = pa.table(dict(zip(["chunk", "bucket", "n", "a", "b", "c", "d"], map(list, zip(*rows, strict=True)), strict=True)))
    gather = pitman_yor._gather(known)
    tracemalloc.start()
    (row,) = gather(table.take(rng.permutation(20))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    word, context, count = pitman_yor._bucket_arrays(row)
    assert dict(zip(zip(word.tolist(), context.tolist(), strict=True), count.tolist(), strict=True)) == want
    assert row["chunks"] == list(range(20)) and row["sizes"] == [m] * 20
    assert peak < 60 * 20 * m, peak / 20 / m
