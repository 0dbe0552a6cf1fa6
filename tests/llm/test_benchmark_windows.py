"""The windows of a block, in arrays, against plain dictionaries, hash collisions included."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from flowbook.llm import decontaminate, scan


def found(rows, texts):
    known = decontaminate.Windows(rows)
    (c,) = scan.chunks(pa.array(texts))
    w = c.words(scan.NOT_ALNUM)
    first, length, pairs = known.find(w)
    return sorted((int(w.doc[i]), int(i - w.lo[w.doc[i]]), int(n)) for i, n in zip(first, length, strict=True)), pairs


@pytest.mark.parametrize("collide", [False, True])
def test_against_dictionaries(monkeypatch, collide):
    if collide:  # few hashes, so different windows share one
        windows = scan.Words.windows
        monkeypatch.setattr(scan.Words, "windows", lambda self, n, sums=None: (lambda r: (r[0], r[1] % np.uint64(7)))(windows(self, n, sums)))
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "é"])
    rows = [(f"i{k % 40}", " ".join(word() for _ in range(rng.choice([0, 1, 4, 7, 13, 14, 30])))) for k in range(60)]
    rows += rows[:5] + [("", "A, b! a"), ("x", "")]
    texts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(30)] + [rows[k][1] for k in range(20)] + [""]
    want, items = [], defaultdict(set)
    for item, text in rows:
        own = "".join(x if x.isalnum() else " " for x in text.lower()).split()
        n = min(13, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            items[tuple(own[i:i + n])].add(item)
    pairs = set()
    for d, text in enumerate(texts):
        own = text.lower().replace(",", " ").replace("!", " ").split()
        for n in range(1, 14):
            for i in range(len(own) - n + 1):
                if tuple(own[i:i + n]) in items:
                    want.append((d, i, n))
                    pairs |= {(d, x) for x in items[tuple(own[i:i + n])]}
    assert found(rows, texts) == (sorted(want), sorted(pairs))


def test_no_items():
    assert found([], ["a b"]) == ([], []) and found([("i", "!!")], ["a b"]) == ([], [])
