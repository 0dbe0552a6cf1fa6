"""Prefix trie, language-model scores and importance resampling: brute force, edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from flowbook.llm import pitman_yor, prefix_trie, resampling
from flowbook.llm import queries as Q
from flowbook.llm.store import stored

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(name):
    return ds.dataset(f"{SF}/{name}.parquet").to_table().to_pylist()


# ---- op11

def plain_trie(table, family=5, most=9):
    """{(smallest member, depth): the other columns} from whole sequences."""
    convs = defaultdict(list)
    for c, turn, role, text in table:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    original = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = original.get(c - c % family, [])[:h] + own[h:] if family else own
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
    out = {}
    for n, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(n))))
        out[min(m), len(n)] = (min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest())
    return out


def as_trie(df):
    got = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len({r[:2] for r in got}) == len(got)
    return {r[:2]: r[2:] for r in got}


def test_prefix_trie_of_the_table(spark):
    want = plain_trie([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows("conversations")])
    assert as_trie(Q.op11_prefix_trie(spark, SF)) == want


CHATS = ([(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if t < 60 else f"{c} says {t}") for c in range(3) for t in range(70)]
         + [(7, None, None, None), (7, 0, "user", ""), (7, 0, "user", "b"), (7, 0, "user", "b"), (None, 1, "user", "lost"), (9, 3, "user", "é" * 50_000)]
         + [(c, 0, "user", "same") for c in range(100, 3500)])


@pytest.mark.parametrize("band", [1, 4, 32, 200])
def test_prefix_trie_bands(spark, band):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("clash")).withColumn("depth", F.lit("clash"))
    deep = df.filter("conv_id < 3 OR conv_id = 7") if band < 4 else df  # a round for each band
    table = [c for c in CHATS if band >= 4 or c[0] in (0, 1, 2, 7)]
    t = prefix_trie.turns(deep)
    if band > 1:
        assert as_trie(prefix_trie.trie(prefix_trie.rebuilt(t), band)) == plain_trie(table)
    short = prefix_trie.turns(deep.filter("turn IS NULL OR turn < 9 OR conv_id > 2"))
    assert as_trie(prefix_trie.trie(prefix_trie.plain(short), band)) == plain_trie([x for x in table if x[1] is None or x[1] < 9 or (x[0] or 0) > 2], most=1)


def test_prefix_trie_of_nothing(spark):
    none = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(none))).count() == 0


# ---- op12

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_lm_base_columns(spark):
    docs = {r["doc_id"]: WORD.findall((r["text"] or "").translate(LOWER)) + [None] for r in rows("documents")}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    c = Counter(w for d, ws in docs.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in Q.op12_lm_score(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for d, ws in docs.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + (v + 1))) for w in ws), rel_tol=1e-9)
    mean = lambda f: np.mean([f(got[d]) / len(docs[d]) for d in docs if held[d]])
    assert mean(lambda r: r.score) > mean(lambda r: r.base_score) + 0.1


def model_of(spark, texts, **kw):
    """The model of texts (all training), and its state by bucket as arrays."""
    df = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id long, held boolean, text string")
    known = pitman_yor.corpus(pitman_yor.word_counts(df, 1 << 20), kw.get("contexts", 20), kw.get("bucket_tokens", 200))
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import LongType

    schema = "kind int, chunk long, bucket int, n long, ids array<bigint>, a binary, b binary, c binary, d binary"
    made = stored(df.mapInArrow(pitman_yor._encode(known, 1 << 20, to_arrow_type(LongType())), schema), "test-lm")
    asks = made.filter("kind = 1").select("chunk", "bucket", "n", "a", "b", "c", "d")
    buckets = stored(asks.groupBy("bucket").applyInArrow(pitman_yor._gather(known), pitman_yor._BUCKET), "test-lm")
    return known, buckets, pitman_yor.sample(buckets, known)


def test_lm_counts_and_normalisation(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) % 50) for _ in range(60)]
    known, buckets, model = model_of(spark, texts)
    bigrams = Counter()
    for t in texts:
        ws = [None, *t.split(), "<end>"]
        bigrams.update(zip(ws, ws[1:], strict=False))
    assert known.tokens == sum(bigrams.values()) and known.buckets == known.tokens // 200 + 1 > 5
    total = Counter()
    mass = np.zeros(known.contexts)  # of the words in the buckets, for each context
    last = model.history[-1]
    for row in buckets.collect():
        word, context, count = pitman_yor._bucket_arrays(row.asDict())
        total.update(dict(enumerate(np.bincount(context, count, known.contexts).astype(int))))
        *_, (tables, customers, parents, _) = pitman_yor.replay(model, row["bucket"], word, context, count, len(model.history) - 1)
        assert ((tables > 0) == ((count > 0) & (context > 0))).all() and (tables <= count).all() and (parents <= customers).all()
        for u in range(known.contexts):  # every word under every context
            every = np.arange(word[-1] + 1)
            c, t = np.zeros(len(every)), np.zeros(len(every))
            own = (context == u) & (u > 0)
            c[word[own]], t[word[own]] = count[own], tables[own]
            mass[u] += pitman_yor.predictive(model, last, every, np.full(len(every), u), c, t, customers, parents).sum()
    assert total[1] == len(texts) and sum(total.values()) == known.tokens
    assert (last.tables <= last.customers).all() and (last.tables[last.customers > 0] > 0).all()
    # what is left of 1 is the part of the one word that is not known
    unknown = pitman_yor.root_predictive(model, last, np.zeros(1), np.zeros(1))[0]
    back = np.where(np.arange(known.contexts) > 0, (pitman_yor.STRENGTH + model.discount * last.tables) / (pitman_yor.STRENGTH + last.customers), 1)
    assert np.allclose(mass + back * unknown, 1, atol=1e-9)


def test_seats_keep_customers():
    rng = np.random.default_rng(1)
    customers = rng.integers(1, 400, 200)
    s = pitman_yor.Seats(customers, np.full(200, 0.7), 0.6, rng)
    for _ in range(20):
        s.sweep(np.full(200, 0.7), 4)
        owner = np.repeat(np.arange(200), s.tables)
        assert (s.sizes > 0).all() and (np.bincount(owner, s.sizes, 200) == customers).all()


def test_seats_sample_the_posterior():
    """Tables of a dish of 4 customers, against the weights of all partitions."""
    d, new = 0.4, 0.9
    stirling = {(1, 1): 1.0}  # generalised: sum over partitions of prod (1 - d)(2 - d)..
    for n in range(2, 5):
        for k in range(1, n + 1):
            stirling[n, k] = stirling.get((n - 1, k - 1), 0) + (n - 1 - d * k) * stirling.get((n - 1, k), 0)
    weight = np.array([stirling[4, k] * new ** k for k in range(1, 5)])
    s = pitman_yor.Seats(np.full(40_000, 4), np.full(40_000, new), d, np.random.default_rng(5))
    for _ in range(12):
        s.sweep(np.full(40_000, new), 4)
    have = np.bincount(s.tables, minlength=5)[1:] / 40_000
    assert np.allclose(have, weight / weight.sum(), atol=0.01)


def test_lm_edges(spark):
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(100_000))
    data = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (4, long), (5, "a b"), (5, "a b"), (6, "A B"), (3, "zebra only here")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("word", F.lit("clash"))
    out = pitman_yor.score_all(df)
    got = sorted(map(str, out.collect()))
    assert len(got) == len(data) and got == sorted(map(str, pitman_yor.score_all(df).collect()))
    same = {r.score for r in out.filter("doc_id = 5").collect()}
    assert len(same) == 1 and out.filter("n_tokens < 1 OR score >= 0").count() == 0
    assert out.filter("doc_id = 1").first().n_tokens == 1
    assert pitman_yor.score_all(df.limit(0)).count() == 0 and pitman_yor.score_all(df.limit(0)).dtypes == out.dtypes
    out = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2)
    held = pitman_yor.score_all(spark.createDataFrame([(out, "a")], "doc_id long, text string"))
    assert [tuple(r) for r in held.collect()] == [(out, True, 2, 0, 0, 0.0, 0.0)]


# ---- op13

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_resample(docs, bench, percent=10, most=1, buckets=10_000, least=20):
    def feats(t):
        ws = ALNUM.findall((t or "").translate(LOWER))
        return len(ws), [zlib.crc32(" ".join(ws[i:i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(ws) - n + 1)]

    raw = [(d, *feats(t)) for d, t in docs]
    s, t = Counter(b for *_, f in raw for b in f), Counter(b for x in bench for b in feats(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for d, n, f in raw:
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:percent * len(able) // 100], 1):
        r[5] = k
    return Counter(map(tuple, out))


def test_resample_of_the_table(spark):
    want = plain_resample([(r["doc_id"], r["text"]) for r in rows("documents")], [r["text"] for r in rows("benchmark")])
    got = Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in Q.op13_resample(spark, SF).collect())
    assert got == Counter((r[0], *r[2:]) for r in want)


@pytest.mark.parametrize("most", [1, 3])
def test_resample_edges(spark, most):
    prose = " ".join(f"Word{i % 7} É{i}" for i in range(30))
    data = [(1, None), (2, ""), (3, "..."), (4, prose), (4, prose), (None, prose), (5, prose * 2000), (6, "one two"), *[(k, prose + str(k)) for k in range(10, 60)]]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("rank", F.lit("clash")).withColumn("_range", F.lit("clash"))
    bench = spark.createDataFrame([(1, "Word1 É1 other"), (2, None)], "item_id long, text string")
    out = resampling.resample(df, bench, max_words=most)
    assert Counter(map(tuple, out.collect())) == plain_resample(data, ["Word1 É1 other", None], most=most)
    assert resampling.resample(df.limit(0), bench).count() == 0
    assert resampling.resample(df, bench.limit(0)).filter("rank IS NOT NULL").count() == 5


def test_lm_tokens_take_bounded_memory():
    """A chunk is scanned in runs of texts; its tokens are those of the texts one by one."""
    import tracemalloc

    import pyarrow as pa

    from flowbook.llm import scan

    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50_000, rng.integers(0, 600))) for _ in range(4000)] + ["", None]
    (whole,) = scan.chunks(pa.array(texts), 8 << 20)
    scan._powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    tracemalloc.start()
    words, count, first = pitman_yor._tokens(whole)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(whole.raw) + (50 << 20)
    one = [pitman_yor._tokens(c) for c in scan.chunks(pa.array(texts), 1)]
    assert (words == np.concatenate([w for w, *_ in one])).all() and (count == np.concatenate([n for _, n, _ in one])).all()
    assert (first == np.cumsum(count) - count).all()


def test_lm_rare_words_have_restaurants(spark):
    """Of 300 words none makes up 1 in 20 tokens; each has customers of its own, whose totals all its buckets get."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{int(x)}" for x in rng.integers(0, 300, 40)) for _ in range(50)]
    known, buckets, model = model_of(spark, texts, bucket_tokens=300)
    assert known.contexts == 2 and known.buckets > 5
    follows = Counter(a for t in texts for a in t.split())  # a word's customers: what comes after it, the end too
    every = Counter()
    totals = {}
    for row in buckets.collect():
        word, context, count = pitman_yor._bucket_arrays(row.asDict())
        rare = np.cumsum(pitman_yor.unpacked(row["rare"], row["n_rare"], np.uint64))
        history = model.totals(row["bucket"])
        *_, (tables, *_) = pitman_yor.replay(model, row["bucket"], word, context, count, len(history) - 1)
        assert (context > 0).all() and len(history[-1].tables) == known.contexts + len(rare)
        for i, h in enumerate(rare.tolist()):
            every[h] += int(tables[context == known.contexts + i].sum())
            totals.setdefault(h, set()).add((int(history[-1].customers[known.contexts + i]), int(history[-1].tables[known.contexts + i])))
    assert sorted(n for x in totals.values() for n, _ in x) == sorted(follows.values()) and len(totals) == 300
    assert {h: {(n, every[h]) for n, _ in x} for h, x in totals.items()} == totals


def test_lm_learns_what_follows_rare_words(spark):
    """A rare word tells the next one: its text scores better than the same words in an order never seen."""
    pairs = [(f"left{i}", f"right{i}") for i in range(400)]
    free = (k for k in range(10 ** 6) if zlib.crc32(str(k).encode()) % 7 != 2)
    data = [(next(free), f"{a} {b}") for a, b in pairs for _ in range(4)]
    held = (k for k in range(10 ** 6) if zlib.crc32(str(k).encode()) % 7 == 2)
    known, mixed = [(next(held), " ".join(x)) for x in pairs], [(next(held), f"{a} {b}") for (a, _), (_, b) in zip(pairs, pairs[1:] + pairs[:1], strict=True)]
    df = spark.createDataFrame(data + known + mixed, "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitman_yor.score_all(df, contexts=20).collect()}
    mean = lambda rows: np.mean([got[d] for d, _ in rows])
    assert mean(known) > mean(mixed) + 1


def test_seats_anew():
    """Entries with other customers keep theirs and the tables of the rest."""
    rng = np.random.default_rng(2)
    customers = rng.integers(1, 3000, 100)
    s = pitman_yor.Seats(customers, np.full(100, 0.7), 0.6, rng)
    e, more = np.array([3, 50, 99]), np.array([5000, 1, 40])
    before = np.split(s.sizes, np.cumsum(s.tables)[:-1])
    s.reseat(e, more, np.full(3, 0.7))
    after = np.split(s.sizes, np.cumsum(s.tables)[:-1])
    customers[e] = more
    assert [x.sum() for x in after] == s.customers.tolist() == customers.tolist() and (s.sizes > 0).all()
    assert all((a == b).all() for i, (a, b) in enumerate(zip(before, after, strict=True)) if i not in e)
