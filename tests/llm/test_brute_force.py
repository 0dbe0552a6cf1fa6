"""Each query against a plain Python version on the small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.dataset as ds
import pytest

import corpus_pipeline
from flowbook.llm import near_dup
from flowbook.llm import queries as Q

SF = "/root/testdata/sf0.01"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(name, sf=SF):
    return ds.dataset(f"{sf}/{name}.parquet").to_table().to_pylist()


def got(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def near_components(texts, percent=85):
    """{doc: (set size, smallest reachable doc)} by comparing all pairs that share a shingle."""
    sets = {}
    for d, t in texts.items():
        w = BLANK.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    both = Counter((a, b) for h in holders.values() for i, a in enumerate(sorted(h)) for b in sorted(h)[i + 1:])
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_near_duplicates(spark):
    want = near_components({r["doc_id"]: r["text"] for r in rows("documents")})
    have = got(Q.op1_minhash_near_dedup(spark, SF), "doc_id")
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in have.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in have.items())


def test_near_duplicates_with_shuffled_id_lists(spark, monkeypatch):
    docs = Q.table(spark, SF, "documents")
    want = sorted(map(str, near_dup.keep_one(docs).collect()))
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", 0)
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "-1")
        out = near_dup.keep_one(docs)
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, out.collect())) == want
    finally:
        for n, v in before.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def base_spans(t):
    out = []
    for m in re.finditer(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def test_secret_scan(spark):
    have = got(Q.op2_secret_scan(spark, SF), "doc_id")
    for r in rows("documents"):
        base = base_spans(r["text"] or "")
        h = have[r["doc_id"]]
        assert [h["n_assign"], h["n_access"], h["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
        assert h["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [x for x in h["spans"].split(",") if x and not x.startswith("entropy")] == text.split(",") * bool(text)


def test_url_filter(spark):
    captures, entries = Q.url_tables(spark, SF)
    events = defaultdict(list)
    for e in entries.collect():
        events[e["category"], e["key"]].append((e["listed_at"], e["action"]))
    have = got(Q.op3_url_filter(spark, SF), "page_id")
    blocked = 0
    for c in captures.collect():
        m = re.match(r"[a-z]+://([^/?#:]+)(?:[^/?#]*/([^/?#]+))?", c["url"])
        labels = m[1].lower().split(".")
        keys = {".".join(labels[i:]) for i in range(max(1, len(labels) - 1))} | ({f"{m[1].lower()}/{m[2]}"} if m[2] else set())
        active = sorted({cat for (cat, k), ev in events.items() if k in keys and (past := [x for x in ev if x[0] <= c["fetched_at"]]) and max(past)[1] == "add"})
        assert have[c["page_id"]]["categories"] == ",".join(active)
        blocked += bool(active)
    assert 0 < blocked < len(have)


def decontaminated(texts, items):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k:k + n])].add(i)
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in texts:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k:k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= x
        names = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_decontaminate(spark):
    want = decontaminated([(r["doc_id"], r["text"]) for r in rows("documents")], [(r["item_id"], r["text"]) for r in rows("benchmark")])
    have = got(Q.op4_decontaminate(spark, SF), "doc_id")
    assert {d: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for d, r in have.items()} == want
    assert any(r["contaminated"] for r in have.values())


def test_warc(spark):
    pages = rows("pages")
    first = {}
    for r in pages:
        first[r["html"]] = min(first.get(r["html"], r["page_id"]), r["page_id"])
    have = got(Q.op7_warc(spark, SF), "page_id")
    for r in pages:
        data = (r["html"] or "").encode()
        again = len(data) >= 100 and first[r["html"]] < r["page_id"]
        h = have[r["page_id"]]
        assert (h["payload_bytes"], h["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert (h["record_type"], h["refers_to"]) == (("revisit", first[r["html"]]) if again else ("response", None))


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path())
    t.encode_special_tokens = True
    have = defaultdict(list)
    for r in Q.op8_packing(spark, SF).collect():
        have[r["doc_id"]].append(r)
    total = 0
    docs = rows("documents")
    for r, e in zip(docs, t.encode_batch([r["text"] or "" for r in docs], add_special_tokens=False), strict=True):
        ids = [*e.ids, 2]
        total += len(ids)
        own = sorted(have.pop(r["doc_id"]), key=lambda p: p["piece"])
        assert [p["piece"] for p in own] == list(range(len(own)))
        at = 0
        for p in own:
            assert p["start"] == at and (len(ids) <= 1024 or p["length"] == 1024 or p["piece"] == 0)
            data = b"".join(i.to_bytes(4, "little") for i in ids[at:at + p["length"]])
            assert zlib.crc32(data) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids) and len(own) == -(-len(ids) // 1024)
    assert not have
    sequences = defaultdict(list)
    for r in Q.op8_packing(spark, SF).collect():
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(sequences) <= 1.01 * total / 1024 + 2


def test_chat_format(spark):
    turns = defaultdict(list)
    for r in rows("conversations"):
        turns[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    have = got(Q.op9_chat_format(spark, SF), "conv_id")
    assert set(have) == set(turns)
    for c, t in turns.items():
        t.sort()
        loss = "".join(x for _, r, x in t if r == "assistant")
        h = have[c]
        assert h["n_turns"] == len(t) and h["loss_chars"] == len(loss)
        assert h["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in t).encode()).hexdigest()
        assert h["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def base_stats(text):
    t = text or ""
    w = BLANK.findall(t)
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i:i + 8])].append(i)
    repeated = {k for p in places.values() if len(p) > 1 for i in p for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if BLANK.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


def quality_kept(docs, min_docs=10, percent=5):
    """{doc: base stats, failed, kept} by the rules' definition."""
    held, texts = defaultdict(dict), defaultdict(set)
    for d, host, t in docs:
        texts[host].add(t)
        for x in (t or "").split("\n"):
            if line := tuple(BLANK.findall(x.translate(LOWER))):
                held[host, line].setdefault(t, set()).add(d)
    gone = {k: min(min(d) for d in v.values()) for k, v in held.items() if len(v) > min_docs and 100 * len(v) > percent * len(texts[k[0]])}
    out = {}
    for d, host, t in docs:
        s = base_stats(t)
        failed = s[0] < 20 or 100 * s[4] > 30 * s[0]
        removed = 0
        for x in (t or "").split("\n"):
            line = tuple(BLANK.findall(x.translate(LOWER)))
            if line and gone.get((host, line), d) != d:
                removed += len(line)
        out[d] = (*s, failed, not failed and 100 * (s[0] - removed) >= 30 * s[0])
    return out


def test_quality_rules(spark):
    docs = [(r["doc_id"], r["source"], r["text"]) for r in rows("documents")]
    have = got(Q.op10_quality_rules(spark, SF), "doc_id")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert {d: tuple(r[c] for c in names) for d, r in have.items()} == quality_kept(docs)


def test_pipeline(spark):
    """Each stage's survivors by the plain versions of its rules."""
    docs = {r["doc_id"]: r for r in rows("documents")}
    verdict = quality_kept([(d, r["source"], r["text"]) for d, r in docs.items()])
    left = {d: r["text"] for d, r in docs.items() if verdict[d][-1]}
    left = {d: left[d] for d, (_, c) in near_components(left).items() if c == d}
    hits = decontaminated(left.items(), [(r["item_id"], r["text"]) for r in rows("benchmark")])
    left = {d: t for d, t in left.items() if not hits[d][-1]}
    now = spark.read.parquet(f"{SF}/documents.parquet")
    columns = now.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        now = corpus_pipeline.stored(stage(spark, now, SF), "test")
        assert now.columns == columns
    out = got(now, "doc_id")
    assert set(out) == set(left)
    for d, t in left.items():
        if out[d]["text"] != t:
            assert base_spans(t) or "[SECRET]" in out[d]["text"]
        else:
            assert out[d]["n_chars"] == docs[d]["n_chars"]
        assert not base_spans(out[d]["text"])
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[4][1](spark, now, SF).collect()} == set(left)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_whole_tables(spark, name):
    df = Q.QUERIES[name](spark, "/root/testdata/sf0.001")
    table = "pages" if name.startswith(("op3", "op6", "op7")) else "conversations" if name.startswith("op9") else "documents"
    key = df.columns[0]
    ids = {r[key] for r in rows(table, "/root/testdata/sf0.001")} | ({-1} if table == "conversations" else set())
    assert {r[0] for r in df.select(key).distinct().collect()} == ids
