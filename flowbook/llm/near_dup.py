"""Near-duplicate documents with SetSketch registers (op1).

A document is the set of its distinct 5-word shingles.  Its sketch has 600
registers: each is the set's smallest exponential hash value on a logarithmic
scale, ``K = floor(1 - log_b(x))`` truncated to one byte, so sketches merge by the
maximum and equal registers get likelier with the similarity.

1. Documents with equal sets are one class (by a 128-bit digest; counted, never paired).
2. Classes that agree in one of 30 bands of 6 of the first 180 registers are
   candidates: a pair at
   similarity 0.85 shares no band with a probability below 1e-6.
3. A bucket's candidates are screened by the joint likelihood of similarity given
   the registers that are larger, smaller and equal and the two exact set sizes;
   a pair is dropped only if 0.85 is less likely than the best value by 4.75
   standard deviations (one link in a million) or the sizes rule it out.
4. Links are confirmed on full sets, read from the texts.

Pairs are tested in two passes: a spanning forest of each bucket first; then,
with the components known, every pair left that lies in different components, at
its first common band.  So a group of copies costs about its size and not its
square, and no pair that could join two components stays untested.  Buckets are
dealt in blocks of ``BLOCK`` members, and in the second pass in pairs of blocks;
a hot bucket spreads over many tasks.  A bucket that holds more than ``HOT`` classes
in the second pass (a family of texts just under the limit, say) isn't compared
pair by pair: its classes are dealt anew by the shingles of their prefixes.  With
the shingles that many of these texts have put last, and t the limit, two linked
texts share a shingle that is among the first ``n - ceil(2 t n / (1 + t)) + 1`` of
the one with fewer shingles, its short prefix, and among the first ``n - ceil(t n)
+ 1`` of the other.  Texts meet where one of them has the shingle in its short
prefix, so what a family has in common makes no pairs, and no link is lost.

Only the banded registers of a class are shuffled to find buckets.  Whole
sketches and texts are then read for the classes that share a bucket.  Lists of
ids (bucket members, documents to drop) are broadcast up to ``BROADCAST_IDS``
ids; longer ones are joined by shuffle, with the same rows.

Texts without words and null texts have an empty set and are linked with nothing.
Rows with one doc_id are one document: it is linked with whatever one of its
texts is linked with.  Rows without doc_id are not linked and are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowbook.llm.components import components
from flowbook.llm.scan import BLANKS, Chunk, between, chunks, mix
from flowbook.llm.store import lean, shuffle_parts, stored

SHINGLE = 5
REGISTERS, BANDS, BAND = 600, 30, 6
SURE = 4.75  # standard deviations
FIRST = 3  # the first pass looks at one bucket in three
BASE, RATE, TOP = 1.12, 10.0, 254
BLOCK = 512
HOT = 2048
COMMON = 64  # a shingle of more texts of hot buckets than this is put last
BROADCAST_IDS = 2_000_000  # 8 bytes each, about 100 MB as a hash table
_rng = np.random.default_rng(20240311)
_XOR = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)


def shingles(chunk: Chunk, size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's set as sorted distinct 64-bit hashes."""
    w = chunk.words(BLANKS)
    at, h = w.windows(size)
    cut = np.searchsorted(w.doc[at], np.arange(chunk.n + 1))
    out = []
    for d in range(chunk.n):
        if w.count[d] >= size:
            v = np.sort(h[cut[d]:cut[d + 1]])
            out.append(v[np.append(True, v[1:] != v[:-1])])
        elif w.count[d]:
            out.append(between(w.sums, w.lo[d:d + 1], w.hi[d:d + 1]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The sketch of each set, none of them empty."""
    x = (mix(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
    start = np.cumsum([0, *map(len, sets[:-1])])
    least = np.empty((len(sets), REGISTERS), np.uint32)
    h = np.empty_like(x)
    for j in range(REGISTERS):
        np.bitwise_xor(x, _XOR[j], out=h)
        np.multiply(h, _MUL[j], out=h)
        least[:, j] = np.minimum.reduceat(h, start)
    value = -np.log1p(-(least + 0.5) / 2.0**32) / RATE  # an exponential variable's minimum
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP + 1).astype(np.uint8)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in chunks(b.column("text")):
            sets = shingles(c)
            some = [s for s in sets if len(s)]
            sketch = iter(registers(some)) if some else iter(())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(c.first, c.n), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                 pa.array([next(sketch).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "digest", "registers"])


def candidate(a: np.ndarray, b: np.ndarray, na: int, nb: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sketches ``b`` may be as similar to the sketch ``a``, and their equal registers."""
    need = percent / 100
    equal = (b == a).sum(1)
    ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (equal >= REGISTERS * need - SURE * np.sqrt(REGISTERS * need * (1 - need)))
    at = np.flatnonzero(ok & (equal < REGISTERS * need))
    if len(at):
        more = (b[at] < a).sum(1)
        ok[at] = _likely(more, REGISTERS - more - equal[at], equal[at], na, nb[at], need)
    return ok, equal


def log_likelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, equal: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Of similarity ``j``, given how many registers are larger, smaller and equal, and the set sizes."""
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    return more * np.log(up) + less * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))


def _likely(more, less, equal, na, nb, need: float) -> np.ndarray:
    """``need`` against the best lower similarity; lower ones than the grid's have fewer equal registers."""
    top = np.minimum(na / nb, nb / na)
    best = np.max([log_likelihood(np.minimum(j, top), more, less, equal, na, nb) for j in np.linspace(0.75, 1, 12) * need], 0)
    return 2 * (best - log_likelihood(np.minimum(need, top), more, less, equal, na, nb)) <= SURE**2


def _tree(regs: np.ndarray, n: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the candidates, by most equal registers (Prim)."""
    best, via, out = np.full(len(n), -1), np.full(len(n), -1), []
    left = np.ones(len(n), bool)
    for _ in range(len(n)):
        i = int(np.where(left, best, -2).argmax())
        left[i] = False
        if via[i] >= 0:
            out.append((int(via[i]), i))
        rest = np.flatnonzero(left)
        if len(rest):
            ok, equal = candidate(regs[i], regs[rest], n[i], n[rest], percent)
            ok &= equal > best[rest]
            best[rest[ok]], via[rest[ok]] = equal[ok], i
    return out


def _cross(regs: np.ndarray, n: np.ndarray, comp: np.ndarray, part: np.ndarray, band: int, percent: int) -> list[tuple[int, int]]:
    """Candidates in different components, and in different parts if there are
    two, that agree in no band before ``band``."""
    out, two = [], bool((part != part[0]).any())
    first = regs[:, :(band + 1) * BAND]
    for i in range(len(n) - 1):
        rest = np.arange(i + 1, len(n))
        rest = rest[(comp[rest] != comp[i]) & ((part[rest] != part[i]) | (not two))]
        if len(rest):
            same = (first[rest] == first[i]).reshape(len(rest), band + 1, BAND).all(2)
            rest = rest[~same[:, :band].any(1)]
        if len(rest):
            ok, _ = candidate(regs[i], regs[rest], n[i], n[rest], percent)
            out += [(i, int(j)) for j in rest[ok]]
    return out


def _pairs(choose):
    """Pairs (a < b) of the groups of equal ``key``; rows come sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        found: set[tuple[int, int]] = set()

        def close() -> None:
            if len(held) > 1:
                cls = [r[1] for r in held]
                regs = np.frombuffer(b"".join(r[3] for r in held), np.uint8).reshape(len(held), REGISTERS)
                n, comp, part = (np.array([r[k] for r in held], np.int64) for k in (2, 4, 5))
                found.update((min(cls[i], cls[j]), max(cls[i], cls[j])) for i, j in choose(regs, n, comp, part, held[0][6]) if cls[i] != cls[j])
            held.clear()

        for b in batches:
            for row in zip(*[b.column(k).to_pylist() for k in ("key", "cls", "n", "registers", "comp", "part", "band")], strict=True):
                if held and held[0][0] != row[0]:
                    close()
                held.append(row)
            if len(found) > 50_000:
                yield _as_batch(found)
        close()
        yield _as_batch(found)

    return run


def _as_batch(found: set[tuple[int, int]]) -> pa.RecordBatch:
    rows = sorted(found)
    found.clear()
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([y for _, y in rows], pa.int64())], names=["a", "b"])


def _grouped(rows: DataFrame, choose) -> DataFrame:
    """Distinct candidate pairs; ``rows`` have key, cls, n, registers, comp, part, band."""
    dealt = rows.repartition(2 * shuffle_parts(rows.sparkSession), "key").sortWithinPartitions("key", "cls")
    return dealt.mapInArrow(lean(_pairs(choose)), "a long, b long").distinct()


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 400):
                part = b.slice(at, 400)
                x, y = ([s for c in chunks(part.column(k)) for s in shingles(c)] for k in ("ta", "tb"))
                keep = []
                for p, q in zip(x, y, strict=True):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def _linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    a = texts.select(F.col("cls").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("cls").alias("b"), F.col("text").alias("tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(lean(_confirm(percent)), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable
    over links of at least ``percent`` % similarity) and ``kept``.  The bands are
    chosen for 85 and more; a lower ``percent`` is refused rather than lose links."""
    if percent < 85:
        raise ValueError("the bands find links of 85 % and more only")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = stored(own.mapInArrow(lean(_sketches), "doc_id long, n_shingles long, digest binary, registers binary"), "sketches")
    classes = stored(sketch.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("cls"), F.first(F.substring("registers", 1, BANDS * BAND)).alias("banded")), "classes")

    # buckets of two classes or more
    buckets = classes.select("cls", F.posexplode(_bands(F.col("banded"))).alias("band", "bucket"))  # 64-bit keys; a clash only adds candidates
    full = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stored(buckets.join(full, "bucket"), "members")
    ids = _ids(members.select(F.col("cls").alias("doc_id")))
    texts = stored(own.join(ids, "doc_id", "left_semi").filter("text IS NOT NULL").select(F.col("doc_id").alias("cls"), "text"), "texts")
    # one sketch for each text of a member; rows that repeat count once
    sketches = stored(sketch.join(ids, "doc_id", "left_semi").filter("digest IS NOT NULL").groupBy("doc_id", "digest").agg(
        F.first("n_shingles").alias("n"), F.first("registers").alias("registers")).select(F.col("doc_id").alias("cls"), "n", "registers"), "member-sketches")

    # first pass: a spanning forest of each block
    some = members.filter(F.pmod("bucket", F.lit(FIRST)) == 0)
    rows = some.join(sketches, "cls").select(F.xxhash64("bucket", _block()).alias("key"), "cls", "n", "registers",
                                             F.lit(0).cast("long").alias("comp"), F.lit(0).alias("part"), "band")
    tested = stored(_grouped(rows, lambda regs, n, comp, part, band: _tree(regs, n, percent)), "pairs")
    links = stored(_linked(tested, texts, percent), "links")
    comp = stored(components(links), "components")

    # second pass: buckets that hold different components
    known = members.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
    left = stored(known.join(_mixed(known), "bucket"), "mixed")
    rows = _block_pairs(left.filter(F.col("size") <= HOT).join(sketches, "cls"))
    hot = left.filter(F.col("size") > HOT).select("cls", "comp").distinct()
    if not hot.isEmpty():
        rows = rows.union(_prefix_pairs(stored(_prefix_buckets(hot, texts, percent), "prefix-buckets").join(sketches, "cls")))
    found = _grouped(rows, lambda regs, n, comp, part, band: _cross(regs, n, comp, part, band, percent))
    more = stored(_linked(found.join(tested, ["a", "b"], "left_anti"), texts, percent), "links")
    comp = stored(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "components")

    least = F.coalesce("component", "cls").alias("component_id")
    of_class = classes.select("digest", "cls").join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("digest", least)
    in_class = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    linked = sketch.filter(in_class).join(of_class, "digest").select("doc_id", "n_shingles", "component_id")
    alone = sketch.filter(~in_class).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _blocks() -> Column:
    return F.ceil(F.col("size") / BLOCK).cast("int")


def _block() -> Column:
    return F.pmod(F.xxhash64("cls"), _blocks()).cast("int")


def _mixed(members: DataFrame) -> DataFrame:
    """The buckets that hold different components, of rows (bucket, comp, ..)."""
    return members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")


def _block_pairs(left: DataFrame) -> DataFrame:
    """Each member of a bucket once for each pair of blocks that its own is part of."""
    pair = F.transform(F.sequence(F.lit(0), _blocks() - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    return left.withColumn("block", _block()).withColumn("p", F.explode(pair)).select(
        F.xxhash64("bucket", "p.i", "p.j").alias("key"), "cls", "n", "registers", "comp", F.col("block").alias("part"), "band")


def _shingle_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in chunks(b.column("text")):
            part = b.slice(c.first, c.n)
            sets = shingles(c)
            yield pa.RecordBatch.from_arrays(
                [part.column("cls"), part.column("comp"), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array([mix(s).view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["cls", "comp", "digest", "n", "shingles"])


def _prefix_buckets(hot: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(bucket, cls, comp, short, shorts, size): the classes ``hot`` (cls, comp) by the
    shingles of their prefixes, where such a shingle stands in different components
    and in a ``short`` prefix (of ``shorts`` members).  Any one order of all shingles is
    exact; common ones come last here.  Shingles are counted from partial counts, and
    a text's own are all that is sorted together."""
    own = stored(texts.join(hot, "cls").select("cls", "comp", "text").mapInArrow(lean(_shingle_lists), "cls long, comp long, digest binary, n long, shingles array<long>"), "hot-shingles")
    each = own.select("cls", "comp", "digest", "n", F.explode("shingles").alias("bucket")).distinct()
    common = _ids(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") > COMMON).select("bucket")).withColumn("common", F.lit(1))
    place = F.row_number().over(Window.partitionBy("cls", "digest").orderBy(F.coalesce("common", F.lit(0)), "bucket"))
    upto = lambda times, of: F.col("n") - F.expr(f"(n * {times} + {of - 1}) div {of}") + 1
    prefixes = stored(each.join(common, "bucket", "left").withColumn("place", place).filter(F.col("place") <= upto(percent, 100)).groupBy("bucket", "cls").agg(
        F.first("comp").alias("comp"), F.max(F.col("place") <= upto(2 * percent, 100 + percent)).alias("short")), "prefixes")
    met = prefixes.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count_if("short").alias("shorts"), F.count(F.lit(1)).alias("size"))
    return prefixes.join(met.filter("lo < hi AND shorts > 0").select("bucket", "shorts", "size"), "bucket")


def _prefix_pairs(met: DataFrame) -> DataFrame:
    """Members with a bucket's shingle in their short prefix (part 0) against all (part 1), in pairs of blocks."""
    shorts = F.ceil(F.col("shorts") / BLOCK).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    until = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = lambda part: [F.xxhash64("bucket", "i", "j").alias("key"), "cls", "n", "registers", "comp", F.lit(part).alias("part"), F.lit(0).alias("band")]
    return met.filter("short").withColumn("i", deal(shorts)).withColumn("j", until(_blocks())).select(*columns(0)).union(
        met.withColumn("i", until(shorts)).withColumn("j", _block()).select(*columns(1)))


def _bands(regs: Column) -> Column:
    """A key for each band's number and registers."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(regs, k * BAND + 1, F.lit(BAND))))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """``docs`` without the documents that are not their component's smallest id."""
    gone = _ids(near_duplicates(docs, id_col, text_col, percent).filter("NOT kept").select(F.col("doc_id").alias("flowbook_gone")))
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col("flowbook_gone"), "left_anti")


def _ids(rows: DataFrame) -> DataFrame:
    """The distinct ids in ``rows``, marked for broadcast if there are at most ``BROADCAST_IDS``."""
    ids = stored(rows.distinct(), "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
