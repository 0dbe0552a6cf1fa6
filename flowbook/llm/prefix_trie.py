"""Conversation prefix trie with a depth-band rollup (op11).

A node is a distinct sequence of first ``d`` turns (role, text); its members are
the conversations that start with it.  Turns are reduced to their MD5 and length
as they are read; a node's key is the exclusive or of two 64-bit hashes of (place,
turn) over its turns, a running window, so no conversation is gathered.  Nodes are
a grouping by key, pre-aggregated in every task, so a first turn that a third of
all conversations share is no hot group.

Subtree sums are rolled up by bands of ``band`` depths.  A node adds to its
ancestors inside its band only (at most ``band`` rows); then, from the deepest band
up, the completed totals of a band's roots are added to their ancestors in the band
above.  So there are as many rounds as bands, none where no conversation is longer
than ``band`` - 1 turns, and a node never makes more than ``band`` + 1 rows.

The ids of conversations that end at a node are joined in pieces of 1,024
neighbouring ids; where a node has several, its pieces are streamed in order
through one digest, so their number is not bounded by memory.

Turns are ordered by turn, null first, then by role and the text's MD5; repeated
rows are repeated turns.  Null role and null text are empty.  Rows without a
conversation id belong to no conversation.  Without conversations there is no node.
Long texts are read whole.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowbook.llm.store import shuffle_parts, stored

BAND = 32
#: Conversations of a family, up to 63.
FAMILY = 5
_PIECE_BITS = 10
#: No more than so many parents can have more than 1 / so many of all nodes as children.
_HEAVY = 10_000


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", family: int = FAMILY) -> DataFrame:
    """``base`` (of the family), ``conv, place`` (1, 2, ..), ``a, b`` (hashes of the turn), ``bytes`` (of its text in UTF-8)."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    c = F.col(conv).cast("long")
    read = rows.filter(F.col(conv).isNotNull()).select((c - F.pmod(c, F.lit(family))).alias("base"), c.alias("conv"), F.col(turn).alias("turn"), r.alias("role"),
                                                       F.md5(t).alias("digest"), F.octet_length(t).cast("long").alias("bytes"))
    read = read.repartition(shuffle_parts(rows.sparkSession), "base")
    return read.select("base", "conv", "bytes", F.xxhash64(F.lit(1), "role", "digest").alias("a"), F.xxhash64(F.lit(2), "digest", "role").alias("b"),
                       F.row_number().over(Window.partitionBy("base", "conv").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")).alias("place"))


def shared_head(conv: Column, most: int = 9) -> Column:
    """How many first turns of its family's first conversation ``conv`` takes over: crc32(decimal conv) % most."""
    return (F.crc32(conv.cast("string")) % most).cast("int")


def rebuilt(t: DataFrame, family: int = FAMILY, most: int = 9) -> DataFrame:
    """The conversations whose first ``shared_head`` turns are those of their family's
    first one, ``conv - conv % family`` (the remainder is never negative).

    ``base, conv, part, place, a, b, bytes``, in order of (part, place): part 0 is one row
    a conversation, the place before its first turn, 1 what it takes over, 2 its own.
    A family's conversations meet in one task, row by row; which of them exist is a
    set of bits."""
    away = (F.col("conv") - F.col("base")).cast("int")
    here = t.select("*", away.alias("away"))
    here = here.select("*", F.bit_or(F.expr("shiftleft(1L, away)")).over(Window.partitionBy("base")).alias("there"))
    goes = lambda when, to, part: F.when(when, F.struct(to.alias("to"), F.lit(part).alias("part")))
    first = F.col("away") == 0
    made = [goes(F.col("place") == 1, F.col("conv"), 0), goes(first | (F.col("place") > shared_head(F.col("conv"), most)), F.col("conv"), 2)]
    for k in range(1, family):
        to = F.col("base") + k
        made.append(goes(first & (F.col("place") <= shared_head(to, most)) & (F.getbit("there", F.lit(k)) == 1), to, 1))
    out = here.select("base", "place", "a", "b", "bytes", F.explode(F.array_compact(F.array(*made))).alias("x"))
    return out.select("base", F.col("x.to").alias("conv"), F.col("x.part").alias("part"), "place", "a", "b", "bytes")


def plain(t: DataFrame) -> DataFrame:
    """The conversations as they are, in the form of ``rebuilt``."""
    parts = F.when(F.col("place") == 1, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(2)))
    return t.select("base", "conv", F.explode(parts).alias("part"), "place", "a", "b", "bytes")


def steps(convs: DataFrame, band: int = BAND) -> DataFrame:
    """One row for each prefix of each conversation: ``conv, depth, key, parent, bytes,
    ends`` (it is all of the conversation) and ``path``, the keys of its ancestors that
    it adds to: those in its band, for a band's root those in the band above."""
    w = Window.partitionBy("base", "conv").orderBy("part", "place")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    turn = convs.select("*", (F.row_number().over(w) - 1).alias("depth"))
    bits = lambda c: F.when(F.col("part") > 0, F.xxhash64("depth", c)).otherwise(F.lit(0))
    keyed = turn.select("base", "conv", "part", "place", "depth", "bytes", F.lead("part").over(w).isNull().alias("ends"),
                        F.struct(F.bit_xor(bits("a")).over(upto).alias("a"), F.bit_xor(bits("b")).over(upto).alias("b")).alias("key"))
    before = F.collect_list("key").over(w.rowsBetween(-band, -1))
    n = F.when((F.col("depth") % band == 0) & (F.col("depth") > 0), F.lit(band)).otherwise(F.col("depth") % band)
    pathed = keyed.select("*", before.alias("before"), n.alias("n"))
    path = F.when(F.col("n") > 0, F.slice("before", -F.col("n"), F.col("n"))).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))
    return pathed.select("conv", F.col("depth").cast("long").alias("depth"), "key", F.get("before", F.size("before") - 1).alias("parent"), "bytes", "ends", path.alias("path"))


def _ends(rows: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of the nodes at which conversations end."""
    piece = F.shiftright("conv", _PIECE_BITS)
    pieces = (rows.filter("ends").groupBy("key", piece.alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")))
    pieces = stored(pieces, "trie-ends")
    several = pieces.groupBy("key").agg(F.count("*").alias("n"), F.first("ids").alias("ids"))
    one = several.filter("n = 1").select("key", F.sha2("ids", 256).alias("ends_sha256"))
    large = pieces.join(several.filter("n > 1").select("key"), "key", "left_semi")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) == key:
                    h.update(b",")
                else:
                    if key is not None:
                        done.append((*key, h.hexdigest()))
                    key, h = (a, b), hashlib.sha256()
                h.update(ids.encode())
            yield _rows(done)
        if key is not None:
            yield _rows([(*key, h.hexdigest())])

    parts = shuffle_parts(rows.sparkSession)
    flat = large.select("key.a", "key.b", "piece", "ids").repartition(parts, "a", "b").sortWithinPartitions("a", "b", "piece").select("a", "b", "ids")
    streamed = flat.mapInArrow(digest, "a long, b long, ends_sha256 string").select(F.struct("a", "b").alias("key"), "ends_sha256")
    return one.union(streamed)


def _rows(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
    cols = list(zip(*done, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["a", "b", "ends_sha256"])


def rollup(nodes: DataFrame, band: int = BAND) -> DataFrame:
    """``key, n_children, n_leaves, saved`` of each node, over its subtree with itself.

    ``nodes``: ``key, depth, path, leaf`` and ``saved`` of the node alone."""
    root = (F.col("depth") % band == 0) & (F.col("depth") > 0)
    add = lambda key, child, leaf, saved: F.struct(key.alias("key"), child.cast("long").alias("n_children"), leaf.alias("n_leaves"), saved.alias("saved"))
    zero = F.lit(0).cast("long")
    own = F.array(add(F.col("key"), zero, F.col("leaf"), F.col("saved")))
    # A band's root is a child of the last in its path, and adds its total to the path later.
    up = F.transform("path", lambda k, i: add(k, (i == F.size("path") - 1).cast("long"), F.when(root, zero).otherwise(F.col("leaf")), F.when(root, zero).otherwise(F.col("saved"))))
    up = F.filter(up, lambda x: ~root | (x["n_children"] > 0))
    sums = [F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")]
    within = stored(nodes.select(F.explode(F.concat(own, up)).alias("x")).select("x.*").groupBy("key").agg(*sums), "trie-bands")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    if deepest < band:
        return within
    roots = stored(nodes.filter(root).select("key", "depth", "path").join(within.select("key", "n_leaves", "saved"), "key"), "trie-roots")
    carried, more = None, []
    for b in range(deepest // band, 0, -1):
        at = roots.filter(F.col("depth") == b * band)
        if carried is not None:
            c = carried.select("key", F.col("n_leaves").alias("l"), F.col("saved").alias("s"))
            at = at.join(c, "key", "left").select("path", (F.col("n_leaves") + F.coalesce("l", zero)).alias("n_leaves"), (F.col("saved") + F.coalesce("s", zero)).alias("saved"))
        carried = stored(at.select(F.explode("path").alias("key"), "n_leaves", "saved").groupBy("key").agg(*sums[1:]), "trie-carried")
        more.append(carried)
    all_sums = within
    for c in more:
        all_sums = all_sums.unionByName(c.withColumn("n_children", zero))
    return all_sums.groupBy("key").agg(*sums)


def trie(convs: DataFrame, band: int = BAND) -> DataFrame:
    """The nodes of conversations as ``rebuilt`` or ``plain`` give them: ``conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    rows = stored(steps(convs, band), "trie-steps")
    nodes = rows.groupBy("key").agg(
        F.min("conv").alias("conv_id"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"),
        F.sum(F.col("ends").cast("long")).alias("n_ends"), F.first("parent").alias("parent"), F.first("path").alias("path"))
    alone = F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(F.lit(0)).cast("long")
    nodes = stored(nodes.select("*", (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"), alone.alias("saved")), "trie-nodes")
    total = (nodes.select("key", "conv_id", "depth", "n_convs", "n_ends", "parent")
             .join(rollup(nodes.select("key", "depth", "path", "leaf", "saved"), band), "key").join(_ends(rows), "key", "left"))
    total = stored(total, "trie-totals")
    # A parent with very many children is one of at most _HEAVY, whatever the table: those are broadcast.
    most = max(1000, total.count() // _HEAVY)
    ids = total.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    heavy = F.broadcast(ids.filter(F.col("n_children") > most).select("up", F.col("parent_conv_id").alias("heavy_id")))
    known = total.join(heavy, total["parent"] == heavy["up"], "left").drop("up")
    light = ids.filter(F.col("n_children") <= most).select("up", "parent_conv_id")
    far = known.filter("heavy_id IS NULL AND depth > 0").drop("heavy_id").join(light, F.col("parent") == F.col("up"))
    near = known.filter("heavy_id IS NOT NULL OR depth = 0").withColumnRenamed("heavy_id", "parent_conv_id")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
             F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")]
    return far.select(*names).unionByName(near.select(*names))
