"""Trie of conversation prefixes, measured by the Euler-tour technique.

A node is a distinct sequence of first turns. It is found by its depth and two 64-bit sums of its turns' hashes, which
prefix sums give for all prefixes of a conversation at once. Every node has an enter and an exit arc; the arcs of the
whole trie form one list (enter, then the children from first to last, then exit). The list is ranked distributedly:
nodes are numbered in ranges of (smallest member, depth), so that much of the list stays within a range; each range
follows its own arcs, and pointer doubling, a join for each doubling, ranks the list of the arcs between ranges. That takes
a number of rounds that grows with the logarithm of the arcs, whatever the depth or the width of the trie. What a
subtree holds is then the difference of two prefix sums, at its exit and at its enter arc.

Turns become hashes and lengths in the scan; no text is shuffled. Long conversations, wide nodes and the tour itself are
summed and linked in blocks of 1,024 (:mod:`cohortlens.llm.shared`), and the members that end at a node are written to
text in ranges before one hash runs over them, so that no hot key is one task's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.layout import bounded, cut_lineage
from cohortlens.llm.shared import BLOCK, prefix_sums

#: Most turns that a conversation takes over from the first conversation of its hundred.
SHARED_TURNS = 5
#: Arcs between ranges that are joined map-side (24 bytes each).
SHIP_ROWS = 200_000
_SUM = "decimal(38,0)"


def places(df: DataFrame, group: str, order: list[str], times: str) -> DataFrame:
    """``df`` with ``place`` (long): the number of rows before it in its ``group`` by ``order``, a row counting ``times``.

    Rows are dealt into ranges of (group, order) and counted inside each; the groups' rows of earlier ranges are
    added from a table with a row for each range and group. Rows should be distinct."""
    ranged = cut_lineage(df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", group).orderBy(*order)
    counts = ranged.groupBy("_range", group).agg(F.sum(times).alias("_n"))
    before = counts.select("_range", group, (F.sum("_n").over(Window.partitionBy(group).orderBy("_range")) - F.col("_n"))
                           .alias("_before"))
    return ranged.withColumn("_to", F.sum(times).over(inside)).join(before, ["_range", group]).select(
        *df.columns, (F.col("_before") + F.col("_to") - F.col(times)).alias("place"))


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), h1, h2 (hashes of role and text), size (code points of the text) of every turn.

    In order of turn, null first; turns of equal number by their hashes. Null role or text is empty; rows without a
    conv_id belong to no conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    slim = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit("2"), text, role).alias("h2"), F.length(text).cast("long").alias("size"))
    distinct = slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("copies"))
    placed = places(distinct, "conv_id", ["turn", "h1", "h2", "size"], "copies")
    parts = placed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / BLOCK))))
    first = F.col("_part") * BLOCK
    return parts.select("conv_id", F.explode(F.sequence(
        F.col("place") + first, F.col("place") + F.least(first + BLOCK, "copies") - 1)).alias("place"), "h1", "h2", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n_turns) of every rebuilt conversation, and its turns (conv_id, place, h1, h2, size).

    Conversation c takes the first h turns of conversation c - c % 100 (all if fewer, none if absent) and then its
    own without its first h; h is the unsigned crc32 of c in decimal, mod 6."""
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    base = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    taken = F.least(F.col("h"), F.coalesce("n_base", F.lit(0)))
    convs = own.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED_TURNS + 1)) \
        .withColumn("base", F.expr("conv_id - conv_id % 100")).join(base, "base", "left") \
        .select("conv_id", "base", "h", taken.alias("taken"),
                (taken + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns"))
    convs = cut_lineage(convs)
    kept = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place >= h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "h1", "h2", "size")
    first = turns.where((F.col("place") < SHARED_TURNS) & F.expr("conv_id % 100 = 0")).withColumnRenamed("conv_id", "base")
    given = convs.where("taken > 0").select(
        "conv_id", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken") - 1)).alias("place"))
    given = given.join(first, ["base", "place"]).select("conv_id", "place", "h1", "h2", "size")
    return convs.select("conv_id", "n_turns"), kept.unionByName(given)


def prefixes(turns: DataFrame, longest: int) -> DataFrame:
    """Every prefix of every conversation: conv_id, depth, s1, s2 (its sums), p1, p2 (its parent's), size (last text)."""
    e1 = F.xxhash64("place", "h1", "h2").cast(_SUM)
    e2 = F.xxhash64(F.lit("2"), "h2", "place", "h1").cast(_SUM)
    summed = prefix_sums(turns.select("conv_id", "place", "size", e1.alias("e1"), e2.alias("e2")), "place",
                         {"s1": F.col("e1"), "s2": F.col("e2")}, longest, ("conv_id",))
    return summed.select("conv_id", (F.col("place") + 1).alias("depth"), F.col("s1").cast(_SUM).alias("s1"),
                         F.col("s2").cast(_SUM).alias("s2"), (F.col("s1") - F.col("e1")).cast(_SUM).alias("p1"),
                         (F.col("s2") - F.col("e2")).cast(_SUM).alias("p2"), "size")


def _next_sibling(nodes: DataFrame) -> DataFrame:
    """id, parent and next (the next child of the same parent by id, or null) of every node but the root."""
    kids = nodes.where("parent IS NOT NULL").select("id", "parent", F.shiftright("id", 10).alias("block"))
    inside = Window.partitionBy("parent", "block").orderBy("id")
    blocks = kids.groupBy("parent", "block").agg(F.min("id").alias("head"))
    over = Window.partitionBy("parent").orderBy("block")
    blocks = blocks.select("parent", "block", F.lead("head").over(over).alias("_next"))
    return kids.withColumn("next", F.lead("id").over(inside)).join(blocks, ["parent", "block"]).select(
        "id", "parent", F.coalesce("next", "_next").alias("next"))


def tour(nodes: DataFrame, siblings: DataFrame) -> DataFrame:
    """The arcs of the Euler tour: arc, next (null at the end). nodes: id, parent (the root's is null), child (the first,
    null for a leaf); siblings: see :func:`_next_sibling`.

    Node v enters by arc 2v and leaves by arc 2v + 1."""
    enter = nodes.select((2 * F.col("id")).alias("arc"), F.coalesce(2 * F.col("child"), 2 * F.col("id") + 1).alias("next"))
    leave = siblings.select((2 * F.col("id") + 1).alias("arc"),
                            F.coalesce(2 * F.col("next"), 2 * F.col("parent") + 1).alias("next"))
    end = nodes.where("parent IS NULL").select((2 * F.col("id") + 1).alias("arc"), F.lit(None).cast("long").alias("next"))
    return enter.unionByName(leave).unionByName(end)


def local_chains(arcs: DataFrame) -> DataFrame:
    """arc, target, far: each arc of a list (arc, next) followed as long as the list stays in the arc's own block.

    target is the first arc of another block (null: the list ended) and far the steps to it (to the last arc). A block
    is the arcs of one range of nodes (:func:`_node_table`); its arcs meet in one task."""
    def follow(arc: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(arc)
        arc, after = arc[order], after[order]
        at = np.minimum(np.searchsorted(arc, after), len(arc) - 1)
        inside = arc[at] == after
        to, far = np.where(inside, at, np.arange(len(arc))), inside.astype(np.int64)
        while True:
            again = to[to]
            if np.array_equal(again, to):
                break
            far, to = far + far[to], again
        target = after[to]
        return pa.RecordBatch.from_arrays([pa.array(arc), pa.array(target, mask=target < 0), pa.array(far + (target >= 0))],
                                          names=["arc", "target", "far"])

    def chase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            blocks, arc, after = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edges = np.flatnonzero(np.diff(blocks, prepend=-1 if now is None else now))
            for first, last in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)], strict=True):
                if first in edges and held:
                    yield follow(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
                if last > first:
                    held.append((arc[first:last], after[first:last]))
                    now = int(blocks[first])
        if held:
            yield follow(*map(np.concatenate, zip(*held, strict=True)))

    block = F.shiftright("arc", 34)  # the partition in both arcs of an id of monotonically_increasing_id
    return arcs.select(block.alias("block"), "arc", F.coalesce("next", F.lit(-1).cast("long")).alias("next")) \
        .repartition("block").sortWithinPartitions("block").mapInArrow(chase, "arc bigint, target bigint, far bigint")


def list_rank(arcs: DataFrame, size: int) -> DataFrame:
    """arc, place (from 0 at the head) of every arc of a list (arc, next) of ``size`` arcs.

    Each block of arcs is followed by itself first; what is left is the list of the arcs that a block is entered by, with
    the steps between them. That list is ranked by pointer doubling: each round an arc's pointer becomes that of the arc
    it points to, and the steps add up; after as many rounds as the list's length has bits, all point past the end. Arcs
    that do so already wait without being joined again. Were no two arcs of a block neighbours, the doubling would run
    over all arcs."""
    chains = cut_lineage(local_chains(arcs))
    entered = chains.where("target IS NOT NULL").select(F.col("target").alias("arc"))
    now = cut_lineage(chains.join(entered, "arc", "left_semi").select("arc", F.col("target").alias("next"), "far"))
    left = now.count()

    def shipped(df: DataFrame) -> DataFrame:  # three longs a row; beyond, both sides are shuffled by arc
        return F.broadcast(df) if left <= SHIP_ROWS else df

    parts = min(int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + left // SHIP_ROWS)
    now = now.coalesce(parts)
    for _ in range(max(left - 1, 0).bit_length()):
        ahead = now.select(F.col("arc").alias("next"), F.col("next").alias("_next"), F.col("far").alias("_far"))
        jumped = now.where("next IS NOT NULL").join(shipped(ahead), "next").select(
            "arc", F.col("_next").alias("next"), (F.col("far") + F.col("_far")).alias("far"))
        now = cut_lineage(jumped.unionByName(now.where("next IS NULL")).coalesce(parts))  # else each round adds some
    rest = shipped(now.select(F.col("arc").alias("target"), F.col("far").alias("_far")))
    return chains.where("target IS NULL").select("arc", (F.lit(size - 1) - F.col("far")).alias("place")).unionByName(
        chains.join(rest, "target").select("arc", (F.lit(size - 1) - F.col("far") - F.col("_far")).alias("place")))


def ends_digest(ends: DataFrame) -> DataFrame:
    """id, ends_sha256 from (id, conv_id): the hash of its conv_ids, ascending and comma-joined.

    A hash is sequential, but only over ready text: ranges of (id, conv_id) become one text a node and range first."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, ids = None, 0, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([first], pa.int64()),
                                               pa.array([",".join(ids)])], names=["id", "first", "part"])
        for b in batches:
            for node, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (node != now or len(ids) >= 65_536):
                    yield row()
                    ids = []
                if not ids:
                    now, first = node, conv
                ids.append(str(conv))
        if ids:
            yield row()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for b in batches:
            out = []
            for node, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if h is not None and node == now:
                    h.update(b",")
                else:
                    if h is not None:
                        out.append((now, h.hexdigest()))
                    now, h = node, hashlib.sha256()
                h.update(part.encode())
            yield _digests(out)
        if h is not None:
            yield _digests([(now, h.hexdigest())])

    def _digests(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                           pa.array([r[1] for r in rows], pa.string())], names=["id", "ends_sha256"])

    parts = ends.select("id", "conv_id").repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id") \
        .mapInArrow(joined, "id bigint, first bigint, part string")
    return parts.repartition("id").sortWithinPartitions("id", "first").select("id", "part") \
        .mapInArrow(hashed, "id bigint, ends_sha256 string")


def _node_table(convs: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each node, with an id of its own and its parent's id and smallest member."""
    zero = F.lit(0).cast(_SUM)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), zero.alias("s1"), zero.alias("s2"), "conv_id", "n_convs",
        zero.alias("p1"), zero.alias("p2"), F.lit(0).cast("long").alias("size"))
    nodes = found.groupBy("depth", "s1", "s2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("p1").alias("p1"),
        F.min("p2").alias("p2"), F.min("size").alias("size"))
    nodes = nodes.unionByName(root).repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    nodes = cut_lineage(nodes.withColumn("id", F.monotonically_increasing_id()))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"),
                         F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.where("depth > 0").join(above, ["depth", "p1", "p2"])
    top = nodes.where("depth = 0").withColumns({"parent": F.lit(None).cast("long"), "parent_conv_id": F.lit(None).cast("long")})
    return cut_lineage(linked.unionByName(top))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256 (see :func:`ends_digest`).

    conversations: conv_id, turn, role, text; other columns are not read. Rows without a conv_id are left out; null
    role and text are empty; turns of equal number follow their hashes, so repeated rows are turns of their own. A
    conversation that has no turn once rebuilt is a member of the root only. An empty table has no node."""
    turns = cut_lineage(turns_in_order(bounded(conversations)))
    convs, again = rebuilt(turns)
    longest = convs.agg(F.max("n_turns")).first()[0] or 0
    found = cut_lineage(prefixes(again, max(longest, 1)))
    nodes = _node_table(convs, found)
    size = 2 * nodes.count()
    siblings = _next_sibling(nodes)
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
        F.count(F.lit(1)).alias("n_children"), F.min("id").alias("child"))
    nodes = cut_lineage(nodes.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    ranked = list_rank(tour(nodes, siblings), size)

    enters = (F.col("arc") % 2) == 0
    values = nodes.select((2 * F.col("id")).alias("arc"), (F.col("n_children") == 0).cast("long").alias("leaf"),
                          ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    arcs = ranked.where(enters).join(values, "arc").unionByName(
        ranked.where(~enters).select("*", F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved")))
    summed = prefix_sums(arcs, "place", {"leaves": F.col("leaf"), "saves": F.col("saved")}, max(size, 1))

    def inside(total: str, own: str) -> Column:
        return F.sum(F.when(enters, F.col(own) - F.col(total)).otherwise(F.col(total)))
    subtree = summed.groupBy(F.floor(F.col("arc") / 2).alias("id")).agg(
        inside("leaves", "leaf").alias("n_leaves"), inside("saves", "saved").alias("saved_tokens"))

    zero = F.lit(0).cast(_SUM)
    last = found.join(convs, "conv_id").where("depth = n_turns").select("conv_id", "depth", "s1", "s2").unionByName(
        convs.where("n_turns = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), zero.alias("s1"), zero.alias("s2")))
    ends = ends_digest(last.join(nodes.select("depth", "s1", "s2", "id"), ["depth", "s1", "s2"]))
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(subtree, "id").join(ends, "id", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("n_leaves").cast("long").alias("n_leaves"),
        F.col("saved_tokens").cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
