"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: a share of the whole goes to the sources by weight; a source stops at ``max_epochs`` times its size, and what
it cannot use is shared again by weight among the others until none is above.

Schedule: slot s has the golden-ratio point frac(s * phi) (64-bit integer arithmetic, exact), which the cumulative
slot weights map to a source. Every prefix of the schedule then holds each source in its weight, up to a few slots. The
slots of a source are ranked; rank r takes block r mod (number of blocks) in epoch r div (number of blocks).

Blocks: the documents of a source in a seeded hash order are one stream of tokens, cut into blocks of equal length.
The block length of a small source shrinks, so that a slot more or less stays small against its target.

Work at scale: ranks and stream offsets are prefix sums over buckets (a window inside a bucket, and one over a row for
each source and bucket), so a source with a third of all rows is spread like the others. The driver holds a row for
each source.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: floor(2**64 / golden ratio), odd: multiples modulo 2**64 are the golden-ratio points.
GOLDEN = 0x9E3779B97F4A7C15
#: Slots in a bucket of ranks, and documents (about) in a bucket of offsets.
SLOT_BUCKET, DOC_BUCKET = 1 << 14, 2048
#: Sources that the driver may hold.
MOST_SOURCES = 1_000_000


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float
    block: int  # tokens of a block

    @property
    def blocks(self) -> int:
        return -(-self.size // self.block)


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def share_out(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Targets by weight with sum ``total``; none above ``most`` times its size, the excess shared again."""
    target = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    rest = total
    while open_ and rest > 0:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] / w >= most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = rest * weights[i] / w
            break
        for i in full:
            target[i] = float(most * sizes[i])
            rest -= target[i]
        open_ = [i for i in open_ if i not in set(full)]
    return target


def plan(sized: DataFrame, weights: list[float], share: float, max_epochs: int, block: int) -> list[Source]:
    """Sources of ``sized`` (source, size) by code point, null last, with their targets and block lengths."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["n"]) for r in rows]
    own = [weights[i % len(weights)] for i in range(len(rows))]
    targets = share_out(sizes, own, share * sum(sizes), max_epochs)
    return [Source(r["source"], s, t, max(1, min(block, s // 128)))
            for r, s, t in zip(rows, sizes, targets, strict=True)]


def schedule(spark, sources: list[Source], max_epochs: int) -> DataFrame:
    """The slots: slot, src (index of the source), rank, epoch, block. Slots beyond ``max_epochs`` are left out."""
    slots = np.array([s.target / s.block for s in sources])
    n = int(np.ceil(slots.sum())) if len(slots) else 0
    cumulative = np.cumsum(slots) / max(slots.sum(), 1e-300)
    edges = (cumulative * 2.0**53).astype(np.uint64)[:-1]

    @F.arrow_udf("int")
    def source_of(slot: pa.Array) -> pa.Array:
        point = (slot.to_numpy().astype(np.uint64) * np.uint64(GOLDEN)) >> np.uint64(11)
        return pa.array(np.searchsorted(edges, point, side="right").astype(np.int32))

    base = spark.range(n).select(F.col("id").alias("slot"), source_of("id").alias("src"),
                                 F.floor(F.col("id") / SLOT_BUCKET).alias("bucket"))
    counts = base.groupBy("src", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("src", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("src", "bucket").orderBy("slot"))
    table = spark.createDataFrame([(i, s.blocks) for i, s in enumerate(sources)], "src int, blocks bigint")
    ranked = base.withColumn("inside", inside).join(offsets, ["src", "bucket"]).join(table, "src").select(
        "slot", "src", (F.col("before") + F.col("inside") - 1).alias("rank"), "blocks")
    return ranked.withColumn("epoch", F.floor(F.col("rank") / F.col("blocks"))).where(F.col("epoch") < max_epochs) \
        .select("slot", "src", "rank", "epoch", (F.col("rank") % F.col("blocks")).alias("block"))


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, max_epochs: int = 2, block: int = 256,
        seed: int = 42, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, size, source_size, target (its source's) and taken (words the mix takes, repeats counted).

    A row for each row of ``docs``. A null text has size 0 and gives nothing; a null source is a source of its own,
    last in order. Repeated rows are documents of their own: the same number of them is taken in every run, though
    which of two equal rows gives more is not defined. An empty table gives no rows. Columns other than the three
    named are not read.
    """
    spark = docs.sparkSession
    from cohortlens.llm.layout import repeated

    # equal rows are counted and numbered, so that the order hash spreads a key whatever its number of rows
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
                       F.xxhash64(F.col(text)).alias("text_hash"))
    counted = rows.groupBy("key", "source", "size", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    sized = repeated(counted, "times").select(
        "key", "source", "size", F.xxhash64(F.lit(seed), "key", "source", "text_hash", "_copy").alias("h"))
    return mix_sized(spark, sized, weights, share, max_epochs, block).withColumnRenamed("key", key)


def mix_sized(spark, sized: DataFrame, weights: list[float], share: float, max_epochs: int, block: int) -> DataFrame:
    """As :func:`mix` for (key, source, size, h); ``h`` is the shuffled order."""
    from cohortlens.llm.layout import cut_lineage

    sized = cut_lineage(sized)
    sources = plan(sized, weights, share, max_epochs, block)
    table = spark.createDataFrame(
        [(i, s.name, s.size, s.target, s.block) for i, s in enumerate(sources)],
        "src int, name string, source_size bigint, target double, length bigint")
    buckets = max(1, sized.count() // DOC_BUCKET)
    docs = sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name"))).withColumn(
        "bucket", F.floor(F.shiftrightunsigned("h", 1) / F.lit(2.0**63 / buckets)))
    sums = docs.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("src", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("src", "bucket").orderBy("h", "key", "size")
                                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = cut_lineage(docs.withColumn("inside", inside).join(offsets, ["src", "bucket"]).select(
        "key", "source", "size", "source_size", "target", "src", "length",
        (F.col("before") + F.col("inside") - F.col("size")).alias("start")))
    end = F.col("start") + F.col("size")
    pieces = placed.where("size > 0").select("src", "start", "size", "length", F.explode(F.sequence(
        F.floor(F.col("start") / F.col("length")), F.floor((end - 1) / F.col("length")))).alias("block"))
    pieces = pieces.select("src", "start", "block", (
        F.least(end, (F.col("block") + 1) * F.col("length"))
        - F.greatest(F.col("start"), F.col("block") * F.col("length"))).alias("n"))
    times = schedule(spark, sources, max_epochs).groupBy("src", "block").agg(F.count("*").alias("times"))
    taken = pieces.join(times, ["src", "block"]).groupBy("src", "start").agg(F.sum(F.col("n") * F.col("times"))
                                                                             .alias("taken"))
    got = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long")
    return placed.join(taken, ["src", "start"], "left").select(
        "key", "source", "size", "source_size", "target", got.alias("taken"))
