"""Ordered neighbours without a global sort in one task.

Rows are dealt into ranges of a sort key. The boundary rows of each range are also copied to the range beside it,
so that every row meets its neighbours while no task holds more than a few ranges, and the payload moves once.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cohortlens.session import ensure_checkpoint_dir

#: Sampled keys for each range; the sample is bounded (4 x ranges x this), and only balance depends on it.
SAMPLE_PER_RANGE = 32
#: Rows of an Arrow batch; Spark's default of 10,000 whole texts is far more than a worker needs at a time.
BATCH_ROWS = 1000
#: Rows and bytes that a task remembers to find equal rows, and the most copies that one row of the order stands for.
SEEN_ROWS, SEEN_BYTES, MOST_COPIES = 50_000, 16 << 20, 1000


def _key(values) -> tuple:
    """Spark's ascending order: null first; strings by code point, as in UTF-8."""
    return tuple((0,) if v is None else (1, v) for v in values)


def neighbour_ranges(df: DataFrame, keys: list[str], ranges: int,
                     pack: Callable[[DataFrame], DataFrame] = lambda d: d, spread: str | None = None) -> DataFrame:
    """Deal the rows of ``pack(df)`` into ``ranges`` ranges of ``keys`` and sort each; boundary rows are copied.

    Added columns: ``_range`` (int), constant over a sorted run of a partition (a partition may hold several runs),
    and ``_role``: 0 for the row itself; -1 for a copy of the last rows of the range before, sorted in front;
    1 for a copy of the first rows of the next range, sorted behind; 2 for a copy of the very first rows behind
    the very last range, for cyclic orders.

    Keys are integers or strings; ``pack`` keeps them, and makes of the other columns what is to move. Rows with equal
    keys share a range, so the keys should be nearly unique in what ``pack`` gives. Rows of ``pack`` with a number in the
    column ``spread`` have no place in the order: the number deals them, and their ``_role`` is 3. The driver holds the sampled keys and the two boundary keys of each range, no payload.
    """
    slim, df = df.select(*keys), pack(df)
    n, distinct = slim.select(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*keys))).first()
    if n == 0:
        return df.select("*", F.lit(0).alias("_range"), F.lit(0).alias("_role"))
    want = ranges * SAMPLE_PER_RANGE
    step = max(1, min(n, distinct) // want)
    sample = slim if step == 1 else slim.where(F.pmod(F.xxhash64(*keys), F.lit(step)) == 0)
    found = sorted({_key(r) for r in sample.distinct().limit(4 * want).collect()})
    cuts = sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []

    @F.arrow_udf("int")
    def range_of(*cols: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in cols), strict=True)
        return pa.array([bisect.bisect_right(cuts, _key(row)) for row in rows], pa.int32())

    ends = slim.select(range_of(*keys).alias("r"), F.struct(*keys).alias("k")).groupBy("r").agg(
        F.min("k").alias("lo"), F.max("k").alias("hi")).collect()
    ends = sorted((r["r"], _key(r["lo"]), _key(r["hi"])) for r in ends)
    copies: dict[tuple, list[dict]] = {}
    for (before, _, hi), (after, lo, _) in zip(ends, ends[1:], strict=False):
        copies.setdefault(lo, []).append({"r": before, "role": 1})
        copies.setdefault(hi, []).append({"r": after, "role": -1})
    copies.setdefault(ends[0][1], []).append({"r": ends[-1][0], "role": 2})

    @F.arrow_udf("array<struct<r:int,role:int>>")
    def places(*cols: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in cols), strict=True)
        out = [[{"r": bisect.bisect_right(cuts, k), "role": 0}, *copies.get(k, ())] for k in map(_key, rows)]
        return pa.array(out, pa.list_(pa.struct([("r", pa.int32()), ("role", pa.int32())])))

    place = places(*keys)
    if spread:
        loose = F.struct(F.pmod(F.col(spread), F.lit(len(cuts) + 1)).alias("r"), F.lit(3).alias("role"))
        place = F.when(F.col(spread).isNull(), place).otherwise(F.array(loose))
    dealt = df.withColumn("_place", F.explode(place))
    return dealt.select(*df.columns, F.col("_place.r").alias("_range"), F.col("_place.role").alias("_role")) \
        .repartition(ranges, "_range") \
        .sortWithinPartitions("_range", F.signum("_role"), *keys)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of at most BATCH_ROWS rows in its session: bounds what a Python worker holds."""
    conf = df.sparkSession.conf
    now = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def counted_copies(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of a task, of equal ones only the first and then rows that stand for the others; last column packed.

    The last column (a text) becomes ``data``, its compressed UTF-8; null is the empty text. ``copies`` is 0 for a row
    that is itself, else the number of further equal rows (``most`` at most) that the row stands for; such a row has a
    running number in ``spread``. Only a bounded number of rows is remembered, so a row may come as itself again.
    """
    seen: dict[tuple, list] = {}  # row: its data if it came again, and how often it did
    held, number, names, types = 0, TaskContext.get().partitionId() * 7919 % (1 << 30), [], []

    def others() -> Iterator[pa.RecordBatch]:
        nonlocal number, held
        rows, numbers = [], []
        for (*own, _), (data, n) in seen.items():
            for first in range(0, n, most or max(n, 1)):
                rows.append((*own, data, min(n - first, most or n)))
                numbers.append(number)
                number = (number + 1) % (1 << 30)
        seen.clear()
        held = 0
        for first in range(0, len(rows), BATCH_ROWS):
            part = zip(*rows[first:first + BATCH_ROWS], strict=True)
            columns = [pa.array(c, t) for c, t in zip(part, [*types, pa.binary(), pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers[first:first + BATCH_ROWS], pa.int32())],
                                             names=[*names, "data", "copies", "spread"])

    for b in batches:
        names, types = b.schema.names[:-1], b.schema.types[:-1]
        own = [b.column(i).to_pylist() for i in range(len(names))]
        texts = [(t or "").encode() for t in b.column(len(names)).to_pylist()]
        kept, packed = [], []
        for i, row in enumerate(zip(*own, map(xxhash.xxh3_128_digest, texts), strict=True)):
            now = seen.get(row)
            if now is None:
                seen[row] = [None, 0]
                kept.append(i)
                packed.append(zlib.compress(texts[i], 1))
                continue
            if now[0] is None:
                now[0] = zlib.compress(texts[i], 1)
                held += len(now[0])
            now[1] += 1
        if kept:
            first = pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))], names=names).take(pa.array(kept))
            yield pa.RecordBatch.from_arrays(
                [*first.columns, pa.array(packed, pa.binary()), pa.array([0] * len(kept), pa.int64()),
                 pa.nulls(len(kept), pa.int32())], names=[*names, "data", "copies", "spread"])
        if len(seen) > SEEN_ROWS or held > SEEN_BYTES:
            yield from others()
    yield from others()


def repeated(df: DataFrame, times: str, copy: str = "_copy") -> DataFrame:
    """Each row ``times`` times (a column), numbered from 0 in ``copy``; many copies of a row are made by many tasks."""
    parts = df.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / MOST_COPIES))))
    first = F.col("_part") * MOST_COPIES
    last = F.least(first + MOST_COPIES, F.col(times)) - 1
    return parts.repartition(*df.columns, "_part").withColumn(copy, F.explode(F.sequence(first, last))).drop("_part")


def wrapped(df: DataFrame) -> DataFrame:
    """``df`` as one struct column ``row``, so that its columns cannot clash with new ones."""
    return bounded(df.select(F.struct("*").alias("row")))


def row_schema(df: DataFrame, ddl: str) -> StructType:
    """Schema of ``row`` (all columns of ``df``) and the fields of ``ddl``."""
    return StructType([StructField("row", df.schema, False), *StructType.fromDDL(ddl).fields])


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df``, computed and written to the shared checkpoint folder, without its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
