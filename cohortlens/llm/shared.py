"""Tables written to the shared folder, and prefix sums and places without all rows in one task."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import ensure_checkpoint_dir

#: Rows of a block of a prefix sum; a level above has a row for each block.
BLOCK = 1024


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in a folder of its own below the shared checkpoint folder: no lineage, read by column."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def bucketed(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """Like :func:`written`, as a table in ``buckets`` buckets of ``key``: what groups or joins by it need not shuffle it."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    df.write.format("parquet").option("path", folder).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


def prefix_sums(df: DataFrame, place: str, sums: dict[str, Column], size: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of its column over all rows of smaller or equal ``place``.

    ``place`` is a long from 0 to ``size`` - 1, within ``keys`` if any are given. Rows are summed in blocks of BLOCK
    places, then blocks in blocks, until one block holds a level: no task needs more than BLOCK rows together.
    """
    up, own = "_up_" + place, Window.partitionBy(*keys, "_up_" + place).orderBy(place)
    out = df.withColumn(up, F.floor(F.col(place) / BLOCK))
    inside = out.select("*", *[F.sum(c).over(own).alias(n) for n, c in sums.items()])
    if size <= BLOCK:
        return inside.drop(up)
    blocks = out.groupBy(*keys, up).agg(*[F.sum(c).alias("_of_" + n) for n, c in sums.items()])
    before = prefix_sums(blocks, up, {"_to_" + n: F.col("_of_" + n) for n in sums}, -(-size // BLOCK), keys)
    before = before.select(*keys, up, *[(F.col("_to_" + n) - F.col("_of_" + n)).alias("_to_" + n) for n in sums])
    return inside.join(before, [*keys, up]).select(
        *df.columns, *[(F.col(n) + F.col("_to_" + n)).alias(n) for n in sums])
