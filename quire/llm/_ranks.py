"""Distributed ranks and running sums: no group, however hot, is ordered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import materialize

BUCKET_ROWS = 500
FAN_OUT = 1000  # ranges of a level that are summed in order by one task
HASH_BITS = 32


def hash32(seed: int, *cols: str) -> Column:
    """Seeded 32-bit hash of columns, the same in any engine that has MD5."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 8), 16, 10).cast("long")


def running(df: DataFrame, group: str, hashed: str, ties: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the group that come before in (hashed, ties) order.

    ``hashed`` is uniform in 32 bits. A group is cut into ranges of it of about BUCKET_ROWS rows, and those into
    blocks of FAN_OUT; sums of blocks come first, then of ranges in a block, then each range is ordered by itself, so
    the one ordered list a group has grows by a row for 500,000. Rows that share their hash share a range. ``df`` is read twice: pass a written table.
    """
    counts = materialize(df.groupBy(group).agg(F.count(F.lit(1)).alias("__quire_rows")).withColumnRenamed(group, "__quire_group"), "counts")
    part = F.floor(F.col(hashed) * F.ceil(F.col("__quire_rows") / BUCKET_ROWS) / (1 << HASH_BITS))
    rows = df.join(counts, F.col(group).eqNullSafe(F.col("__quire_group"))).withColumns({"__quire_part": part, "__quire_value": value})
    rows = rows.withColumn("__quire_range", F.xxhash64(F.col(group).isNull(), group, "__quire_part"))
    sums = rows.groupBy("__quire_range", "__quire_group", "__quire_part").agg(F.sum("__quire_value").alias("__quire_sum"))
    sums = materialize(sums.withColumn("__quire_block", F.floor(F.col("__quire_part") / FAN_OUT)), "ranges")
    earlier = lambda keys, order: F.coalesce(F.sum("__quire_sum").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sums.groupBy("__quire_group", "__quire_block").agg(F.sum("__quire_sum").alias("__quire_sum"))
    blocks = blocks.select(F.col("__quire_group").alias("__quire_g"), F.col("__quire_block").alias("__quire_b"), earlier(["__quire_group"], "__quire_block").alias("__quire_before"))
    ranges = sums.withColumn("__quire_inside", earlier(["__quire_group", "__quire_block"], "__quire_part")).join(blocks, F.col("__quire_group").eqNullSafe(F.col("__quire_g")) & (F.col("__quire_block") == F.col("__quire_b")))
    ranges = materialize(ranges.select(F.col("__quire_range").alias("__quire_of"), (F.col("__quire_before") + F.col("__quire_inside")).alias("__quire_base")), "bases")
    within = Window.partitionBy("__quire_range").orderBy(hashed, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(ranges, F.col("__quire_range") == F.col("__quire_of"))
    return out.withColumn(name, F.col("__quire_base") + F.coalesce(F.sum("__quire_value").over(within), F.lit(0))).drop("__quire_rows", "__quire_group", "__quire_part", "__quire_value", "__quire_range", "__quire_of", "__quire_base")


def nth_of(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds ``name``: a number from 1 among the rows that share ``keys``, dealt by task, so that no key is ordered in one task."""
    placed = materialize(df.withColumn("__quire_part", F.spark_partition_id()), "placed")
    here = placed.select("*", F.row_number().over(Window.partitionBy(*keys, "__quire_part").orderBy(F.lit(1))).alias("__quire_here"))
    counts = placed.groupBy(*keys, "__quire_part").agg(F.count(F.lit(1)).alias("__quire_count"))  # a row for each key and task that holds it
    base = F.coalesce(F.sum("__quire_count").over(Window.partitionBy(*keys).orderBy("__quire_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(k).alias(f"__quire_k{i}") for i, k in enumerate(keys)], F.col("__quire_part").alias("__quire_p"), base.alias("__quire_base"))
    same = F.col("__quire_part") == F.col("__quire_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__quire_k{i}"))
    return here.join(counts, same).withColumn(name, F.col("__quire_base") + F.col("__quire_here")).drop("__quire_part", "__quire_here", "__quire_p", "__quire_base", *[f"__quire_k{i}" for i in range(len(keys))])


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the 0-based place in a total order, from range partitions and their sizes."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(sorted_rows.withColumns({"__quire_part": F.spark_partition_id(), "__quire_at": F.monotonically_increasing_id()}), "sorted")
    sizes = placed.groupBy("__quire_part").agg(F.count(F.lit(1)).alias("__quire_count"))  # a row for each partition
    base = F.coalesce(F.sum("__quire_count").over(Window.orderBy("__quire_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(sizes.select("__quire_part", base.alias("__quire_base"))), "__quire_part").withColumn(name, F.col("__quire_base") + F.col("__quire_at") - F.shiftleft(F.col("__quire_part").cast("long"), 33)).drop("__quire_part", "__quire_at", "__quire_base")
