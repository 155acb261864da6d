"""Row numbers in key order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrand.shared import checkpointed

#: ``monotonically_increasing_id`` holds the place in the partition in its low bits.
_PLACE_BITS = 33


def range_bucket(key: Column, bounds: list) -> Column:
    """Index of the range of ``key`` among sorted bounds, as a balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < F.lit(bounds[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(bounds))


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """The rows sorted over all partitions, written once, with their partition ``__part`` and place ``__place`` from 0.

    Key ranges follow the data and the session's shuffle partitions, so their number is not fixed.
    """
    held = checkpointed(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    return held.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))


def number_rows(df: DataFrame, key: str, name: str = "rn") -> DataFrame:
    """Adds ``name``: 1, 2, ... in ascending order of a unique key of any ordered type.

    Rows are sorted once in key ranges; a row's number is its place in its partition plus the rows of
    the partitions before it, of which there is one count each.
    """
    rows = in_order(df, key)
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))  # one row per partition
    return rows.join(F.broadcast(counts), "__part").withColumn(name, F.col("__before") + F.col("__place") + 1).drop("__part", "__place", "__before")
