"""Newest-wins merging of a base table and a write log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PUT, DELETE = "W", "D"


def latest_per_key(log: DataFrame) -> DataFrame:
    """The newest write of each key: ``key, seq, op, value``.

    One partial and one final aggregation; ``seq`` is unique, so the result does not depend on order.
    """
    newest = log.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("w"))
    return newest.select("key", "w.seq", "w.op", "w.value")


def merge_view(base: DataFrame, log: DataFrame) -> DataFrame:
    """``key, value`` of the base with the log applied: the newest write wins and deletes hide the key.

    Base and log are united, the base as writes older than any, and reduced by one aggregation, so a
    key that is written very often is combined map-side.
    """
    rows = base.select("key", F.lit(-1).cast("long").alias("seq"), F.lit(PUT).alias("op"), "value")
    newest = latest_per_key(rows.unionByName(log.select("key", "seq", "op", "value")))
    return newest.where(F.col("op") == PUT).select("key", "value")


def memtable_merge(active: DataFrame, flushing: DataFrame) -> DataFrame:
    """Newest version per key over two tables of which the active one wins; deletes stay visible."""
    both = active.withColumn("level", F.lit(1)).unionByName(flushing.withColumn("level", F.lit(0)))
    newest = both.groupBy("key").agg(F.max(F.struct("level", "seq", "op", "value")).alias("w"))
    return newest.select("key", "w.op", "w.value")


def kway_merge(*runs: DataFrame) -> DataFrame:
    """Sorted runs as one sorted run, duplicates kept."""
    return reduce(DataFrame.unionByName, runs).orderBy("key")


def upsert(view: DataFrame, writes: DataFrame) -> DataFrame:
    """Applies puts ``key, value`` over a view."""
    return merge_view(view, writes.select("key", F.lit(0).cast("long").alias("seq"), F.lit(PUT).alias("op"), "value"))


def delete(view: DataFrame, keys: DataFrame) -> DataFrame:
    """Removes keys; absent keys are no error."""
    return view.join(keys.select("key").distinct(), "key", "left_anti")


def read_modify_write(view: DataFrame, keys: DataFrame, change) -> DataFrame:
    """New values ``change(value)`` of the given keys that exist, as a log to append."""
    hit = view.join(keys.select("key", "seq"), "key")
    return hit.select("key", "seq", F.lit(PUT).alias("op"), change(F.col("value")).alias("value"))
