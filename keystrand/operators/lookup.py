"""Point and range reads over ``key, value`` views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrand.errors import InvalidArgument
from keystrand.functions.keys import MIN_KEY


def get(view: DataFrame, key: int | bytes) -> DataFrame:
    """The row of a key, or none; reserved keys are never found."""
    return view.where(F.col("key") == F.lit(key)) if isinstance(key, bytes) or key >= MIN_KEY else view.limit(0)


def multi_get(view: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per asked key, with a null value where it does not exist."""
    return keys.select("key").distinct().join(view, "key", "left")


def range_scan(view: DataFrame, start: int | bytes, limit: int) -> DataFrame:
    """At most ``limit`` rows with ``key >= start``, ascending; byte keys in byte order."""
    if not isinstance(start, bytes) and start < MIN_KEY:
        raise InvalidArgument(f"reserved start key {start}")
    if limit < 0:
        raise InvalidArgument(f"negative limit {limit}")
    return view.where(F.col("key") >= F.lit(start)).orderBy("key").limit(limit)


def range_between(view: DataFrame, start: int, end: int) -> DataFrame:
    """Rows with ``start <= key < end``, ascending."""
    return view.where((F.col("key") >= start) & (F.col("key") < end)).orderBy("key")


def seek(view: DataFrame, key: int) -> DataFrame:
    """Lower bound of a key, the last key, and the rows from there on: ``lower, last, left``."""
    at = F.col("key") >= key
    return view.agg(F.min(F.when(at, F.col("key"))).alias("lower"), F.max("key").alias("last"), F.count(F.when(at, 1)).alias("left"))


def dirty_records(log: DataFrame, after_seq: int) -> DataFrame:
    """Newest unflushed write of each key since a compaction."""
    from keystrand.operators.merge import latest_per_key

    return latest_per_key(log.where(F.col("seq") > after_seq))
