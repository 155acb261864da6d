"""Consistency checks; each returns the violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrand.functions.keys import is_reserved
from keystrand.operators.numbering import number_rows
from keystrand.shared import checkpointed


def load_violations(rows: DataFrame) -> DataFrame:
    """Counts of reserved, duplicate and unordered keys of rows ``pos, key`` to be loaded.

    The order check numbers the rows by position, which need not be without gaps, and looks at neighbours.
    """
    reserved = rows.agg(F.count(F.when(is_reserved(F.col("key"), rows.schema["key"].dataType), 1)).alias("reserved"), F.count("*").alias("n"))
    dup = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("duplicate_keys"))
    numbered = checkpointed(number_rows(rows.select("pos", "key"), "pos"))
    after = numbered.select((F.col("rn") - 1).alias("rn"), F.col("key").alias("next_key"))
    bad = numbered.join(after, "rn").agg(F.count(F.when(F.col("next_key") <= F.col("key"), 1)).alias("unordered"))
    one = F.lit(1)
    return reserved.withColumn("_", one).join(dup.withColumn("_", one), "_").join(bad.withColumn("_", one), "_").drop("_")


def range_violations(segments: DataFrame) -> DataFrame:
    """Segments whose range is empty or overlaps the one before; segments are few next to records."""
    before = F.max("upper").over(Window.orderBy("lower", "segment_id").rowsBetween(Window.unboundedPreceding, -1))
    checked = segments.withColumn("before", before)
    return checked.where((F.col("lower") >= F.col("upper")) | (F.col("before") > F.col("lower"))).select("segment_id", "lower", "upper")


def dangling(refs: DataFrame, targets: DataFrame, on: str) -> DataFrame:
    """References to nothing, targets of several references, and targets of none: ``id, problem``."""
    missing = refs.select(on).join(targets, on, "left_anti").select(on, F.lit("missing").alias("problem"))
    several = refs.groupBy(on).agg(F.count("*").alias("n")).where("n > 1").select(on, F.lit("several").alias("problem"))
    unused = targets.select(on).join(refs, on, "left_anti").select(on, F.lit("unused").alias("problem"))
    return missing.distinct().unionAll(several).unionAll(unused)


def page_violations(packed: DataFrame, pages: DataFrame) -> DataFrame:
    """Records outside the bounds of their page."""
    return packed.join(pages, "page").where((F.col("key") < F.col("lower")) | (F.col("key") > F.col("last"))).select("page", "key")


def scan_violations(rows: DataFrame) -> DataFrame:
    """Keys that a scan would show more than once: ``key, n``."""
    return rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def contiguity_violations(pages: DataFrame) -> DataFrame:
    """Pages whose upper bound is not the next page's lower bound: ``page, upper, next_lower``; the last has no next."""
    after = pages.select((F.col("page") - 1).alias("page"), F.col("lower").alias("next_lower"))
    return pages.join(after, "page").where("upper <> next_lower").select("page", "upper", "next_lower")
