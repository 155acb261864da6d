"""Result analytics: ratios, medians, geometric means, rolling and joined comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def geomean(c: Column) -> Column:
    return F.exp(F.avg(F.ln(c)))


def share_of_total(df: DataFrame, group: str, value: str, name: str = "share") -> DataFrame:
    """Sum per group and its share of all; the total is taken over the groups, not the rows."""
    sums = df.groupBy(group).agg(F.sum(value).alias("total"))
    return sums.withColumn(name, F.col("total") / F.sum("total").over(Window.partitionBy()))


def ratio_to_previous(df: DataFrame, order: str, value: str, name: str = "ratio") -> DataFrame:
    """Each value divided by the one before it in order; meant for result tables, one row per step."""
    return df.withColumn(name, F.col(value) / F.lag(value).over(Window.orderBy(order)))


def label_change(ratio: Column, low: float = 0.95, high: float = 1.05) -> Column:
    return F.when(ratio < low, "red").when(ratio > high, "green").otherwise("black")


def compare_left(now: DataFrame, before: DataFrame, on: str, value: str) -> DataFrame:
    """Left join to an earlier run with the ratio of values: null where there was no earlier one."""
    old = before.select(on, F.col(value).alias(f"{value}_before"))
    return now.join(old, on, "left").withColumn("ratio", F.col(value) / F.col(f"{value}_before"))


def gap_closed(base: Column, improved: Column, perfect: Column) -> Column:
    return (improved - base) / (perfect - base)
