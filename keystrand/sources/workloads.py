"""Request generators: key distributions, operation mixes, phases, and a batched runner."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand.operators import merge


def unit(seq: Column, seed: int) -> Column:
    """A reproducible number in [0, 1) for each request."""
    return F.pmod(F.xxhash64(seq, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def uniform_rank(u: Column, n: int) -> Column:
    return F.floor(u * n)


def zipf_rank(u: Column, n: int, theta: float = 0.99) -> Column:
    """Ranks 0 .. n-1 of probability near ``(rank + 1) ** -theta``, by inverting the integral of the law."""
    if abs(theta - 1) < 1e-9:
        x = F.exp(u * F.log(F.lit(n + 1.0)))
    else:
        x = F.pow(u * ((n + 1.0) ** (1 - theta) - 1) + 1, F.lit(1 / (1 - theta)))
    return F.least(F.lit(n - 1), F.floor(x) - 1)


def latest_rank(u: Column, n: int, theta: float = 0.99) -> Column:
    """As ``zipf_rank``, with the newest rows the likeliest."""
    return F.lit(n - 1) - zipf_rank(u, n, theta)


def hotspot_rank(u: Column, n: int, hot_share: float = 0.9, hot_from: float = 0.495, hot_width: float = 0.01) -> Column:
    """``hot_share`` of the requests go to one range of ranks, the others anywhere."""
    hot = hot_from * n + u / hot_share * (hot_width * n)
    return F.floor(F.when(u < hot_share, hot).otherwise((u - hot_share) / (1 - hot_share) * n))


#: Shares of reads, updates, inserts, scans and read-modify-writes, in percent (fixed values).
MIXES = {
    "a": {"read": 50, "update": 50},
    "b": {"read": 95, "update": 5},
    "c": {"read": 100},
    "d": {"read": 95, "insert": 5},
    "e": {"scan": 95, "insert": 5},
    "f": {"read": 50, "rmw": 50},
    "scan_only": {"scan": 100},
    "hot_middle": {"insert": 50, "read": 50},
}


@dataclass(frozen=True)
class Phase:
    """``requests`` operations of a mix, their keys drawn by ``rank`` over the loaded keys."""

    mix: dict[str, int]
    requests: int
    rank: object = zipf_rank
    scan_length: int = 100


def linspace_keys(spark: SparkSession, n: int, start: int = 1, step: int = 1) -> DataFrame:
    return spark.range(start, start + n * step, step).select(F.col("id").alias("key"))


def requests(spark: SparkSession, phases: list[Phase], n: int, *, start: int = 1, step: int = 2, seed: int = 42) -> DataFrame:
    """``seq, phase, op, key, scan_len`` over ``n`` keys ``start + rank * step``.

    Inserts take keys of the gaps between loaded keys, so ``step`` is 2 at least.  A projection of a
    range of numbers: without a shuffle, and the same in every run.
    """
    parts, at = [], 0
    for number, p in enumerate(phases):
        seq = spark.range(at, at + p.requests).select(F.col("id").alias("seq"))
        share, bound, op = F.floor(unit(F.col("seq"), seed) * 100), 0, F.lit(None).cast("string")
        for name, percent in reversed(list(p.mix.items())):
            op = F.when(share < sum(p.mix.values()) - bound, F.lit(name)).otherwise(op)
            bound += percent
        key = start + p.rank(unit(F.col("seq"), seed + 1), n).cast("long") * step
        length = 1 + F.floor(unit(F.col("seq"), seed + 2) * p.scan_length)
        rows = seq.select("seq", F.lit(number).alias("phase"), op.alias("op"), key.alias("key"), length.cast("int").alias("scan_len"))
        gap = F.lit(1) + F.floor(unit(F.col("seq"), seed + 3) * (step - 1))
        rows = rows.withColumn("key", F.when(F.col("op") == "insert", F.col("key") + gap).otherwise(F.col("key")).cast("long"))
        parts.append(rows.withColumn("scan_len", F.when(F.col("op") == "scan", F.col("scan_len"))))
        at += p.requests
    return reduce(DataFrame.unionByName, parts)


def run_phase(view: DataFrame, phase: DataFrame, value: Column) -> tuple[DataFrame, DataFrame]:
    """One phase as a batch: what its reads find (``seq, key, value``) in the view before it, and the view after it.

    Updates, inserts and read-modify-writes put ``value``, an expression over ``seq`` and ``key``.
    """
    reads = phase.where("op in ('read', 'rmw')").select("seq", "key").join(view, "key", "left").select("seq", "key", "value")
    writes = phase.where("op in ('update', 'insert', 'rmw')").select("key", "seq", F.lit(merge.PUT).alias("op"), value.alias("value"))
    return reads, merge.merge_view(view, writes)
