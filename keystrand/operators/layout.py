"""Page and segment layout of sorted keys, and lookups in it."""

from __future__ import annotations

from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrand.functions.keys import MAX_KEY
from keystrand.functions.plr import SEGMENT_PAGES, build_segments, fit_blocks, page_lower_bounds
from keystrand.operators.numbering import in_order, number_rows, range_bucket
from keystrand.shared import checkpointed

PAGE_SCHEMA = "shard int, base_key long, page_count int, slope double, intercept double, page_idx int, lower long, upper long, n_records long"


def pages_fixed_pack(view: DataFrame, per_page: int) -> DataFrame:
    """Adds ``page``: ``per_page`` records each in key order, the last one maybe smaller."""
    return number_rows(view, "key").withColumn("page", F.floor((F.col("rn") - 1) / per_page).cast("long")).drop("rn")


def page_summary(packed: DataFrame) -> DataFrame:
    return packed.groupBy("page").agg(F.min("key").alias("lower"), F.max("key").alias("last"), F.count("*").alias("n_records"))


def page_neighbors(packed: DataFrame, key: int) -> DataFrame:
    """All records on the page that would hold ``key``; pages are few next to records."""
    page = packed.groupBy("page").agg(F.min("key").alias("lower")).where(F.col("lower") <= key).agg(F.max("page").alias("page"))
    return packed.join(page, "page")


def records_per_page(fill_pct: int, usable: int, key_size: int, record_size: int, slot_size: int = 6) -> int:
    return max(1, int(fill_pct / 100 * ((usable - 2 * key_size) / (record_size + slot_size))))


def repack_fill(n: int, fanout: int, fill_pct: int, usable: int, key_size: int, record_size: int) -> tuple[int, int]:
    """Fill percentage, raised by one until the pages are at most ``fanout``, and records per page."""
    while fill_pct < 100 and -(-n // records_per_page(fill_pct, usable, key_size, record_size)) > fanout:
        fill_pct += 1
    return fill_pct, records_per_page(fill_pct, usable, key_size, record_size)


def _chains(view: DataFrame, width: int) -> DataFrame:
    """Records with their chain (``width`` keys each), their place in it from 0 and its number of records ``n``."""
    chain = Window.partitionBy("chain")
    rows = view.withColumn("chain", F.floor(F.col("key") / width).cast("long"))
    return rows.withColumn("rn", F.row_number().over(chain.orderBy("key")) - 1).withColumn("n", F.count("*").over(chain))


def flatten_chains(view: DataFrame, width: int, per_page: int) -> DataFrame:
    """Every chain of ``width`` keys packed on its own: ``chain, key, value, page``, pages from 0 in each chain."""
    return _chains(view, width).select("chain", "key", "value", F.floor(F.col("rn") / per_page).cast("long").alias("page"))


def repack_chains(view: DataFrame, width: int, fanout: int, fill_pct: int, usable: int, key_size: int, record_size: int) -> DataFrame:
    """Every chain repacked with the fill that ``repack_fill`` gives for its own number of records."""
    per_page = F.array(*[F.lit(records_per_page(p, usable, key_size, record_size)) for p in range(fill_pct, 101)])
    fits = F.filter(per_page, lambda r: F.ceil(F.col("n") / r) <= fanout)
    rows = _chains(view, width).withColumn("per", F.coalesce(F.get(fits, F.lit(0)), F.element_at(per_page, -1)))
    return rows.select("chain", "key", "value", F.floor(F.col("rn") / F.col("per")).cast("long").alias("page"))


def build_pages(keys: DataFrame, goal: float, epsilon: float, *, shards: int = 1, method: str = "optimal") -> DataFrame:
    """Learned segments and their pages, one row per page.

    Segmentation is sequential over sorted keys.  Key ranges (``shards``, by approximate quantiles)
    are segmented independently; a shard boundary forces one more cut and keeps every bound on
    records per page and segment.  ``upper`` is exclusive; the first page of all starts at 0.
    """
    bounds = [int(b) for b in sorted(set(keys.approxQuantile("key", [i / shards for i in range(1, shards)], 0.001)))] if shards > 1 else []

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, rows = int(pdf["shard"].iloc[0]), []
        for seg in build_segments(sorted(pdf["key"].tolist()), goal, epsilon, method):
            lowers = page_lower_bounds(seg, seg.keys[-1] + 1)
            cuts = [*lowers[1:], seg.keys[-1] + 1]
            at = 0
            for i, (low, high) in enumerate(zip(lowers, cuts, strict=True)):
                n = 0
                while at < len(seg.keys) and seg.keys[at] < high:
                    at, n = at + 1, n + 1
                line = seg.line
                rows.append((shard, seg.base, seg.pages, line.slope if line else None, line.intercept if line else None, i, low, high, n))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PAGE_SCHEMA.split(", ")])

    pages = keys.select("key", range_bucket(F.col("key"), bounds).alias("shard")).groupBy("shard").applyInPandas(pack, PAGE_SCHEMA)
    # pages of one shard are contiguous; the first page of a shard takes the gap before it
    inside = Window.partitionBy("shard").orderBy("lower", "page_idx")
    return pages.withColumn("upper", F.coalesce(F.lead("lower").over(inside), F.lit(MAX_KEY)))


def segments_of(pages: DataFrame) -> DataFrame:
    return pages.groupBy("shard", "base_key").agg(F.max("page_count").alias("page_count"), F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.sum("n_records").alias("n_records"))


def segment_summary(segments: DataFrame) -> DataFrame:
    """Number of segments of each size, sizes without a segment included."""
    sizes = segments.sparkSession.createDataFrame([(p,) for p in SEGMENT_PAGES], "page_count int")
    counted = segments.groupBy("page_count").agg(F.count("*").alias("n"))
    return sizes.join(counted, "page_count", "left").select(F.col("page_count").alias("segment_page_count"), F.coalesce("n", F.lit(0)).alias("num_segments"))


def layout_check(pages: DataFrame, goal: float, epsilon: float) -> DataFrame:
    """Counts of pages and segments out of bounds; the last of a shard may be short."""
    last_page = F.max(F.struct("lower", "page_idx")).over(Window.partitionBy("shard"))
    per_page = pages.withColumn("tail", F.struct("lower", "page_idx") == last_page)
    modelled = F.col("page_count") > 1
    over = F.col("n_records") > F.when(modelled, goal + 2 * epsilon).otherwise(goal)
    under = modelled & ~F.col("tail") & (F.col("n_records") < goal - 2 * epsilon)
    a = per_page.agg(F.count(F.when(over, 1)).alias("pages_over"), F.count(F.when(under, 1)).alias("pages_under"))
    seg = segments_of(pages)
    over = F.col("n_records") > F.col("page_count") * (goal + epsilon)
    b = seg.agg(F.count(F.when(over & (F.col("page_count") > 1), 1)).alias("segments_over"), F.sum("n_records").cast("long").alias("n_records"))
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")


def _carry_forward(batches):
    """Fills each asked key with the last interval before it, from the partition or from those before."""
    last = None
    for b in batches:
        hit, carry = b.column("hit"), b.column("carry")
        known = hit.is_valid().to_numpy(zero_copy_only=False)
        at = np.maximum.accumulate(np.where(known, np.arange(b.num_rows), -1))
        fill = last if last is not None else carry[0] if b.num_rows else None
        found = pc.take(hit, pa.array(np.maximum(at, 0)))
        if (at < 0).any():
            found = pc.if_else(pa.array(at >= 0), found, pa.scalar(fill.as_py(), hit.type))
        if known.any():
            last = hit[int(at[-1])]
        asked = pc.equal(b.column("kind"), 1)
        yield pa.RecordBatch.from_arrays([b.column("key"), found], names=["key", "found"]).filter(asked)


def interval_lookup(keys: DataFrame, intervals: DataFrame, id_col: str) -> DataFrame:
    """The interval ``[lower, upper)`` of each key by predecessor search; keys below the first clamp to it.

    Interval starts and keys are sorted together in ranges that follow the data; a salt splits a
    key that many rows ask for.  The last start of each range is carried into the next ones, one row per
    range, and one pass over the sorted rows fills the keys.  No pair is built and no key meets in one task.
    """
    kind_of = intervals.schema[id_col].dataType
    marks = checkpointed(intervals.select(F.col("lower").alias("at"), F.col(id_col).alias("hit"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("key"), F.lit(0).cast("long").alias("salt")))
    asks = keys.select(F.col("key").alias("at"), F.lit(None).cast(kind_of).alias("hit"), F.lit(1).alias("kind"), "key", F.pmod(F.monotonically_increasing_id(), F.lit(4096)).alias("salt"))
    rows = in_order(marks.unionByName(asks), "at", "kind", "salt")
    first = marks.agg(F.min(F.struct("at", "hit")).alias("f")).select(F.col("f.hit").alias("first"))
    ends = rows.groupBy("__part").agg(F.max(F.when(F.col("kind") == 0, F.struct("at", "hit"))).alias("end"))
    before = F.max("end").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("__part", before.alias("before")).crossJoin(F.broadcast(first))  # one row per range
    ends = ends.select("__part", F.coalesce("before.hit", "first").alias("carry"))
    rows = rows.join(F.broadcast(ends), "__part").select("hit", "carry", "kind", "key")
    return rows.mapInArrow(_carry_forward, f"key long, found {kind_of.simpleString()}").withColumnRenamed("found", id_col)


def page_assignment(keys: DataFrame, pages: DataFrame) -> DataFrame:
    """The learned page of each key: ``key, lower``, the page's lower bound."""
    return interval_lookup(keys, pages.select("lower", F.col("lower").alias("page_lower")), "page_lower").withColumnRenamed("page_lower", "lower")


def batch_by_segment(batch: DataFrame, segments: DataFrame) -> DataFrame:
    """A write batch cut at the segments' bounds: ``segment_id, n, first_key, last_key``."""
    placed = interval_lookup(batch, segments.select(F.col("base_key").alias("lower"), "segment_id"), "segment_id")
    return placed.groupBy("segment_id").agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def scan_page_estimate(position: Column, records: Column, page_count: Column, goal: int) -> Column:
    """Pages of its first segment that a scan reads: what the page of the start's ``position`` does not hold, in whole pages."""
    at = F.greatest(position, F.lit(0.0))
    page = F.floor(at)
    here = F.lit(goal) - (at - page) * goal
    rest = records - here.cast("long")
    more = F.least(F.ceil(rest / F.lit(float(goal))), page_count - page - 1)
    return F.when((page_count <= 1) | (page >= page_count) | (rest <= 0), F.lit(1)).otherwise(1 + more).cast("long")


def prefetch_pages(records: Column, goal: int) -> Column:
    """Pages that a prefetching scan asks for; those beyond the pages it uses are over-fetched."""
    return (2 + F.ceil(records / F.lit(float(goal)))).cast("long")


#: Points in a row of packed points; a batch of such rows must fit a Python worker.
BLOCK_POINTS = 256


def _pack_points(batches):
    for b in batches:
        if b.num_rows:
            xs, ys = (b.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            at = range(0, b.num_rows, BLOCK_POINTS)
            packed = [pa.array([v[i : i + BLOCK_POINTS].tobytes() for i in at], pa.binary()) for v in (xs, ys)]
            yield pa.RecordBatch.from_arrays([b.column("__part").take(list(at)), b.column("__place").take(list(at)), *packed], names=["__part", "__place", "xs", "ys"])


def plr_runs(points: DataFrame, delta: float, method: str) -> DataFrame:
    """Runs of the sorted points ``x, y`` that a line holds within ``delta``: ``start_x, n, slope, intercept, worst``.

    Where a run begins depends on all before it, so one task fits; the points are sorted in key ranges and
    come to it packed, in order and one batch at a time.
    """
    ordered = in_order(points.select(F.col("x").cast("long").alias("x"), F.col("y").cast("double").alias("y")), "x")
    packed = ordered.mapInArrow(_pack_points, "__part int, __place long, xs binary, ys binary")

    def fit(batches):
        blocks = ((np.frombuffer(x.as_py(), np.int64).tolist(), np.frombuffer(y.as_py(), np.float64).tolist()) for b in batches for x, y in zip(b.column("xs"), b.column("ys"), strict=True))
        for some in batched(fit_blocks(blocks, delta, method), 4096):
            rows = [(r.base, r.count, r.line.slope, r.line.intercept, r.worst) for r in some]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["start_x", "n", "slope", "intercept", "worst"])

    one = packed.repartition(1).sortWithinPartitions("__part", "__place")
    return one.mapInArrow(fit, "start_x long, n long, slope double, intercept double, worst double")


def overflow_islands(segments: DataFrame) -> DataFrame:
    """Maximal runs of consecutive segments that have an overflow: ``island, first_base, last_base, n``."""
    numbered = number_rows(segments.withColumnRenamed("base_key", "key"), "key", "pos")
    flagged = numbered.where("has_overflow")
    island = number_rows(flagged, "key", "k").withColumn("island", F.col("pos") - F.col("k"))
    return island.groupBy("island").agg(F.min("key").alias("first_base"), F.max("key").alias("last_base"), F.count("*").alias("n"))


def rewrite_region(segments: DataFrame, base_key: int, radius: int) -> DataFrame:
    """The segment and up to ``radius`` consecutive neighbours per side that have an overflow."""
    numbered = number_rows(segments.withColumnRenamed("base_key", "key"), "key", "pos")
    center = numbered.where(F.col("key") == base_key).select(F.col("pos").alias("center"))
    near = numbered.join(center, F.abs(F.col("pos") - F.col("center")) <= radius)
    side = F.signum(F.col("pos") - F.col("center"))
    # a neighbour counts while every segment between it and the centre has an overflow
    away = Window.partitionBy("side").orderBy(F.abs(F.col("pos") - F.col("center"))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("side", side).withColumn("held", F.min(F.col("has_overflow").cast("int")).over(away))
    return near.where((F.col("side") == 0) | (F.col("held") == 1)).select(F.col("key").alias("base_key"), "has_overflow")
