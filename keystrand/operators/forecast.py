"""Insert epochs, equi-depth histograms and what they forecast."""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrand.functions.keys import MAX_KEY


def insert_epochs(inserts: DataFrame, sample: int, per_epoch: int) -> DataFrame:
    """Epoch of each insert ``seq, key`` (``seq`` from 0); the sample that comes first has epoch -1."""
    return inserts.withColumn("epoch", F.when(F.col("seq") < sample, -1).otherwise(F.floor((F.col("seq") - sample) / per_epoch)).cast("long"))


def first_bounds(inserts: DataFrame, sample: int, parts: int) -> DataFrame:
    """Equi-depth bounds from the first ``sample`` keys: ``part, lower, upper`` (exclusive)."""
    ordered = inserts.where(F.col("seq") < sample).withColumn("i", F.row_number().over(Window.orderBy("key", "seq")) - 1)
    step = sample // parts
    bounds = ordered.where(F.col("i") % step == 0).select((F.col("i") / step).cast("int").alias("part"), F.col("key").alias("lower")).where(F.col("part") < parts)
    return bounds.withColumn("upper", F.lead("lower", 1, MAX_KEY).over(Window.orderBy("part")))


def equi_depth(inserts: DataFrame, sample: int, parts: int, per_epoch: int) -> DataFrame:
    """Counts of the first epoch per part; keys under the first bound are ignored.  Bounds are ``parts`` rows."""
    bounds = F.broadcast(first_bounds(inserts, sample, parts))
    epoch = insert_epochs(inserts, sample, per_epoch).where("epoch = 0").select("key")
    hit = bounds.join(epoch, (F.col("key") >= F.col("lower")) & (F.col("key") < F.col("upper")), "left")
    return hit.groupBy("part", "lower", "upper").agg(F.count("key").alias("cnt"))


def epoch_samples(inserts: DataFrame, sample: int, per_epoch: int) -> list[tuple[int, list[int]]]:
    """Sorted sample of the inserts before each epoch, where it changes: ``(first epoch, keys)``.

    The sample is the ``sample`` inserts of least md5 of ``seq`` so far, a uniform one as a
    reservoir keeps, and the first ``sample`` inserts for epoch 0.  ``seq`` has no gaps.  Inserts are
    split where ``seq`` doubles; only those below the greatest hash of the sample at the start of
    their part can enter it, so that the driver gets a few times ``sample`` rows per doubling.
    """
    times = F.floor(F.col("seq") / sample)
    hashed = inserts.select("seq", "key", F.md5(F.col("seq").cast("string")).alias("h")).withColumn("chunk", F.when(times < 1, 0).otherwise(F.length(F.bin(times))))
    least = Window.partitionBy("chunk").orderBy("h", "seq")
    tops: dict[int, list] = {}
    for r in hashed.withColumn("i", F.row_number().over(least)).where(F.col("i") <= sample).collect():
        tops.setdefault(r["chunk"], []).append((r["h"], r["seq"], r["key"]))
    held = sorted(tops.pop(0, []))
    if len(held) < sample:
        return []
    enters, so_far = F.lit(False), held
    for chunk in sorted(tops):
        enters = enters | ((F.col("chunk") == chunk) & (F.col("h") <= so_far[-1][0]))
        so_far = sorted(so_far + tops[chunk])[:sample]
    later = sorted((r["seq"], r["h"], r["key"]) for r in hashed.where(enters).collect())
    states = [(0, sorted(x[2] for x in held))]
    for seq, h, key in later:
        insort(held, (h, seq, key))
        if held.pop()[1] == seq:
            continue
        first = (seq - sample) // per_epoch + 1
        if states[-1][0] == first:
            states.pop()
        states.append((first, sorted(x[2] for x in held)))
    return states


def equi_depth_epochs(inserts: DataFrame, sample: int, parts: int, per_epoch: int) -> DataFrame:
    """Counts of every epoch per part: ``epoch, inserts, part, lower, upper, cnt``; the last epoch may be unfinished.

    The bounds of an epoch come from the sample of all inserts before it; keys under the first bound
    are in ``inserts`` alone.  No epoch, no row.
    """
    spark = inserts.sparkSession
    inserts = inserts.where("seq is not null and key is not null")
    states = epoch_samples(inserts, sample, per_epoch)
    if not states:
        return spark.createDataFrame([], "epoch long, inserts long, part int, lower long, upper long, cnt long")
    step = sample // parts
    starts = np.array([e for e, _ in states])
    lowers = np.array([keys[: step * parts : step] for _, keys in states])

    def place(batches):
        for b in batches:
            at = np.searchsorted(starts, b.column(0).to_numpy(), "right") - 1
            part = (lowers[at] <= b.column(1).to_numpy()[:, None]).sum(1) - 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(part.astype(np.int32))], names=["epoch", "part"])

    def with_bounds(batches):
        for b in batches:
            epoch = b.column(0).to_numpy()
            lower = lowers[np.searchsorted(starts, epoch, "right") - 1]
            upper = np.concatenate([lower[:, 1:], np.full((len(lower), 1), MAX_KEY)], 1)
            cols = [np.repeat(epoch, parts), np.repeat(b.column(1).to_numpy(), parts), np.tile(np.arange(parts, dtype=np.int32), len(epoch)), lower.ravel(), upper.ravel(), b.column(2).flatten().to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["epoch", "inserts", "part", "lower", "upper", "cnt"])

    placed = insert_epochs(inserts, sample, per_epoch).where("epoch >= 0").select("epoch", F.col("key").cast("long")).mapInArrow(place, "epoch long, part int")
    counts = placed.groupBy("epoch").agg(F.count("*").alias("inserts"), F.array(*[F.count_if(F.col("part") == i) for i in range(parts)]).alias("cnts"))
    return counts.mapInArrow(with_bounds, "epoch long, inserts long, part int, lower long, upper long, cnt long")


def last_completed(hist: DataFrame, per_epoch: int) -> DataFrame:
    """The histogram of the last epoch that is complete; no row before there is one."""
    done = hist.where(F.col("inserts") >= per_epoch)
    return done.join(F.broadcast(done.agg(F.max("epoch").alias("epoch"))), "epoch").where("upper > lower")


def overlap_forecast(hist: DataFrame, start: int, end: int, epochs: float = 1.0) -> DataFrame:
    """Inserts expected in ``[start, end)``: counts weighted by the overlapping part of each interval."""
    part = F.greatest(F.lit(0), F.least("upper", F.lit(end)) - F.greatest("lower", F.lit(start)))
    return hit_sum(hist, part, epochs)


def hit_sum(hist: DataFrame, part, epochs: float) -> DataFrame:
    return hist.agg((F.sum(F.col("cnt") * part / (F.col("upper") - F.col("lower"))) * epochs).alias("expected"))


def future_goal(goal: int, epsilon: float, pages: Column, forecast: Column, overestimate: float = 1.0) -> Column:
    """Records per page to aim at, so that the forecast inserts fit; whole records, as pages hold them."""
    now = (pages * int(goal + 2 * epsilon)).cast("double") * overestimate
    shrunk = F.greatest(F.lit(1).cast("long"), F.floor(goal * now / (now + forecast)))
    return F.greatest(F.lit(int(2 * epsilon)).cast("long"), shrunk)


def deferral_carry_over(writes: DataFrame, per_flush: int, io_threshold: int, max_deferrals: int) -> DataFrame:
    """Deferred flushes of writes ``seq, page``: ``page, writes, ios, pending``.

    The buffer is flushed after every ``per_flush`` writes.  A page with pending writes is written if
    they are ``io_threshold`` or more, or if it was passed over ``max_deferrals`` times since it was
    last written; otherwise its writes carry over.  ``pending`` are those left after the last flush.
    The fold runs along each page's flushes, pre-aggregated to one row per page and flush.
    """
    flushes = writes.agg(F.floor((F.max("seq") + 1) / per_flush).alias("flushes"))
    counts = writes.groupBy("page", F.floor(F.col("seq") / per_flush).alias("flush")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(flushes))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("flush")
        total, pending, passed, ios, at = int(pdf["flushes"].iloc[0]), 0, 0, 0, 0

        def idle(upto: int) -> None:
            """The flushes before ``upto`` that bring nothing new to the page."""
            nonlocal pending, passed, ios, at
            if pending and at + max(0, max_deferrals - passed) < upto:
                at += max(0, max_deferrals - passed) + 1
                pending, passed, ios = 0, 0, ios + 1
            passed, at = passed + max(0, upto - at), max(at, upto)

        for flush, n in zip(pdf["flush"].tolist(), pdf["n"].tolist(), strict=True):
            idle(min(flush, total))
            pending += n
            if flush >= total:
                break
            if pending >= io_threshold or passed >= max_deferrals:
                pending, passed, ios = 0, 0, ios + 1
            else:
                passed += 1
            at = flush + 1
        idle(total)
        return pd.DataFrame({"page": [pdf["page"].iloc[0]], "writes": [int(pdf["n"].sum())], "ios": [ios], "pending": [pending]})

    return counts.groupBy("page").applyInPandas(fold, "page long, writes long, ios long, pending long")
