"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of the sampling order within a source; only one bucket per source is ever ranked row by row.
ORDER_BUCKETS = 4096
#: A table of sources up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 50_000


def count_words(text: Column) -> Column:
    """Maximal runs of characters other than space and 0x09-0x0D; null: 0."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, *, weights=(1, 2, 3), max_copies: int = 3) -> DataFrame:
    """Targets per source: ``source, source_size, target``.

    Sources by code point, null last, take the weights in turn and share all sizes in proportion.  A
    target stops at ``max_copies`` times its source's size; the excess goes to the others by weight
    until none is above.  In the order of size per weight the stopped sources are a first run, so one
    pass over that order finds them: source k stops if its cap is at most its share of what the
    sources before it leave.  Works on one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    everything = Window.partitionBy()
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    upto = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("source_size").over(everything).cast("double")
    left_words = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("share", left_words / left_weight).withColumn("stops", F.col("cap") <= F.col("share") * F.col("weight"))
    # once one source does not stop, none after it does
    per = per.withColumn("stops", F.min(F.col("stops").cast("int")).over(upto) == 1)
    free = F.min(F.when(~F.col("stops"), F.struct((F.col("cap") / F.col("weight")).alias("o"), "share"))).over(everything)
    per = per.withColumn("free_share", free["share"])
    return per.select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("free_share") * F.col("weight")).alias("target"))


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner", few: bool = False) -> DataFrame:
    """Joins a table of one row per source; ``few``: its rows were counted and are few."""
    right = right.withColumnRenamed("source", "r_source")
    right = F.broadcast(right) if few else right
    return left.join(right, F.col("source").eqNullSafe(F.col("r_source")), how).drop("r_source")


def _ordered(rows: DataFrame, seed: int) -> DataFrame:
    """Adds ``order`` in [0, 1], the Pareto ratio of random odds to inclusion odds on a bounded scale, and its bucket."""
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2**52)).cast("double") + 0.5) / F.lit(float(2**52))
    p = F.col("c") * F.col("size")
    # sizes with c * size >= 1 come first for certain, sizes of 0 last
    ratio = F.when(F.col("c").isNull() | (p >= 1), F.lit(0.0)).when(p > 0, (u / (1 - u)) / (p / (1 - p)))
    rows = rows.withColumn("order", F.when(ratio.isNull(), F.lit(1.0)).otherwise(ratio / (1 + ratio)))
    return rows.withColumn("bucket", F.least(F.floor(F.col("order") * ORDER_BUCKETS), F.lit(ORDER_BUCKETS - 1)).cast("int"))


def _place() -> Column:
    """Where a row stands in the order of its source."""
    return F.struct("order", "id", "size")


def _at(order: Column) -> Column:
    """The place before all rows of this order."""
    return F.struct(order.cast("double").alias("order"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("size"))


def _walk(base: DataFrame, targets: DataFrame, seed: int, few: bool, tolerance: float) -> DataFrame:
    """Walks down the order of each source and takes what fits: ``source, steps``.

    A step takes all documents of at most ``most`` words after the place ``low`` up to the place
    ``high``; the document after that is larger than what is left and is passed over, and
    the next step goes on behind it.  A source ends when nothing left fits, or when what is
    missing is at most ``tolerance`` of its target; where even then a document beyond the target is
    nearer than none, the smallest one left closes the gap.

    Each step sums words per bucket and ranks the rows of one bucket per source only.  A step ends
    at most one document before the target, so that large sources need one step.
    """
    state = targets.where("rest > 0").select("source", "target", F.col("rest").alias("missing"), _at(F.lit(-1.0)).alias("low"), F.lit(True).alias("open"))
    steps = None
    while True:
        state = checkpointed(state)
        going = state.where(F.col("open") & (F.col("missing") > F.col("target") * tolerance))
        if going.isEmpty():
            break
        own = targets.select("source", "c")
        left = _ordered(_by_source(_by_source(base, own, "inner", few), going, "inner", few), seed)
        left = left.where((F.col("size") > 0) & (F.col("size") <= F.col("missing")) & (_place() > F.col("low")))
        ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = left.groupBy("source", "bucket", "missing").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
        over = (F.col("before") <= F.col("missing")) & (F.col("before") + F.col("words") > F.col("missing"))
        ends = sums.groupBy("source").agg(F.min(F.when(over, F.struct("bucket", "before"))).alias("e"), F.sum("words").alias("all")).select("source", F.col("e.bucket").alias("b"), F.col("e.before").alias("before"), "all")
        ends = checkpointed(ends)
        # the rows of one bucket per source, ranked
        rank = Window.partitionBy("source").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        edge = _by_source(left, ends.where("b is not null"), "inner", few).where("bucket = b").withColumn("reached", F.col("before") + F.sum(F.col("size") * F.col("n")).over(rank))
        fits = F.col("reached") <= F.col("missing")
        edge = edge.groupBy("source").agg(F.max(F.when(fits, _place())).alias("last"), F.min(F.when(~fits, _place())).alias("passed"), F.max(F.when(fits, F.col("reached"))).alias("reached"))
        step = _by_source(_by_source(going, ends, "left"), edge, "left")
        words = F.when(F.col("b").isNull(), F.coalesce("all", F.lit(0))).otherwise(F.coalesce("reached", "before"))
        high = F.when(F.col("b").isNull(), _at(F.lit(2.0))).otherwise(F.coalesce("last", _at(F.col("b") / F.lit(float(ORDER_BUCKETS)))))
        step = checkpointed(step.select("source", "target", "missing", "low", high.alias("high"), (F.col("missing") - words).alias("then"), "passed"))
        done = step.select("source", F.struct(F.col("missing").alias("most"), "low", "high").alias("step"))
        steps = done if steps is None else steps.unionAll(done)
        ended = state.join(going.select(F.col("source").alias("g")), F.col("source").eqNullSafe(F.col("g")), "left_anti")
        state = ended.unionAll(step.select("source", "target", F.col("then").alias("missing"), F.coalesce("passed", "high").alias("low"), F.col("passed").isNotNull().alias("open")))
    if steps is None:  # every target is a number of whole copies
        place = "struct<order:double,id:long,size:long>"
        return targets.select("source", F.lit(None).cast(f"array<struct<most:double,low:{place},high:{place}>>").alias("steps"))
    steps = checkpointed(steps.groupBy("source").agg(F.collect_list("step").alias("steps")))
    # nothing left fits: the smallest document left, where it brings the total nearer
    short = _by_source(state.where(F.col("missing") > F.col("target") * tolerance), steps, "left")
    rows = _ordered(_by_source(_by_source(base, targets.select("source", "c"), "inner", few), short, "inner", few), seed)
    inside = F.exists("steps", lambda x: (F.col("size") <= x["most"]) & (_place() > x["low"]) & (_place() <= x["high"]))
    beyond = rows.where((F.col("n") == 1) & (F.col("size") > F.col("missing")) & (F.col("size") < 2 * F.col("missing")) & ~F.coalesce(inside, F.lit(False)))
    closing = beyond.groupBy("source").agg(F.min(F.struct("size", "order", "id")).alias("m"))
    closing = closing.select("source", F.struct(F.col("m.size").cast("double").alias("most"), F.struct(F.col("m.order").alias("order"), F.col("m.id").alias("id"), (F.col("m.size") - 1).alias("size")).alias("low"), F.struct("m.order", "m.id", "m.size").alias("high")).alias("last"))
    every = _by_source(steps, closing, "left", few)
    return checkpointed(every.select("source", F.when(F.col("last").isNotNull(), F.concat("steps", F.array("last"))).otherwise(F.col("steps")).alias("steps")))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), max_copies: int = 3, seed: int = 20, tolerance: float = 0.002, keep: bool = False) -> DataFrame:
    """How much of each document a mix with the given source weights takes.

    Every document first gets ``floor(target / source_size)`` certain whole copies.  The rest of the
    target is a Pareto order sample without replacement: with inclusion odds in proportion to size,
    ``p = min(1, c * size)`` (c such that the expected words equal the rest), documents are ranked by
    the odds of a random number, made from the id and ``seed``, divided by the odds of ``p``, and
    the first ones are taken up to the rest.  A document that does not fit is passed over, and the
    walk goes on until nothing fits or what is missing is at most ``tolerance`` of the target; see ``_walk``.

    The order is cut in ``ORDER_BUCKETS`` buckets per source.  Sums per bucket are pre-aggregated;
    whole buckets before the boundary are taken and only rows of the boundary bucket are ranked, and
    the table of sources is broadcast where it is small, so a source with a third of all rows never
    meets in one task.  Reruns agree.

    Result per document: ``id, size, source_size, target, taken`` (words, repeats counted) and with
    ``keep`` all input columns instead of the id, under their own names, with the results in a
    struct ``mix`` (an input column of that name gives way to it).  Null texts have size 0; documents of size 0 are taken as 0 words; a null source
    is a source of its own, last in order; sources without words have target 0; ties in the order are
    broken by id; repeated rows each count; empty tables give an empty result.
    """
    fields = [F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size")]
    # one pass over the texts; from here on a row per distinct (id, source, size)
    base = checkpointed(docs.select(*fields).groupBy("id", "source", "size").agg(F.count("*").alias("n")))
    hist = base.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = source_targets(hist.select("source", (F.col("size") * F.col("n")).alias("size")), weights=weights, max_copies=max_copies)
    targets = targets.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    # c: the largest sizes are certain until c * size < 1 for all others
    down = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    words, squares = F.col("size") * F.col("n").cast("double"), F.col("size").cast("double") * F.col("size") * F.col("n")
    c = (
        _by_source(hist, targets.select("source", "rest"))
        .withColumn("certain", F.coalesce(F.sum(words).over(down), F.lit(0.0)))
        .withColumn("others", F.sum(squares).over(whole) - F.coalesce(F.sum(squares).over(down), F.lit(0.0)))
        .withColumn("c", F.when(F.col("others") > 0, (F.col("rest") - F.col("certain")) / F.col("others")))
        .where("c > 0 and c * size < 1")
        .groupBy("source")
        .agg(F.max_by("c", "size").alias("c"))
    )
    targets = checkpointed(_by_source(targets, c, "left"))

    few = targets.count() <= BROADCAST_SOURCES
    steps = _walk(base, targets, seed, few, tolerance)
    targets = _by_source(targets, steps, "left", few)

    if keep:
        base = docs.select(*fields, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).withColumn("n", F.lit(1))
    rows = _ordered(_by_source(base, targets, "inner", few), seed)
    taken = F.exists("steps", lambda x: (F.col("size") <= x["most"]) & (_place() > x["low"]) & (_place() <= x["high"]))
    sampled = F.coalesce((taken & (F.col("size") > 0)).cast("int"), F.lit(0))
    copies = (F.col("copies") + sampled).cast("long")
    outcome = ["size", "source_size", "target", (copies * F.col("size")).alias("taken")]
    if keep:
        own = [F.col(f"doc.`{c}`") for c in docs.columns if c.lower() != "mix"]
        return rows.select("doc", F.struct(copies.alias("copies"), *outcome).alias("mix")).select(*own, "mix")
    return rows.withColumn("_", F.explode(F.expr("array_repeat(0, cast(n as int))"))).select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *outcome)
