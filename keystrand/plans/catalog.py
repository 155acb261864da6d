"""Registered queries and their DuckDB oracles, over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrand import shared
from keystrand.functions.keys import common_prefix, composite_key, key_bytes, split_key
from keystrand.operators import analytics, forecast, fsck, layout, lookup, merge
from keystrand.operators.numbering import number_rows
from keystrand.sources import workloads
from keystrand.shared import checkpointed
from keystrand.sources.store import KVStore
from keystrand.streaming import log_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# building blocks of the oracles
BASE_SQL = "SELECT c_custkey + 1 AS key, c_acctbal AS value FROM customer"
LOG_SQL = "SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'D' ELSE 'W' END AS op, user_id + 1 AS key, value FROM events"
LATEST_SQL = f"SELECT key, seq, op, value FROM ({LOG_SQL}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1"
VIEW_SQL = f"""SELECT coalesce(b.key, l.key) AS key, CASE WHEN l.key IS NULL THEN b.value ELSE l.value END AS value
FROM ({BASE_SQL}) b FULL JOIN ({LATEST_SQL}) l ON b.key = l.key WHERE l.op IS NULL OR l.op = 'W'"""
ORDERS_SQL = "SELECT o_orderkey + 1 AS key, o_totalprice AS value FROM orders"
PACK_SQL = f"SELECT key, value, (row_number() OVER (ORDER BY key) - 1) // 44 AS page FROM ({ORDERS_SQL})"
SEG_SQL = f"SELECT page AS segment_id, min(key) AS base_key, count(*) AS n_records, page % 3 <> 0 AS has_overflow FROM ({PACK_SQL}) GROUP BY page"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def base(s, sf):
    return t(s, sf, "customer").select((F.col("c_custkey") + 1).alias("key"), F.col("c_acctbal").alias("value"))


def log(s, sf):
    return t(s, sf, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "D").otherwise("W").alias("op"), (F.col("user_id") + 1).alias("key"), "value")


def view(s, sf):
    return merge.merge_view(base(s, sf), log(s, sf))


def orders(s, sf):
    return t(s, sf, "orders").select((F.col("o_orderkey") + 1).alias("key"), F.col("o_totalprice").alias("value"))


def packed(s, sf):
    return layout.pages_fixed_pack(orders(s, sf), 44)


def segments(s, sf):
    pages = packed(s, sf).groupBy("page").agg(F.min("key").alias("base_key"), F.count("*").alias("n_records"))
    return pages.select(F.col("page").alias("segment_id"), "base_key", "n_records", (F.col("page") % 3 != 0).alias("has_overflow"))


# --- reads -----------------------------------------------------------------------------------


@query("kv_range_scan", f"SELECT key, value FROM ({VIEW_SQL}) WHERE key >= 40 ORDER BY key LIMIT 100")
def _(s, sf):
    return lookup.range_scan(view(s, sf), 40, 100)


@query("kv_get", f"SELECT key, value FROM ({VIEW_SQL}) WHERE key = 77")
def _(s, sf):
    return lookup.get(view(s, sf), 77)


@query("kv_multi_get", f"SELECT k.key, v.value FROM (SELECT DISTINCT o_custkey * 2 + 1 AS key FROM orders) k LEFT JOIN ({VIEW_SQL}) v ON k.key = v.key")
def _(s, sf):
    return lookup.multi_get(view(s, sf), t(s, sf, "orders").select((F.col("o_custkey") * 2 + 1).alias("key")))


@query("delta_range_n", f"SELECT key, seq, op, value FROM ({LATEST_SQL}) WHERE key >= 20 ORDER BY key LIMIT 10")
def _(s, sf):
    return merge.latest_per_key(log(s, sf)).where("key >= 20").orderBy("key").limit(10)


@query("delta_range_bound", f"SELECT key, seq, op, value FROM ({LATEST_SQL}) WHERE key >= 20 AND key < 45")
def _(s, sf):
    return lookup.range_between(merge.latest_per_key(log(s, sf)), 20, 45)


@query("seek_lower_bound", f"SELECT min(key) FILTER (key >= 500) AS lower, max(key) AS last, count(*) FILTER (key >= 500) AS \"left\" FROM ({VIEW_SQL})")
def _(s, sf):
    return lookup.seek(view(s, sf), 500)


@query("page_neighbors", f"SELECT key, value, page FROM ({PACK_SQL}) WHERE page = (SELECT max(page) FROM ({PACK_SQL}) WHERE key <= 1000)")
def _(s, sf):
    return layout.page_neighbors(packed(s, sf), 1000).select("key", "value", "page")


@query("kv_count", f"SELECT count(*) AS n FROM ({VIEW_SQL})")
def _(s, sf):
    return view(s, sf).agg(F.count("*").alias("n"))


@query("memtable_latest", LATEST_SQL)
def _(s, sf):
    return merge.latest_per_key(log(s, sf))


@query("filter_isin", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND NOT (value < 0)")
def _(s, sf):
    return t(s, sf, "events").where(F.col("event_type").isin("click", "view") & ~(F.col("value") < 0)).select("event_id", "event_type")


@query("project_rename", "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice / 1000 AS kprice FROM orders")
def _(s, sf):
    o = t(s, sf, "orders").drop("o_orderpriority").withColumnRenamed("o_orderkey", "id").withColumnRenamed("o_orderstatus", "status")
    return o.select("id", "status", (F.col("o_totalprice") / 1000).alias("kprice"))


# --- writes and merges -----------------------------------------------------------------------


@query("kv_merge_view", VIEW_SQL)
def _(s, sf):
    return view(s, sf)


@query("kv_put_upsert", f"SELECT key, value FROM ({BASE_SQL}) WHERE key NOT IN (SELECT s_suppkey + 1 FROM supplier) UNION ALL SELECT s_suppkey + 1, s_acctbal FROM supplier")
def _(s, sf):
    return merge.upsert(base(s, sf), t(s, sf, "supplier").select((F.col("s_suppkey") + 1).alias("key"), F.col("s_acctbal").alias("value")))


@query("kv_delete", f"SELECT key, value FROM ({BASE_SQL}) WHERE key NOT IN (SELECT user_id + 1 FROM events)")
def _(s, sf):
    return merge.delete(base(s, sf), log(s, sf))


@query("wal_replay", f"SELECT key, value FROM ({LATEST_SQL}) WHERE op = 'W'")
def _(s, sf):
    return merge.merge_view(base(s, sf).limit(0), log(s, sf))


@query("wal_discard", f"SELECT seq, op, key, value FROM ({LOG_SQL}) WHERE seq > 500")
def _(s, sf):
    return log(s, sf).where("seq > 500")


@query("dirty_records", f"SELECT key, seq, op, value FROM ({LATEST_SQL.replace('QUALIFY', 'WHERE seq > 500 QUALIFY')})")
def _(s, sf):
    return lookup.dirty_records(log(s, sf), 500)


@query(
    "memtable_merge",
    f"SELECT key, op, value FROM (SELECT *, seq % 2 AS level FROM ({LOG_SQL})) QUALIFY row_number() OVER (PARTITION BY key ORDER BY level DESC, seq DESC) = 1",
)
def _(s, sf):
    rows = log(s, sf)
    return merge.memtable_merge(rows.where("seq % 2 = 1"), rows.where("seq % 2 = 0"))


@query("kway_merge", f"SELECT key, value FROM ({BASE_SQL}) UNION ALL SELECT s_suppkey + 1, s_acctbal FROM supplier UNION ALL SELECT p_partkey + 1, p_retailprice FROM part")
def _(s, sf):
    sup = t(s, sf, "supplier").select((F.col("s_suppkey") + 1).alias("key"), F.col("s_acctbal").alias("value"))
    part = t(s, sf, "part").select((F.col("p_partkey") + 1).alias("key"), F.col("p_retailprice").alias("value"))
    return merge.kway_merge(base(s, sf), sup, part)


@query("rmw_apply", f"SELECT v.key, l.seq, 'W' AS op, v.value * 2 + 1 AS value FROM ({VIEW_SQL}) v JOIN ({LATEST_SQL}) l ON v.key = l.key")
def _(s, sf):
    return merge.read_modify_write(view(s, sf), merge.latest_per_key(log(s, sf)), lambda v: v * 2 + 1)


@query("flush_compact", f"SELECT key, value, (row_number() OVER (ORDER BY key) - 1) // 44 AS page FROM ({VIEW_SQL})")
def _(s, sf):
    return layout.pages_fixed_pack(view(s, sf), 44)


@query("compact_range", f"SELECT key, value FROM ({VIEW_SQL}) WHERE key >= 30 AND key < 400")
def _(s, sf):
    inside = lambda d: d.where("key >= 30 and key < 400")
    return merge.merge_view(inside(base(s, sf)), inside(log(s, sf)))


@query("flatten_range", f"SELECT key, value, (row_number() OVER (ORDER BY key) - 1) // 20 AS page FROM ({VIEW_SQL}) WHERE key >= 1 AND key < 150")
def _(s, sf):
    inside = lambda d: d.where("key >= 1 and key < 150")
    return layout.pages_fixed_pack(merge.merge_view(inside(base(s, sf)), inside(log(s, sf))), 20)


# --- load and layout -------------------------------------------------------------------------


@query("bulk_load_fill_pages", PACK_SQL)
def _(s, sf):
    return packed(s, sf)


@query("bulk_load_pg", f"SELECT page, min(key) AS lower, max(key) AS last, count(*) AS n_records FROM ({PACK_SQL}) GROUP BY page")
def _(s, sf):
    return layout.page_summary(packed(s, sf))


@query("pages_fixed_pack", f"SELECT key, value, (row_number() OVER (ORDER BY key) - 1) // 15 AS page FROM ({BASE_SQL})")
def _(s, sf):
    return layout.pages_fixed_pack(base(s, sf), 15)


@query(
    "bulk_load_validate",
    """WITH r AS (SELECT event_id AS pos, user_id AS key FROM events)
SELECT count(*) FILTER (key < 1) AS reserved, count(*) AS n, (SELECT count(*) FROM (SELECT key FROM r GROUP BY key HAVING count(*) > 1)) AS duplicate_keys,
(SELECT count(*) FROM (SELECT key, lead(key) OVER (ORDER BY pos) AS nk FROM r) WHERE nk <= key) AS unordered FROM r""",
)
def _(s, sf):
    return fsck.load_violations(t(s, sf, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("key")))


@query("kv_reopen_index", f"SELECT base_key, segment_id, lead(base_key, 1, 9223372036854775807) OVER (ORDER BY base_key) AS upper_key FROM ({SEG_SQL})")
def _(s, sf):
    seg = number_rows(segments(s, sf).withColumnRenamed("base_key", "key"), "key", "pos")
    after = seg.select((F.col("pos") - 1).alias("pos"), F.col("key").alias("upper_key"))
    return seg.join(after, "pos", "left").select(F.col("key").alias("base_key"), "segment_id", F.coalesce("upper_key", F.lit(2**63 - 1)).alias("upper_key"))


@query("win_segment_bounds", f"SELECT page, lower, lead(lower, 1, 9223372036854775807) OVER (ORDER BY page) AS upper FROM (SELECT page, min(key) AS lower FROM ({PACK_SQL}) GROUP BY page)")
def _(s, sf):
    pages = layout.page_summary(packed(s, sf))
    after = pages.select((F.col("page") - 1).alias("page"), F.col("lower").alias("upper"))
    return pages.join(after, "page", "left").select("page", "lower", F.coalesce("upper", F.lit(2**63 - 1)).alias("upper"))


@query("asof_segment_lookup", f"SELECT k.key, coalesce((SELECT max(segment_id) FROM ({SEG_SQL}) g WHERE g.base_key <= k.key), 0) AS segment_id FROM (SELECT l_orderkey * 3 + 1 AS key FROM lineitem WHERE l_linenumber = 1) k")
def _(s, sf):
    keys = t(s, sf, "lineitem").where("l_linenumber = 1").select((F.col("l_orderkey") * 3 + 1).alias("key"))
    return layout.interval_lookup(keys, segments(s, sf).withColumnRenamed("base_key", "lower"), "segment_id")


@query("asof_segment_lookup_all", f"SELECT k.key, coalesce(g.segment_id, 0) AS segment_id FROM (SELECT l_orderkey * 3 + 1 AS key FROM lineitem) k ASOF LEFT JOIN ({SEG_SQL}) g ON k.key >= g.base_key")
def _(s, sf):
    keys = t(s, sf, "lineitem").select((F.col("l_orderkey") * 3 + 1).alias("key"))
    return layout.interval_lookup(keys, segments(s, sf).withColumnRenamed("base_key", "lower"), "segment_id")


@query("next_segment", f"SELECT min(base_key) AS base_key FROM ({SEG_SQL}) WHERE base_key > 1000")
def _(s, sf):
    return segments(s, sf).where("base_key > 1000").agg(F.min("base_key").alias("base_key"))


@query("overflow_islands", f"WITH g AS (SELECT *, row_number() OVER (ORDER BY base_key) AS pos FROM ({SEG_SQL})), f AS (SELECT *, pos - row_number() OVER (ORDER BY base_key) AS island FROM g WHERE has_overflow) SELECT island, min(base_key) AS first_base, max(base_key) AS last_base, count(*) AS n FROM f GROUP BY island")
def _(s, sf):
    return layout.overflow_islands(segments(s, sf).select("base_key", "has_overflow"))


@query("rewrite_region", f"SELECT base_key, has_overflow FROM ({SEG_SQL}) WHERE segment_id BETWEEN 4 AND 5")
def _(s, sf):
    # segment 4 with its neighbours 3 (no overflow: out) and 5, then 6 (out)
    return layout.rewrite_region(segments(s, sf).select("base_key", "has_overflow"), 4 * 44 + 1, 3)


@query("chain_length", f"SELECT key // 20 AS page, 1 + (count(*) - 1) // 15 AS chain_len FROM (SELECT DISTINCT key FROM ({LOG_SQL})) GROUP BY key // 20 HAVING 1 + (count(*) - 1) // 15 >= 2")
def _(s, sf):
    keys = log(s, sf).select("key").distinct()
    chains = keys.groupBy(F.floor(F.col("key") / 20).alias("page")).agg((1 + F.floor((F.count("*") - 1) / 15)).alias("chain_len"))
    return chains.where("chain_len >= 2")


@query("reorg_candidates", f"SELECT key // 10 AS segment_id, count(*) AS n FROM ({LOG_SQL}) GROUP BY key // 10 HAVING count(*) > 2 * 5 * 4")
def _(s, sf):
    return log(s, sf).groupBy(F.floor(F.col("key") / 10).alias("segment_id")).agg(F.count("*").alias("n")).where("n > 2 * 5 * 4")


@query("reorg_chain_pack", f"SELECT key, value, (row_number() OVER (ORDER BY key) - 1) // 50 AS page FROM ({VIEW_SQL}) WHERE key < 400")
def _(s, sf):
    _, rpp = layout.repack_fill(399, 8, 50, 4096, 8, 64)
    return layout.pages_fixed_pack(view(s, sf).where("key < 400"), rpp)


@query("flatten_chain", f"SELECT key, value, (row_number() OVER (ORDER BY key) - 1) // 44 AS page FROM ({VIEW_SQL}) WHERE key < 300")
def _(s, sf):
    return layout.pages_fixed_pack(view(s, sf).where("key < 300"), 44)


CHAIN_SQL = "SELECT key // {0} AS chain, key, value, row_number() OVER (PARTITION BY key // {0} ORDER BY key) - 1 AS rn, count(*) OVER (PARTITION BY key // {0}) AS n FROM (" + VIEW_SQL + ")"


@query(
    "reorg_every_chain",
    f"""WITH c AS ({CHAIN_SQL.format(400)}), f AS (SELECT greatest(1, CAST(floor(CAST(range AS DOUBLE) / 100 * ((4096 - 2 * 8) / 70.0::DOUBLE)) AS BIGINT)) AS per FROM range(50, 101)),
p AS (SELECT n, coalesce(min(per) FILTER (ceil(n / per::DOUBLE) <= 8), max(per)) AS per FROM (SELECT DISTINCT n FROM c), f GROUP BY n)
SELECT chain, key, value, rn // per AS page FROM c JOIN p USING (n)""",
)
def _(s, sf):
    return layout.repack_chains(view(s, sf), 400, 8, 50, 4096, 8, 64)


@query("flatten_every_chain", f"SELECT chain, key, value, rn // 44 AS page FROM ({CHAIN_SQL.format(300)})")
def _(s, sf):
    return layout.flatten_chains(view(s, sf), 300, 44)


LEARNED_SQL = "SELECT DISTINCT CAST(floor(c_custkey * c_custkey / 8.0::DOUBLE + c_custkey + 1) AS BIGINT) AS key FROM customer"


def learned_keys(s, sf):
    # squares leave gaps that grow, so that lines end
    return t(s, sf, "customer").select((F.col("c_custkey") * F.col("c_custkey") / 8 + F.col("c_custkey") + 1).cast("long").alias("key")).distinct()


def learned(s, sf):
    return layout.build_pages(learned_keys(s, sf), 44, 5, shards=4)


@query("page_assignment", f"SELECT CAST(0 AS BIGINT) AS misplaced, count(*) AS n FROM ({LEARNED_SQL})")
def _(s, sf):
    pages = checkpointed(learned(s, sf))
    held = layout.page_assignment(learned_keys(s, sf), pages).groupBy("lower").agg(F.count("*").alias("n"))
    both = pages.where("n_records > 0").select("lower", "n_records").join(held, "lower", "full")
    return both.agg(F.count(F.when(~F.col("n").eqNullSafe(F.col("n_records")), 1)).alias("misplaced"), F.sum("n").alias("n"))


@query("batch_by_segment", f"SELECT segment_id, count(*) AS n, min(k) AS first_key, max(k) AS last_key FROM (SELECT k, coalesce(g.segment_id, 0) AS segment_id FROM (SELECT DISTINCT l_orderkey * 3 + 1 AS k FROM lineitem) b ASOF LEFT JOIN ({SEG_SQL}) g ON b.k >= g.base_key) GROUP BY segment_id")
def _(s, sf):
    batch = t(s, sf, "lineitem").select((F.col("l_orderkey") * 3 + 1).alias("key")).distinct()
    return layout.batch_by_segment(batch, segments(s, sf))


SCAN_SQL = "SELECT event_id, (user_id % 170) / 10.0::DOUBLE AS pos, event_id % 500 + 1 AS amount, CAST(1 << (event_id % 5) AS BIGINT) AS pages FROM events"


@query(
    "scan_page_estimate",
    f"""SELECT event_id, CASE WHEN pages <= 1 OR floor(pos) >= pages OR amount - here <= 0 THEN 1
    ELSE 1 + least(CAST(ceil((amount - here) / 44.0::DOUBLE) AS BIGINT), pages - CAST(floor(pos) AS BIGINT) - 1) END AS pages,
    2 + CAST(ceil(amount / 44.0::DOUBLE) AS BIGINT) AS prefetched
FROM (SELECT *, CAST(trunc(44 - (pos - floor(pos)) * 44) AS BIGINT) AS here FROM ({SCAN_SQL}))""",
)
def _(s, sf):
    e = t(s, sf, "events").select("event_id", (F.pmod("user_id", F.lit(170)) / 10.0).alias("pos"), (F.pmod("event_id", F.lit(500)) + 1).alias("amount"), F.expr("shiftleft(1L, cast(event_id % 5 as int))").alias("pages"))
    return e.select("event_id", layout.scan_page_estimate(F.col("pos"), F.col("amount"), F.col("pages"), 44).alias("pages"), layout.prefetch_pages(F.col("amount"), 44).alias("prefetched"))


@query("segments_build")
def _(s, sf):
    return layout.segments_of(learned(s, sf))


@query("page_bounds")
def _(s, sf):
    return learned(s, sf).select("lower", "upper", "page_idx", "n_records")


@query("layout_check", f"SELECT CAST(0 AS BIGINT) AS pages_over, CAST(0 AS BIGINT) AS pages_under, CAST(0 AS BIGINT) AS segments_over, count(*) AS n_records FROM ({LEARNED_SQL})")
def _(s, sf):
    return layout.layout_check(learned(s, sf), 44, 5)


@query("segment_summary")
def _(s, sf):
    return layout.segment_summary(layout.segments_of(learned(s, sf)))


def _points(s, sf):
    # result tables are small; the fit is sequential by nature
    return number_rows(orders(s, sf).select((F.col("key") * 7 + F.pmod("key", F.lit(13)) * 3).alias("x")), "x", "y").select("x", F.col("y").cast("double").alias("y"))


for _method in ("greedy", "optimal"):
    query(f"plr_{_method}")(lambda s, sf, m=_method: layout.plr_runs(_points(s, sf), 10.0, m))


POINTS_SQL = "SELECT DISTINCT (o_orderkey + 1) * 7 + (o_orderkey + 1) * (o_orderkey + 1) // 500 AS x FROM orders"


def _bent_points(s, sf):
    """Points on a curve, which no one line holds."""
    k = F.col("key")
    return number_rows(orders(s, sf).select((k * 7 + F.floor(k * k / 500)).alias("x")).distinct(), "x", "y").select("x", F.col("y").cast("double").alias("y"))


for _method in ("greedy", "optimal"):

    @query(f"plr_{_method}_bound", f"SELECT count(*) AS n, true AS several, true AS within FROM ({POINTS_SQL})")
    def _(s, sf, m=_method):
        runs = layout.plr_runs(_bent_points(s, sf), 10.0, m)
        return runs.agg(F.sum("n").alias("n"), (F.count("*") > 1).alias("several"), (F.max("worst") <= 10.0 + 1e-6).alias("within"))


# --- forecast --------------------------------------------------------------------------------

INS_SQL = "SELECT event_id AS seq, user_id + 1 AS key FROM events"
HIST_SQL = f"""WITH i AS ({INS_SQL}), o AS (SELECT key, row_number() OVER (ORDER BY key, seq) - 1 AS i FROM i WHERE seq < 100),
b AS (SELECT CAST(i // 10 AS INTEGER) AS part, key AS lower, lead(key, 1, 9223372036854775807) OVER (ORDER BY i) AS upper FROM o WHERE i % 10 = 0)
SELECT part, lower, upper, count(e.key) AS cnt FROM b LEFT JOIN (SELECT key FROM i WHERE seq >= 100 AND seq < 900) e ON e.key >= lower AND e.key < upper GROUP BY part, lower, upper"""


def inserts(s, sf):
    return t(s, sf, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") + 1).alias("key"))


@query("insert_epochs", f"SELECT CASE WHEN seq < 100 THEN -1 ELSE (seq - 100) // 300 END AS epoch, count(*) AS n FROM ({INS_SQL}) GROUP BY 1")
def _(s, sf):
    return forecast.insert_epochs(inserts(s, sf), 100, 300).groupBy("epoch").agg(F.count("*").alias("n"))


@query("hist_equi_depth", HIST_SQL)
def _(s, sf):
    return forecast.equi_depth(inserts(s, sf), 100, 10, 800)


@query("hist_overlap", f"SELECT round(sum(cnt * greatest(0, least(upper, 90) - greatest(lower, 20)) / (upper - lower)) * 2.0, 6) AS expected FROM ({HIST_SQL})")
def _(s, sf):
    return forecast.overlap_forecast(forecast.equi_depth(inserts(s, sf), 100, 10, 800), 20, 90, 2.0).select(F.round("expected", 6).alias("expected"))


EPOCHS_SQL = f"""WITH i AS ({INS_SQL}), e AS (SELECT (seq - 100) // 800 AS epoch, count(*) AS inserts FROM i WHERE seq >= 100 GROUP BY 1),
p AS (SELECT epoch, inserts, seq, key FROM e JOIN i ON seq < 100 + 800 * epoch QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY md5(CAST(seq AS VARCHAR)), seq) <= 100),
o AS (SELECT epoch, inserts, key, row_number() OVER (PARTITION BY epoch ORDER BY key, seq) - 1 AS i FROM p),
b AS (SELECT epoch, inserts, CAST(i // 10 AS INTEGER) AS part, key AS lower, lead(key, 1, 9223372036854775807) OVER (PARTITION BY epoch ORDER BY i) AS upper FROM o WHERE i % 10 = 0)
SELECT b.epoch, inserts, part, lower, upper, count(k.key) AS cnt FROM b LEFT JOIN (SELECT (seq - 100) // 800 AS epoch, key FROM i WHERE seq >= 100) k ON k.epoch = b.epoch AND k.key >= lower AND k.key < upper GROUP BY b.epoch, inserts, part, lower, upper"""


@query("hist_every_epoch", EPOCHS_SQL)
def _(s, sf):
    return forecast.equi_depth_epochs(inserts(s, sf), 100, 10, 800)


@query("hist_last_overlap", f"SELECT round(sum(cnt * greatest(0, least(upper, 90) - greatest(lower, 20)) / (upper - lower)) * 2.0, 6) AS expected FROM (SELECT * FROM ({EPOCHS_SQL}) WHERE inserts >= 800 QUALIFY epoch = max(epoch) OVER ()) WHERE upper > lower")
def _(s, sf):
    last = forecast.last_completed(forecast.equi_depth_epochs(inserts(s, sf), 100, 10, 800), 800)
    return forecast.overlap_forecast(last, 20, 90, 2.0).select(F.round("expected", 6).alias("expected"))


@query("future_goal", "SELECT greatest(CAST(10 AS BIGINT), greatest(CAST(1 AS BIGINT), CAST(floor(44.0::DOUBLE * 216 / (216 + count(*) / 100.0::DOUBLE)) AS BIGINT))) AS goal FROM events")
def _(s, sf):
    n = t(s, sf, "events").agg((F.count("*") / 100.0).alias("f"))
    return n.select(forecast.future_goal(44, 5, F.lit(4), F.col("f")).alias("goal"))


@query("future_goal_by_island", f"""WITH n AS (SELECT segment_id // 16 AS region, count(*) AS pages, sum(n_records) AS inserts FROM ({SEG_SQL}) GROUP BY 1)
SELECT region, greatest(CAST(10 AS BIGINT), CAST(floor(44 * (pages * 54 * 1.5::DOUBLE) / (pages * 54 * 1.5::DOUBLE + inserts)) AS BIGINT)) AS goal FROM n""")
def _(s, sf):
    n = segments(s, sf).groupBy(F.floor(F.col("segment_id") / 16).alias("region")).agg(F.count("*").alias("pages"), F.sum("n_records").alias("inserts"))
    return n.select("region", forecast.future_goal(44, 5, F.col("pages"), F.col("inserts"), 1.5).alias("goal"))


@query("throughput_samples", "SELECT event_id // 250 AS sample, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(s, sf):
    return t(s, sf, "events").groupBy(F.floor(F.col("event_id") / 250).alias("sample")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("deferral_sim", f"SELECT seq // 100 AS flush_no, key // 20 AS page, count(*) AS n FROM ({LOG_SQL}) GROUP BY 1, 2")
def _(s, sf):
    return log(s, sf).groupBy(F.floor(F.col("seq") / 100).alias("flush_no"), F.floor(F.col("key") / 20).alias("page")).agg(F.count("*").alias("n"))


@query(
    "deferral_carry_over",
    f"""WITH RECURSIVE w AS (SELECT key // 20 AS page, seq // 100 AS f, count(*) AS n FROM ({LOG_SQL}) GROUP BY 1, 2),
last AS (SELECT (max(seq) + 1) // 100 AS flushes FROM ({LOG_SQL})),
run(page, f, pending, passed, ios) AS (
    SELECT DISTINCT page, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM w
    UNION ALL
    SELECT page, f, CASE WHEN out THEN 0 ELSE held END, CASE WHEN out THEN 0 ELSE passed + 1 END, ios + CASE WHEN out THEN 1 ELSE 0 END
    FROM (SELECT r.page, r.f + 1 AS f, r.pending + coalesce(w.n, 0) AS held, r.passed, r.ios,
            r.pending + coalesce(w.n, 0) > 0 AND (r.pending + coalesce(w.n, 0) >= 15 OR r.passed >= 3) AS out
        FROM run r LEFT JOIN w ON w.page = r.page AND w.f = r.f + 1 WHERE r.f + 1 < (SELECT flushes FROM last))
)
SELECT r.page, (SELECT CAST(sum(n) AS BIGINT) FROM w WHERE w.page = r.page) AS writes, r.ios,
    CAST(r.pending + coalesce((SELECT sum(n) FROM w WHERE w.page = r.page AND w.f >= (SELECT flushes FROM last)), 0) AS BIGINT) AS pending
FROM run r WHERE r.f = (SELECT flushes FROM last) - 1""",
)
def _(s, sf):
    writes = log(s, sf).select("seq", F.floor(F.col("key") / 20).alias("page"))
    return forecast.deferral_carry_over(writes, 100, 15, 3)


# --- checks ----------------------------------------------------------------------------------


@query("fsck_ranges", "SELECT segment_id, lower, upper FROM (SELECT *, max(upper) OVER (ORDER BY lower, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT p_partkey AS segment_id, p_partkey * 10 AS lower, p_partkey * 10 + p_size AS upper FROM part)) WHERE lower >= upper OR b > lower")
def _(s, sf):
    p = t(s, sf, "part").select(F.col("p_partkey").alias("segment_id"), (F.col("p_partkey") * 10).alias("lower"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("upper"))
    return fsck.range_violations(p)


@query("fsck_dangling", "WITH r AS (SELECT o_custkey AS k FROM orders), g AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 <> 0) SELECT DISTINCT k, 'missing' AS problem FROM r WHERE k NOT IN (SELECT k FROM g) UNION ALL SELECT k, 'several' FROM r GROUP BY k HAVING count(*) > 1 UNION ALL SELECT k, 'unused' FROM g WHERE k NOT IN (SELECT k FROM r)")
def _(s, sf):
    return fsck.dangling(t(s, sf, "orders").select(F.col("o_custkey").alias("k")), t(s, sf, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k")), "k")


@query("fsck_scan", f"SELECT count(*) AS n FROM (SELECT key, lag(key) OVER (ORDER BY key) AS b FROM ({VIEW_SQL})) WHERE b >= key")
def _(s, sf):
    return view(s, sf).groupBy("key").agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n"))


@query("fsck_pages", f"SELECT page, key FROM ({PACK_SQL}) WHERE key IS NULL")
def _(s, sf):
    rows = packed(s, sf)
    return fsck.page_violations(rows, layout.page_summary(rows))


@query("fsck_shifted_pages", f"SELECT page, key FROM ({PACK_SQL}) JOIN (SELECT page, min(key) + page % 3 AS lower FROM ({PACK_SQL}) GROUP BY page) USING (page) WHERE key < lower")
def _(s, sf):
    rows = packed(s, sf)
    return fsck.page_violations(rows, layout.page_summary(rows).withColumn("lower", F.col("lower") + F.col("page") % 3))


@query("fsck_contiguous", f"WITH p AS (SELECT page, min(key) AS lower, max(key) + 1 + page % 2 AS upper FROM ({PACK_SQL}) GROUP BY page) SELECT page, upper, next_lower FROM (SELECT *, lead(lower) OVER (ORDER BY page) AS next_lower FROM p) WHERE upper <> next_lower")
def _(s, sf):
    pages = layout.page_summary(packed(s, sf)).withColumn("upper", F.col("last") + 1 + F.col("page") % 2)
    return fsck.contiguity_violations(pages)


@query("fsck_unmerged_scan", f"SELECT key, count(*) AS n FROM (SELECT key FROM ({BASE_SQL}) UNION ALL SELECT s_suppkey + 1 FROM supplier UNION ALL SELECT key FROM ({LATEST_SQL}) WHERE op = 'W') GROUP BY key HAVING count(*) > 1")
def _(s, sf):
    rows = base(s, sf).select("key").unionAll(t(s, sf, "supplier").select(F.col("s_suppkey") + 1)).unionAll(merge.latest_per_key(log(s, sf)).where("op = 'W'").select("key"))
    return fsck.scan_violations(rows)


# --- datasets --------------------------------------------------------------------------------


@query("gen_linspace", "SELECT range AS key FROM range(1024, 1024 + 1000 * 8, 8)")
def _(s, sf):
    return s.range(1024, 1024 + 1000 * 8, 8).select(F.col("id").alias("key"))


@query("load_keys_dedup", "SELECT DISTINCT l_orderkey + 1 AS key FROM lineitem")
def _(s, sf):
    return t(s, sf, "lineitem").select((F.col("l_orderkey") + 1).alias("key")).distinct()


@query("dedup_keep_first", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def _(s, sf):
    return t(s, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("composite_key", "SELECT (user_id << 48) | event_id AS key, user_id AS high, event_id AS low FROM events")
def _(s, sf):
    rows = t(s, sf, "events").select(composite_key(F.col("user_id"), F.col("event_id")).alias("key"))
    high, low = split_key(F.col("key"))
    return rows.select("key", high.alias("high"), low.alias("low"))


@query("key_bytes", "SELECT o_orderkey AS key, lpad(hex(o_orderkey), 16, '0') AS hex FROM orders WHERE o_orderkey > 0")
def _(s, sf):
    return t(s, sf, "orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("key"), F.hex(key_bytes(F.col("o_orderkey"))).alias("hex"))


@query("json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(s, sf):
    return t(s, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("split_dims", "SELECT p_partkey, split_part(p_type, ' ', 1) AS a, upper(split_part(p_type, ' ', 2)) AS b FROM part")
def _(s, sf):
    return t(s, sf, "part").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("a"), F.upper(F.split_part("p_type", F.lit(" "), F.lit(2))).alias("b"))


@query("reservoir_sample")
def _(s, sf):
    return orders(s, sf).orderBy(F.xxhash64("key", F.lit(42)), "key").limit(100)


# --- persisted store, workloads, streams -------------------------------------------------------


def new_folder(s: SparkSession) -> str:
    return f"{shared.shared_folder(s)}/store-{uuid.uuid4().hex}"


@query("kv_store_reopen", VIEW_SQL)
def _(s, sf):
    store = KVStore.open(s, new_folder(s))
    store.bulk_load(base(s, sf))
    store.write(log(s, sf).where("seq < 400"))
    store.flush()
    store.write(log(s, sf).where("seq >= 400"))
    return KVStore.open(s, store.path).view()


BYTES_SQL = """SELECT key, value FROM (SELECT 'k' || c_custkey AS key, c_acctbal AS value FROM customer) WHERE key NOT IN (SELECT 'k' || (s_suppkey * 3) FROM supplier) AND key NOT IN (SELECT 'k' || (n_nationkey * 7 + 1) FROM nation)
UNION ALL SELECT 'k' || (s_suppkey * 3), s_acctbal FROM supplier WHERE 'k' || (s_suppkey * 3) NOT IN (SELECT 'k' || (n_nationkey * 7 + 1) FROM nation)"""


def bytes_store(s, sf):
    """A store of byte-string keys: loaded, updated and thinned out, then opened again."""
    key = lambda c: F.concat(F.lit("k"), c.cast("string")).cast("binary").alias("key")
    store = KVStore.open(s, new_folder(s))
    store.bulk_load(t(s, sf, "customer").select(key(F.col("c_custkey")), F.col("c_acctbal").alias("value")))
    store.put(t(s, sf, "supplier").select(key(F.col("s_suppkey") * 3), F.col("s_acctbal").alias("value")))
    store.delete(t(s, sf, "nation").select(key(F.col("n_nationkey") * 7 + 1)))
    return KVStore.open(s, store.path)


@query("kv_bytes_scan", f"SELECT key, value FROM ({BYTES_SQL}) WHERE key >= 'k1' ORDER BY key LIMIT 100")
def _(s, sf):
    return bytes_store(s, sf).scan(b"k1", 100).select(F.col("key").cast("string").alias("key"), "value")


@query("kv_bytes_get", f"SELECT key, value FROM ({BYTES_SQL}) WHERE key IN ('k9', 'k8', 'k77')")
def _(s, sf):
    asked = s.createDataFrame([(b"k9",), (b"k8",), (b"k77",), (b"absent",)], "key binary")
    return bytes_store(s, sf).multi_get(asked).where("value is not null").select(F.col("key").cast("string").alias("key"), "value")


@query("common_prefix", "SELECT p_partkey, CASE WHEN p_name = p_brand THEN p_name ELSE left(p_name, CAST(list_max(list_filter(range(0, least(length(p_name), length(p_brand)) + 1), lambda n: left(p_name, n) = left(p_brand, n))) AS INTEGER)) END AS prefix FROM part")
def _(s, sf):
    return t(s, sf, "part").select("p_partkey", common_prefix(F.col("p_name"), F.col("p_brand")).alias("prefix"))


@query("shuffle_seeded", "SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-7'), o_orderkey) AS rn FROM orders")
def _(s, sf):
    o = t(s, sf, "orders").select("o_orderkey", F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit("-7"))).alias("h"))
    return number_rows(o.withColumn("place", F.struct("h", "o_orderkey")), "place").select("o_orderkey", "rn")


@query("reservoir_md5", f"SELECT key, value FROM ({ORDERS_SQL}) ORDER BY md5(CAST(key AS VARCHAR)), key LIMIT 100")
def _(s, sf):
    return orders(s, sf).orderBy(F.md5(F.col("key").cast("string")), "key").limit(100)


@query("wal_stream_replay", VIEW_SQL)
def _(s, sf):
    folder = new_folder(s)
    log(s, sf).write.parquet(f"{folder}/in")
    store = KVStore.open(s, f"{folder}/kv")
    store.bulk_load(base(s, sf))
    log_stream.apply_to_store(log_stream.read_log(s, f"{folder}/in"), store, f"{folder}/checkpoint").awaitTermination()
    return store.view()


def _ycsb(s, name):
    rank = workloads.latest_rank if name == "d" else workloads.hotspot_rank if name == "hot_middle" else workloads.zipf_rank
    return workloads.requests(s, [workloads.Phase(workloads.MIXES[name], 10_000, rank)], 20_000)


for _name in workloads.MIXES:
    query(f"ycsb_{_name}" if len(_name) == 1 else _name)(lambda s, sf, m=_name: _ycsb(s, m))


@query("phased_workload")
def _(s, sf):
    phases = [workloads.Phase(workloads.MIXES["ab"[i % 2]], 2_000) for i in range(5)]
    return workloads.requests(s, phases, 20_000)


@query("gen_zipf")
def _(s, sf):
    return s.range(100_000).select("id", workloads.zipf_rank(workloads.unit(F.col("id"), 7), 1000).alias("rank"))


@query("workload_run")
def _(s, sf):
    rows = workloads.linspace_keys(s, 20_000, step=2).withColumn("value", F.lit(0).cast("long"))
    return workloads.run_phase(rows, _ycsb(s, "f"), F.col("seq") + 1)[1]


# --- analytics -------------------------------------------------------------------------------


@query("join_inner_3way", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _(s, sf):
    c, n = t(s, sf, "customer"), t(s, sf, "nation")
    return t(s, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("join_left_speedup", "SELECT a.k, a.v, b.v AS v_before, a.v / b.v AS ratio FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer) a LEFT JOIN (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier) b ON a.k = b.k")
def _(s, sf):
    return analytics.compare_left(t(s, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), t(s, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")), "k", "v")


@query("join_full_outer", "SELECT coalesce(o_custkey, c_custkey) AS k, n, c_name FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) FULL JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def _(s, sf):
    o = t(s, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return o.join(t(s, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), "c_name"), "k", "full_outer")


@query("join_full_outer_all", "SELECT coalesce(o.k, s.k) AS k, n, c_name, s_name FROM (SELECT coalesce(o_custkey, c_custkey) AS k, n, c_name FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) FULL JOIN customer ON o_custkey = c_custkey) o FULL JOIN (SELECT s_suppkey AS k, s_name FROM supplier) s ON o.k = s.k")
def _(s, sf):
    # suppliers, customers and ordering customers have keys that differ by themselves
    o = t(s, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    both = o.join(t(s, sf, "customer").select(F.col("c_custkey").alias("k"), "c_name"), "k", "full_outer")
    return both.join(t(s, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_name"), "k", "full_outer")


@query("pivot_by_category", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def _(s, sf):
    p = t(s, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return p.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("agg_sum_median", "SELECT l_returnflag, round(sum(l_quantity), 2) AS total, median(l_extendedprice) AS med FROM lineitem GROUP BY 1")
def _(s, sf):
    return t(s, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("total"), F.median("l_extendedprice").alias("med"))


@query("agg_geomean", "SELECT l_returnflag, round(exp(avg(ln(l_extendedprice))), 4) AS g FROM lineitem GROUP BY 1")
def _(s, sf):
    return t(s, sf, "lineitem").groupBy("l_returnflag").agg(F.round(analytics.geomean(F.col("l_extendedprice")), 4).alias("g"))


@query("agg_minmax", "SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1")
def _(s, sf):
    return t(s, sf, "orders").groupBy("o_orderstatus").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@query("rowwise_greatest", "SELECT l_orderkey, l_linenumber, greatest(l_quantity, l_tax * 1000) AS g FROM lineitem")
def _(s, sf):
    return t(s, sf, "lineitem").select("l_orderkey", "l_linenumber", F.greatest("l_quantity", F.col("l_tax") * 1000).alias("g"))


@query("agg_distinct", "SELECT DISTINCT p_brand FROM part")
def _(s, sf):
    return t(s, sf, "part").select("p_brand").distinct()


@query("counters_pivot", "SELECT count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type IN ('click', 'error')) AS both FROM events")
def _(s, sf):
    n = lambda *x: F.count(F.when(F.col("event_type").isin(*x), 1))
    return t(s, sf, "events").agg(n("click").alias("click"), n("error").alias("error"), n("click", "error").alias("both"))


@query("counters", "SELECT event_type AS name, count(*) AS value FROM events GROUP BY 1")
def _(s, sf):
    return t(s, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("value"))


@query("ratio_of_sums", "SELECT round(sum(l_extendedprice * l_discount) FILTER (l_returnflag = 'R') / sum(l_extendedprice), 8) AS ratio FROM lineitem")
def _(s, sf):
    part = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice") * F.col("l_discount")))
    return t(s, sf, "lineitem").agg(F.round(part / F.sum("l_extendedprice"), 8).alias("ratio"))


@query("share_of_total", "SELECT l_returnflag, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (), 8) AS share FROM lineitem GROUP BY 1")
def _(s, sf):
    return analytics.share_of_total(t(s, sf, "lineitem"), "l_returnflag", "l_quantity").select("l_returnflag", F.round("share", 8).alias("share"))


@query("win_ratio_prev", "SELECT n_nationkey, n, n / lag(n) OVER (ORDER BY n_nationkey) AS ratio FROM (SELECT c_nationkey AS n_nationkey, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1)")
def _(s, sf):
    n = t(s, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").cast("double").alias("n"))
    return analytics.ratio_to_previous(n, "n_nationkey", "n")


@query("win_cdf", f"SELECT key, (row_number() OVER (ORDER BY key) - 1) / (count(*) OVER () - 1) AS pos, key / max(key) OVER () AS rel FROM ({ORDERS_SQL})")
def _(s, sf):
    rows = number_rows(orders(s, sf), "key")
    top = rows.agg(F.count("*").alias("n"), F.max("key").alias("hi"))  # one row
    return rows.join(F.broadcast(top)).select("key", ((F.col("rn") - 1) / (F.col("n") - 1)).alias("pos"), (F.col("key") / F.col("hi")).alias("rel"))


@query("sort_by_key", f"SELECT key, value FROM ({ORDERS_SQL})")
def _(s, sf):
    return orders(s, sf).orderBy("key")


@query("sort_multi", "SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier")
def _(s, sf):
    return t(s, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal").orderBy("s_nationkey", F.desc("s_acctbal"), "s_suppkey")


@query("union_all", "SELECT 'c' AS kind, c_acctbal AS bal FROM customer UNION ALL SELECT 's', s_acctbal FROM supplier")
def _(s, sf):
    c = t(s, sf, "customer").select(F.lit("c").alias("kind"), F.col("c_acctbal").alias("bal"))
    return c.unionByName(t(s, sf, "supplier").select(F.lit("s").alias("kind"), F.col("s_acctbal").alias("bal")))


@query("summarize_union", "SELECT kind, count(*) AS n, round(avg(bal), 4) AS mean FROM (SELECT 'c' AS kind, c_acctbal AS bal FROM customer UNION ALL SELECT 's', s_acctbal FROM supplier) GROUP BY 1")
def _(s, sf):
    return QUERIES["union_all"](s, sf).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("bal"), 4).alias("mean"))


@query("case_label", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity / 25 < .95 THEN 'red' WHEN l_quantity / 25 > 1.05 THEN 'green' ELSE 'black' END AS color FROM lineitem")
def _(s, sf):
    return t(s, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", analytics.label_change(F.col("l_quantity") / 25).alias("color"))


CHANGE_SQL = "SELECT o_orderpriority AS k, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS v_before, round(sum(o_totalprice) FILTER (o_orderstatus <> 'F'), 2) AS v FROM orders GROUP BY 1"


def _change(s, sf):
    done = F.col("o_orderstatus") == "F"
    total = lambda c: F.round(F.sum(F.when(c, F.col("o_totalprice"))), 2)
    return t(s, sf, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(total(done).alias("v_before"), total(~done).alias("v"))


@query("change_over_prev", f"SELECT k, round(v / v_before, 6) AS ratio FROM ({CHANGE_SQL})")
def _(s, sf):
    return _change(s, sf).select("k", F.round(F.col("v") / F.col("v_before"), 6).alias("ratio"))


@query("speedup_geomean", f"SELECT round(exp(avg(ln(v / v_before))), 6) AS g, round(min(v / v_before), 6) AS lo, round(max(v / v_before), 6) AS hi FROM ({CHANGE_SQL})")
def _(s, sf):
    r = F.col("v") / F.col("v_before")
    return _change(s, sf).agg(F.round(analytics.geomean(r), 6).alias("g"), F.round(F.min(r), 6).alias("lo"), F.round(F.max(r), 6).alias("hi"))


@query("gap_closed", f"SELECT k, round((v - v_before) / (2 * v - v_before), 6) AS closed FROM ({CHANGE_SQL})")
def _(s, sf):
    return _change(s, sf).select("k", F.round(analytics.gap_closed(F.col("v_before"), F.col("v"), 2 * F.col("v")), 6).alias("closed"))


@query("rel_throughput", f"SELECT k, round(v / max(v) OVER (), 6) AS rel FROM ({CHANGE_SQL})")
def _(s, sf):
    return _change(s, sf).select("k", F.round(F.col("v") / F.max("v").over(Window.partitionBy()), 6).alias("rel"))
