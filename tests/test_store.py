import bisect
import collections
import hashlib
import importlib
import random

import pytest

from keystrand.errors import InvalidArgument
from keystrand.functions.plr import build_segments, fit_runs, page_lower_bounds
from keystrand.operators import forecast, layout, lookup, merge
from keystrand.operators.numbering import number_rows

KV = "key long, value string"
LOG = "seq long, op string, key long, value string"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_scan_merges_before_it_limits(spark):
    base = spark.createDataFrame([(k, "old") for k in range(10, 200, 10)], KV)
    log = spark.createDataFrame([(1, "W", 20, "new"), (2, "D", 10, None), (3, "W", 15, "a"), (4, "W", 15, "b"), (5, "D", 30, None), (6, "W", 35, "")], LOG)
    view = merge.merge_view(base, log)
    assert rows(lookup.range_scan(view, 1, 4)) == [(15, "b"), (20, "new"), (35, ""), (40, "old")]
    assert rows(lookup.get(view, 10)) == [] and rows(lookup.get(view, 0)) == []
    with pytest.raises(InvalidArgument):
        lookup.range_scan(view, 0, 5)


def test_random_writes_against_a_dict(spark):
    rng, model, log = random.Random(3), {}, []
    base = [(k, "b") for k in range(1, 60, 3)]
    model.update(base)
    for seq in range(300):
        k = rng.randint(1, 60)
        if rng.random() < 0.4:
            log.append((seq, "D", k, None))
            model.pop(k, None)
        else:
            log.append((seq, "W", k, f"v{seq}"))
            model[k] = f"v{seq}"
    rng.shuffle(log)
    view = merge.merge_view(spark.createDataFrame(base, KV), spark.createDataFrame(log, LOG))
    assert rows(view.orderBy("key")) == sorted(model.items())


def test_tracker_small_numbers(spark):
    inserts = spark.createDataFrame([(i, i % 10) for i in range(100)], "seq long, key long")
    hist = forecast.equi_depth(inserts, 10, 2, 90)
    ask = lambda a, b: forecast.overlap_forecast(hist, a, b).first()[0]
    assert ask(0, 5) == 45 and ask(0, 4) == 36 and ask(0, 1) == 9
    assert [r["cnt"] for r in hist.orderBy("part").collect()] == [45, 45]


def test_tracker_counts_every_epoch(spark):
    rng = random.Random(3)
    data = [(i, rng.randrange(100) + (1000 if i >= 600 else 0)) for i in range(1000)]
    hist = forecast.equi_depth_epochs(spark.createDataFrame(data, "seq long, key long"), 20, 4, 90)
    expected = []
    for e in range(11):
        start = 20 + 90 * e
        least = sorted((hashlib.md5(str(i).encode()).hexdigest(), k) for i, k in data[:start])[:20]
        lower = sorted(k for _, k in least)[::5]
        new = [k for _, k in data[start : start + 90]]
        expected += [(e, len(new), p, lo, up, sum(lo <= k < up for k in new)) for p, (lo, up) in enumerate(zip(lower, [*lower[1:], 2**63 - 1], strict=True))]
    assert sorted(rows(hist)) == expected
    last = forecast.last_completed(hist, 90)
    assert {r["epoch"] for r in last.collect()} == {9} and forecast.overlap_forecast(last, 0, 1000).first()[0] < 45
    assert rows(forecast.equi_depth_epochs(spark.createDataFrame(data[:19], "seq long, key long"), 20, 4, 90)) == []


def test_every_chain_is_packed_with_its_own_fill(spark):
    keys = [*range(1, 400), *range(400, 700), *range(1200, 1210)]
    view = spark.createDataFrame([(k, str(k)) for k in keys], KV)
    got = {(r["chain"], r["key"]): r["page"] for r in layout.repack_chains(view, 400, 8, 50, 4096, 8, 64).collect()}
    flat = {r["key"]: (r["chain"], r["page"]) for r in layout.flatten_chains(view, 300, 44).collect()}
    assert len(got) == len(flat) == len(keys)
    for chain in {k // 400 for k in keys}:
        own = [k for k in keys if k // 400 == chain]
        per = layout.repack_fill(len(own), 8, 50, 4096, 8, 64)[1]
        assert [got[chain, k] for k in own] == [i // per for i in range(len(own))]
    assert flat[299] == (0, 298 // 44) and flat[300] == (1, 0) and flat[1209] == (4, 0)


def test_whole_table_queries_leave_no_row_out(spark):
    entry, sf = importlib.import_module("__spark_entry__"), "/root/testdata/sf0.001"
    table = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    assert entry.queries()["asof_segment_lookup_all"](spark, sf).count() == table("lineitem").count()
    joined = entry.queries()["join_full_outer_all"](spark, sf)
    assert joined.where("c_name is not null").count() == table("customer").count()
    assert joined.agg({"n": "sum"}).first()[0] == table("orders").count()


@pytest.mark.parametrize("method", ["greedy", "optimal"])
def test_plr_error_bound(method):
    rng = random.Random(42)
    keys = sorted(rng.sample(range(1, 1_000_000), 1000))
    assert len(list(fit_runs([(float(i), float(i)) for i in range(1, 1001)], 10, method))) == 1
    runs = list(fit_runs([(float(k), float(i)) for i, k in enumerate(keys)], 10, method))
    assert sum(r.count for r in runs) == 1000 and max(r.worst for r in runs) <= 10 + 1e-6


@pytest.mark.parametrize(("goal", "eps"), [(44, 5), (15, 5)])
@pytest.mark.parametrize("method", ["greedy", "optimal"])
def test_segments_hold_every_key_once(goal, eps, method):
    rng = random.Random(42)
    for keys in (list(range(1, 1001)), sorted(rng.sample(range(1, 1_000_000), 1000))):
        segments = list(build_segments(keys, goal, eps, method))
        assert [k for s in segments for k in s.keys] == keys
        for s in segments[:-1]:
            assert (s.line is None) == (s.pages == 1)
            assert len(s.keys) <= s.pages * (goal + eps)
        for s in segments:
            lowers = page_lower_bounds(s, s.keys[-1] + 1)
            assert lowers == sorted(lowers)
            for low, high in zip(lowers, [*lowers[1:], s.keys[-1] + 1], strict=True):
                assert sum(low <= k < high for k in s.keys) <= goal + 2 * eps


def test_islands_and_lookup(spark):
    seg = spark.createDataFrame([(10, True), (20, True), (30, False), (40, True), (50, False)], "base_key long, has_overflow boolean")
    assert [tuple(r)[1:] for r in layout.overflow_islands(seg).orderBy("first_base").collect()] == [(10, 20, 2), (40, 40, 1)]
    intervals = spark.createDataFrame([(10, 0), (20, 1), (30, 2)], "lower long, segment_id long")
    keys = spark.createDataFrame([(k,) for k in (5, 10, 19, 20, 99)], "key long")
    assert dict(rows(layout.interval_lookup(keys, intervals, "segment_id"))) == {5: 0, 10: 0, 19: 0, 20: 1, 99: 2}


def test_row_numbers_and_lookups_over_many_ranges(spark):
    rng = random.Random(1)
    keys = rng.sample(range(1, 10**9), 3000)
    got = number_rows(spark.createDataFrame([(k,) for k in keys], "key long").repartition(9), "key").collect()
    assert {r["key"]: r["rn"] for r in got} == {k: i + 1 for i, k in enumerate(sorted(keys))}
    assert number_rows(spark.createDataFrame([], "key long"), "key").count() == 0
    starts = sorted(rng.sample(range(1, 10**9), 40))
    asked = [*keys, *[keys[0]] * 2000]  # one key holds two fifths of all rows
    found = layout.interval_lookup(spark.createDataFrame([(k,) for k in asked], "key long"), spark.createDataFrame(list(enumerate(starts)), "id long, lower long"), "id")
    expected = sorted((k, max(0, bisect.bisect_right(starts, k) - 1)) for k in asked)
    assert sorted(rows(found)) == expected


@pytest.mark.parametrize(("threshold", "deferrals"), [(3, 2), (4, 0), (100, 5), (1, 9)])
def test_deferred_flushes(spark, threshold, deferrals):
    rng = random.Random(7)
    writes = [(i, min(rng.randrange(9), rng.randrange(9))) for i in range(295)]
    ios, pending, passed = collections.Counter(), collections.Counter(), collections.Counter()
    pages = {p for _, p in writes}
    for i, p in writes:
        pending[p] += 1
        if (i + 1) % 10 == 0:
            for q in pages:
                if pending[q] and (pending[q] >= threshold or passed[q] >= deferrals):
                    ios[q] += 1
                    pending[q] = passed[q] = 0
                else:
                    passed[q] += 1
    got = forecast.deferral_carry_over(spark.createDataFrame(writes, "seq long, page long"), 10, threshold, deferrals)
    assert {r["page"]: (r["ios"], r["pending"]) for r in got.collect()} == {p: (ios[p], pending[p]) for p in pages}
