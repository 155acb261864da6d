import json
import random

import pytest
from pyspark.sql import functions as F

from keystrand.errors import Conflict, InvalidArgument, NotSupported
from keystrand.sources import files, workloads
from keystrand.sources.store import KVStore, StoreOptions
from keystrand.streaming import log_stream


def kv(spark, rows):
    return spark.createDataFrame(rows, "key long, value string")


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_store_reads_what_was_written_after_reopening(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path / "kv"))
    store.bulk_load(kv(spark, [(i * 10, "Test 1") for i in range(1, 1001)]))
    store.put(kv(spark, [(102, "Test 2"), (20, "Test 2"), (1001, "Test 2")]))
    again = KVStore.open(spark, store.path)
    for s in (store, again):
        assert (s.get(10), s.get(102), s.get(20), s.get(33), s.get(0)) == ("Test 1", "Test 2", "Test 2", None, None)
        found = pairs(s.scan(1, 2000))
        assert len(found) == 1002 and found == sorted(found)
    again.delete(spark.createDataFrame([(20,), (5,)], "key long"))
    again.flush()
    assert again.get(20) is None and again.log().count() == 0
    assert pairs(again.scan(95, 3)) == [(100, "Test 1"), (102, "Test 2"), (110, "Test 1")]
    assert again.vacuum() and pairs(KVStore.open(spark, store.path).scan(95, 1)) == [(100, "Test 1")]


def test_store_errors_come_in_order(spark, tmp_path):
    path = str(tmp_path / "kv")
    with pytest.raises(InvalidArgument):
        KVStore.open(spark, path, StoreOptions(fill_pct=0))
    with pytest.raises(InvalidArgument):
        KVStore.open(spark, path, StoreOptions(create_if_missing=False))
    store = KVStore.open(spark, path)
    assert store.get(1) is None and store.scan(0, 5).count() == 0
    with pytest.raises(NotSupported):
        store.put(kv(spark, [(0, "a")]))
    with pytest.raises(NotSupported):
        store.flatten(10, 1)
    for rows in ([], [(0, "a")], [(9, "a"), (9, "b")]):
        with pytest.raises(InvalidArgument):
            store.bulk_load(kv(spark, rows))
    unsorted = kv(spark, [(9, "1"), (10, "2"), (5, "3")])
    with pytest.raises(InvalidArgument):
        store.bulk_load(unsorted, order="value")
    store.bulk_load(unsorted)
    with pytest.raises(NotSupported):
        store.bulk_load(kv(spark, []))
    for bad in (lambda: store.put(kv(spark, [(0, "a")])), lambda: store.put(kv(spark, [(1, "a"), (1, "b")])), lambda: store.scan(0, 1), lambda: store.flatten(10, 1), lambda: store.flatten(0, 1)):
        with pytest.raises(InvalidArgument):
            bad()
    with pytest.raises(InvalidArgument):
        KVStore.open(spark, path, StoreOptions(error_if_exists=True))


def test_random_writes_against_a_dict(spark, tmp_path):
    rng, model = random.Random(3), {i: "v" for i in range(1, 30)}
    store = KVStore.open(spark, str(tmp_path / "kv"))
    store.bulk_load(kv(spark, list(model.items())))
    for step in range(4):
        ops = [(seq, rng.choice("WWD"), rng.randint(1, 60), f"{step}.{seq}") for seq in range(40)]
        store.write(spark.createDataFrame(ops, "seq long, op string, key long, value string"))
        for _, op, key, value in ops:
            model.pop(key, None) if op == "D" else model.update({key: value})
        if step == 2:
            store.flush()
        start = rng.randint(1, 60)
        assert pairs(store.scan(start, 7)) == sorted(x for x in model.items() if x[0] >= start)[:7]


def test_stream_replays_once(spark, tmp_path):
    log = [(i, "D" if i % 5 == 0 else "W", 1 + i % 7, float(i)) for i in range(60)]
    src = str(tmp_path / "in")
    for at in (0, 30):
        spark.createDataFrame(log[at : at + 30], "seq long, op string, key long, value double").coalesce(1).write.mode("append").parquet(src)
    store = KVStore.open(spark, str(tmp_path / "kv"))
    store.bulk_load(spark.createDataFrame([(100, 1.0)], "key long, value double"))
    for _ in range(2):  # the second run finds nothing new
        log_stream.apply_to_store(log_stream.read_log(spark, src, files_per_batch=1), store, str(tmp_path / "ckpt")).awaitTermination()
    newest = {k: (op, v) for _, op, k, v in log}
    assert dict(pairs(store.view())) == {k: v for k, (op, v) in newest.items() if op == "W"} | {100: 1.0}
    for name, df in (("latest", log_stream.latest_values(log_stream.read_log(spark, src))), ("samples", log_stream.throughput_samples(log_stream.read_log(spark, src), 25))):
        df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {r["key"]: (r["op"], r["value"]) for r in spark.table("latest").collect()} == newest
    assert sorted(pairs(spark.table("samples"))) == [(0, 25), (1, 25), (2, 10)]


def test_file_sources(spark, tmp_path):
    (tmp_path / "keys.txt").write_text("3\n1\n3\n\nx\n")
    assert sorted(pairs(files.read_keys(spark, str(tmp_path / "keys.txt")))) == [(1,), (3,)]
    (tmp_path / "keys.bin").write_bytes(b"".join(x.to_bytes(8, "little") for x in (2, 7, 9)))
    assert pairs(files.read_binary_keys(spark, str(tmp_path / "keys.bin"))) == [(7,), (9,)]
    files.write_keys(kv(spark, [(2, "b"), (1, "a")]), str(tmp_path / "out"), values=True)
    assert sorted(pairs(spark.read.csv(str(tmp_path / "out")))) == [("1", "a"), ("2", "b")]
    (tmp_path / "cells.csv").write_text("lat,lng\n40.7,-74\n40.7,-74\n99,0\n")
    assert files.read_cells(spark, str(tmp_path / "cells.csv")).count() == 1
    disk = [{"disk_device": "d", "kB_read": 1.5, "kB_wrtn": 2}, {"disk_device": "d", "kB_read": 1, "kB_wrtn": 0}]
    (tmp_path / "io.json").write_text(json.dumps({"sysstat": {"hosts": [{"statistics": [{"disk": disk}]}]}}, indent=1))
    assert pairs(files.read_device_totals(spark, str(tmp_path / "io.json"))) == [("d", 2.5, 2.0)]
    (tmp_path / "jobs.json").write_text(json.dumps({"jobs": [{"jobname": "r", "read": {"bw_bytes": 2**21, "lat_ns": {"mean": 5000}}}]}))
    assert pairs(files.read_job_rates(spark, str(tmp_path / "jobs.json"))) == [("r", 2.0, 5.0)]
    (tmp_path / "du.txt").write_text("12\t/a/db\n7\t/a\n")
    assert pairs(files.read_disk_usage(spark, str(tmp_path / "du.txt"), "/db")) == [(12, "/a/db")]
    files.write_results(kv(spark, [(1, "x")]), str(tmp_path / "a-zipf-8"))
    read = files.read_results(spark, str(tmp_path / "a-zipf-8"))
    assert pairs(read.select("key", *files.path_dims(["workload", "dist", "threads"]))) == [(1, "a", "zipf", "8")]


def test_workloads(spark):
    n = 1000
    for mix in workloads.MIXES.values():
        rows = workloads.requests(spark, [workloads.Phase(mix, 4000)], n)
        got = {r["op"]: r["count"] for r in rows.groupBy("op").count().collect()}
        assert set(got) == set(mix) and all(abs(got[k] / 40 - share) < 4 for k, share in mix.items())
        assert rows.where("(key % 2 = 0) <> (op = 'insert') or key < 1 or key > 2000 or (op = 'scan') <> (scan_len between 1 and 100)").where("op is not null").count() == 0
    u = workloads.unit(F.col("id"), 1)
    ranks = spark.range(20_000).select(*(f(u, n).alias(name) for name, f in (("zipf", workloads.zipf_rank), ("latest", workloads.latest_rank), ("hot", workloads.hotspot_rank), ("flat", workloads.uniform_rank))))
    r = ranks.agg(*(F.min(c) for c in ranks.columns), *(F.max(c) for c in ranks.columns), F.avg((F.col("zipf") < 10).cast("int")), F.avg(F.col("hot").between(494, 505).cast("int"))).first()
    assert min(r[:4]) >= 0 and max(r[4:8]) <= n - 1 and r[8] > 0.3 and abs(r[9] - 0.9) < 0.03
    rows = workloads.linspace_keys(spark, 10, step=2).withColumn("value", F.lit(0).cast("long"))
    phase = spark.createDataFrame([(0, "read", 1), (1, "update", 3), (2, "rmw", 3), (3, "insert", 4)], "seq long, op string, key long")
    reads, after = workloads.run_phase(rows, phase, F.col("seq") * 10)
    assert sorted(pairs(reads)) == [(0, 1, 0), (2, 3, 0)]
    assert {k: v for k, v in pairs(after) if v} == {3: 20, 4: 30} and after.count() == 11


def test_two_writers_lose_nothing(spark, tmp_path):
    a = KVStore.open(spark, str(tmp_path / "kv"))
    a.bulk_load(kv(spark, [(1, "x")]))
    b = KVStore.open(spark, a.path)
    a.put(kv(spark, [(100, "a")]))
    with pytest.raises(Conflict):
        b.put(kv(spark, [(200, "b")]))
    assert pairs(KVStore.open(spark, a.path).scan(1, 9)) == [(1, "x"), (100, "a")]
    b.refresh()
    b.put(kv(spark, [(200, "b")]))
    with pytest.raises(Conflict):
        a.flush()
    a.refresh()
    a.flush()
    a.vacuum()
    assert pairs(KVStore.open(spark, a.path).scan(1, 9)) == [(1, "x"), (100, "a"), (200, "b")]


def test_load_order_is_judged_over_gaps(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path / "kv"))
    rows = lambda keys: spark.createDataFrame([(10 * i, k, "v") for i, k in enumerate(keys)], "pos long, key long, value string")
    for keys in ((9, 10, 5), (9, 9, 10), (0, 10)):
        with pytest.raises(InvalidArgument):
            store.bulk_load(rows(keys), order="pos")
    store.bulk_load(rows((5, 9, 10)), order="pos")
    assert store.get(9) == "v"


def test_byte_keys_in_byte_order(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path / "kv"))
    rows = lambda at, old: spark.createDataFrame([(f"a{i}", f"{old}{i}") for i in at], "key string, value string")
    store.bulk_load(rows(range(100, 200), "b"))
    store.put(rows(range(150, 200, 2), "c"))
    store.delete(spark.createDataFrame([("a199",), ("zz",)], "key string"))
    store = KVStore.open(spark, store.path)
    assert (store.get(b"a150"), store.get(b"a151"), store.get(b"a199"), store.get(b"a1")) == ("c150", "b151", None, None)
    for i in (0, 45, 95):
        assert [bytes(r["key"]) for r in store.scan(f"a{100 + i}".encode(), 10).collect()] == [f"a{k}".encode() for k in range(100 + i, min(110 + i, 199))]
    assert store.scan(b"a2", 5).count() == 0
    store.put(spark.createDataFrame([(b"", "empty"), (b"\x00\xff", "low"), (b"\xff", "high")], "key binary, value string"))
    assert [r["value"] for r in store.scan(b"", 2).collect()] == ["empty", "low"] and store.scan(b"\xf0", 9).count() == 1
    store.flush()
    assert store.get(b"") == "empty" and store.log().count() == 0
