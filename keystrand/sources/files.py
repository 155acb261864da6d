"""File sources and sinks: key sets, result tables, device statistics, log lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand.functions.keys import z_order


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """Distinct keys of a text file with one unsigned integer a line; other lines are ignored."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where(F.col("line").rlike("^[0-9]+$"))
    return lines.select(F.expr("try_cast(line as bigint)").alias("key")).where("key is not null").distinct()


def read_binary_keys(spark: SparkSession, path: str) -> DataFrame:
    """Keys of files that hold a 64-bit count and then as many 64-bit little-endian values."""

    def parse(batches):
        for b in batches:
            for content in b.column(0):
                data = content.as_py()
                n = int.from_bytes(data[:8], "little")
                for at in range(0, n, 100_000):
                    part = np.frombuffer(data, "<i8", min(100_000, n - at), 8 + 8 * at)
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64())], names=["key"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "key long")


def read_cells(spark: SparkSession, path: str, bits: int = 24) -> DataFrame:
    """Cell keys of ``lat, lng`` rows: both coordinates scaled to ``bits`` and interleaved, plus one."""
    rows = spark.read.csv(path, schema="lat double, lng double", header=True).where("lat between -90 and 90 and lng between -180 and 180")
    scale = F.lit((1 << bits) - 1)
    x, y = F.floor((F.col("lng") + 180) / 360 * scale), F.floor((F.col("lat") + 90) / 180 * scale)
    return rows.select((z_order(x, y, bits) + 1).alias("key")).distinct()


def write_keys(rows: DataFrame, path: str, *, values: bool = False) -> None:
    """CSV of keys, or of keys and values, without a header, sorted within key ranges."""
    rows.select("key", *(["value"] if values else [])).repartitionByRange("key").sortWithinPartitions("key").write.csv(path)


def read_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Result CSV with a header; give a schema to spare the pass that infers one."""
    return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True)


def path_dims(names: list[str], path: Column | None = None, sep: str = "-") -> list[Column]:
    """Columns from the name of a file's folder, ``a-b-c`` cut at ``sep``."""
    folder = F.element_at(F.split(F.col("_metadata.file_path") if path is None else path, "/"), -2)
    return [F.get(F.split(folder, sep), F.lit(i)).alias(n) for i, n in enumerate(names)]


def read_device_totals(spark: SparkSession, path: str) -> DataFrame:
    """Sums of KiB read and written by device over the samples of an I/O statistics file (JSON)."""
    schema = "sysstat struct<hosts: array<struct<statistics: array<struct<disk: array<struct<disk_device: string, kB_read: double, kB_wrtn: double>>>>>>>"
    disks = spark.read.json(path, schema=schema, multiLine=True)
    for level in ("sysstat.hosts", "x.statistics", "x.disk"):
        disks = disks.select(F.explode(level).alias("x"))
    return disks.groupBy(F.col("x.disk_device").alias("device")).agg(F.sum("x.kB_read").alias("read_kb"), F.sum("x.kB_wrtn").alias("written_kb"))


def read_job_rates(spark: SparkSession, path: str) -> DataFrame:
    """Bandwidth and mean latency of the jobs of an I/O benchmark file (JSON)."""
    schema = "jobs array<struct<jobname: string, read: struct<bw_bytes: double, lat_ns: struct<mean: double>>>>"
    jobs = spark.read.json(path, schema=schema, multiLine=True).select(F.explode("jobs").alias("j"))
    return jobs.select(F.col("j.jobname").alias("job"), (F.col("j.read.bw_bytes") / 2**20).alias("mib_per_s"), (F.col("j.read.lat_ns.mean") / 1000).alias("mean_us"))


def read_disk_usage(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """``bytes, path`` of the lines ``<bytes> tab <path>`` whose path ends with ``suffix``."""
    cut = F.split("value", "\t", 2)
    return spark.read.text(path).select(F.expr("try_cast(split(value, '\\t', 2)[0] as bigint)").alias("bytes"), cut[1].alias("path")).where(F.endswith("path", F.lit(suffix)))
