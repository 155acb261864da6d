"""Helpers shared by the training-data operators: tables, checkpoints, components."""

from __future__ import annotations

import re
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Links of a forest that one task contracts, on average; tasks grow with the links.
TASK_LINKS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, UPPER.lower())


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where a local session names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ks-ckpt-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def sliced(batches, rows: int = 512):
    """Batches of at most ``rows`` rows, so that what a map builds for a batch stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _local_forest(batches):
    """Union-find over one partition's links; emits (node, smallest node of its local tree)."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            ru, rv = find(u), find(v)
            if ru != rv:
                parent[max(ru, rv)] = min(ru, rv)
    rows = [(x, find(x)) for x in parent]
    rows = [r for r in rows if r[0] != r[1]]
    for i in range(0, len(rows), 50_000):
        part = rows[i : i + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64())], names=["u", "v"]
        )


def _is_flat(edges: DataFrame) -> bool:
    """Whether every edge hangs on a root: no node has two parents, or is both a child and a parent."""
    twice = edges.groupBy("u").count().where("count > 1").isEmpty()
    return twice and edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """Connected components of undirected links ``(u long, v long)``.

    Returns ``(node, component)`` for every node of a link, ``component`` being the smallest node
    that it reaches.  Self-links and null ends are ignored.  Each partition contracts its own links to
    a forest, ``TASK_LINKS`` of them a task; until all trees are flat, alternating large-star and
    small-star rounds join them, with a checkpoint per round.  Rounds are logarithmic in practice and end
    only when the components are whole; no link is ever collected.
    """
    spark = links.sparkSession
    edges = links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null and u <> v")
    edges = checkpointed(edges.mapInArrow(_local_forest, "u long, v long"))
    n = edges.count()
    if not n:
        return spark.createDataFrame([], "node long, component long")
    edges = checkpointed(edges.coalesce(n // TASK_LINKS + 1).mapInArrow(_local_forest, "u long, v long"))
    while not _is_flat(edges):
        # large star: every neighbour above u goes to the smallest of u's closed neighbourhood
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the neighbours below u, and u, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
