"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components

#: Bound of the sample that the rotations are learned on.
MAX_SAMPLE = 8000
#: A larger bucket is compared in pairs of blocks of about this many rows.
BLOCK_ROWS = 1024


def learn_itq(x: np.ndarray, n_codes: int, *, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """``projection``: sign(v @ projection) has ``n_codes * d`` bits.

    Each code is iterative quantisation from another random start: take signs, and solve for the
    rotation that brings the vectors nearest to the signs.  The vectors are neither centred nor
    scaled, as both change angles: a rotation keeps the angle that ``table_plan`` counts on,
    whatever the mean and the spectrum of the vectors.
    """
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n_codes):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
            r = (u @ w).T
        out.append(r)
    return np.concatenate(out, 1)


def table_plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits per substring and number of substrings (tables) for ``n`` vectors.

    Substrings grow with the logarithm of ``n`` so that buckets stay small; the number of tables is
    what a pair exactly at the threshold needs to share a substring with probability ``recall``.
    """
    bits = max(6, math.ceil(math.log2(max(n, 2))) - 3)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(4, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _codes(x: np.ndarray, proj: np.ndarray, bits: int) -> np.ndarray:
    """The substrings of each vector as numbers, one column per table."""
    on = (x @ proj >= 0).reshape(len(x), -1, bits)
    return (on * (1 << np.arange(bits, dtype=np.int64))).sum(2).astype(np.int64)


def plan_codes(x: np.ndarray, n: int, threshold: float, recall: float, *, trials: int = 2000, max_tables: int = 400) -> tuple[int, np.ndarray]:
    """Bits per substring and the projection of all tables, learned on the unit vectors ``x``.

    The number of tables is checked in the code space itself: vectors of ``x`` get partners exactly
    at the threshold, in random directions and in those of other vectors, and tables of random
    rotations are added until a share ``recall`` of either kind meets (learned rotations of few
    dimensions are alike, so that more of them would not help).
    """
    dim = x.shape[1]
    bits, tables = table_plan(n, threshold, recall)
    proj = learn_itq(x, -(-bits * tables // dim))[:, : bits * tables]
    rng = np.random.default_rng(11)
    some = x[:trials]
    kinds = []
    for way in (rng.standard_normal(some.shape), x[rng.permutation(len(x))[: len(some)]]):
        way = way - (way * some).sum(1, keepdims=True) * some
        size = np.linalg.norm(way, axis=1)
        good = size > 1e-6
        if good.any():
            kinds.append((some[good], threshold * some[good] + math.sqrt(max(0.0, 1 - threshold * threshold)) * way[good] / size[good, None]))
    while proj.shape[1] < bits * max_tables and any((_codes(a, proj, bits) == _codes(b, proj, bits)).any(1).mean() < recall for a, b in kinds):
        more = bits * max(1, proj.shape[1] // bits // 4)
        turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-more // dim))]
        proj = np.concatenate([proj, np.concatenate(turns, 1)[:, :more]], 1)
    return bits, proj


def _components_of(mask: np.ndarray) -> np.ndarray:
    """Smallest reachable row for each row of a symmetric boolean matrix."""
    n = len(mask)
    label = np.full(n, -1)
    for s in range(n):
        if label[s] >= 0:
            continue
        label[s], front = s, np.array([s])
        while len(front):
            front = np.flatnonzero(mask[front].any(0) & (label < 0))
            label[front] = s
    return label


def _compare_bucket(ids, x, codes, t, side, threshold):
    """Links of one bucket block that no earlier table has: (ids, counts, roots).

    ``side``: 0 and 1 for the two blocks of a pair, or all 0 for a block with itself.
    """
    order = np.argsort(ids, kind="stable")
    ids, x, codes, side = ids[order], x[order], codes[order], side[order]
    link = x @ x.T >= threshold
    if side.any():
        link &= side[:, None] != side[None, :]
    np.fill_diagonal(link, False)
    link &= ids[:, None] != ids[None, :]
    if not link.any():
        return None
    for s in range(t):
        link &= codes[:, s, None] != codes[None, :, s]
    count = link.sum(1)
    roots = _components_of(link)
    has = count > 0
    return (ids[has], count[has], ids[roots][has]) if has.any() else None


def embedding_dedup(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.92, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """Near-duplicate classes of vectors by cosine: ``id, n_links, component_id, kept``.

    Rotations are learned on at most ``max_sample`` vectors (the first by a hash of the id); every
    vector is coded and put in every table.  Vectors that share a substring are candidates; cosines
    in double precision of the original vectors decide, so no link under ``threshold`` is made.  A
    pair counts in the first table where it meets.  A bucket of any size is compared whole: buckets
    beyond ``BLOCK_ROWS`` are split in pairs of blocks, each a group of its own, and what leaves a
    block is one row per linked vector (its number of links and its local root), never a pair.

    Null, zero, non-finite or empty vectors, and vectors that hold nulls, link with nothing and stand
    alone; vectors of different lengths do not link.  Rows of equal id count as one vector (the least
    array).  A null id stands alone with a null component and is kept.  Every input row is returned;
    empty tables give an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = rows.where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    usable = usable.groupBy("id").agg(F.min("v").alias("v"))
    n_by_dim = {r["d"]: r["n"] for r in usable.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    found = None
    for dim, n in sorted(n_by_dim.items()):
        if n < 2:
            continue
        own = usable.where(F.size("v") == dim)
        sample = own.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(max_sample).toPandas()
        x = np.array(sample.v.tolist())
        x = x / np.abs(x).max(1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        bits, proj = plan_codes(x, n, threshold, recall)
        part = _links_of(own, proj, bits, threshold)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], "id long, n long, root long")
    found = checkpointed(found)
    counts = found.groupBy("id").agg(F.sum("n").cast("long").alias("n_links"))
    comps = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    out = rows.select("id").join(counts, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    comp = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(True)).alias("kept"))


def _links_of(own: DataFrame, proj, bits: int, threshold: float) -> DataFrame:
    tables = proj.shape[1] // bits

    def code(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            x = x / np.abs(x).max(1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            codes = _codes(x, proj, bits)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "codes", "x"]
            )

    coded = own.mapInArrow(code, "id long, codes array<long>, x binary")
    keys = coded.select("id", "codes", "x", F.posexplode("codes").alias("t", "code"))
    sizes = keys.groupBy("t", "code").agg(F.count("*").alias("m")).where("m > 1")
    k = F.ceil(F.col("m") / F.lit(BLOCK_ROWS)).cast("int")
    mine = F.pmod(F.xxhash64("id", F.lit(5)), F.col("k")).cast("int")
    blocks = (
        keys.join(sizes, ["t", "code"])
        .withColumn("k", k)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .select("t", "code", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "id", "codes", "x")
    )
    keyed = ["t", "code", "i", "j"]
    blocks = blocks.repartition(*keyed).sortWithinPartitions(*keyed)

    def compare(batches):
        held: list = []
        held_rows = 0

        def run(rb_list):
            rb = pa.Table.from_batches(rb_list)
            key = np.stack([rb.column(c).to_numpy() for c in keyed])
            cut = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            ids, side = rb.column("id").to_numpy(), rb.column("side").to_numpy()
            x = np.frombuffer(b"".join(rb.column("x").to_pylist()), np.float64).reshape(len(ids), -1)
            codes = rb.column("codes").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            out = []
            for a, b in zip(cut, [*cut[1:], len(ids)], strict=True):
                if b - a > 1 and (got := _compare_bucket(ids[a:b], x[a:b], codes[a:b], int(key[0, a]), side[a:b], threshold)) is not None:
                    out.append(got)
            return out

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            held_rows += b.num_rows
            # groups lie together; the last one of a batch may go on in the next
            last = [b.column(b.schema.get_field_index(c))[-1].as_py() for c in keyed]
            whole = pa.Table.from_batches(held)
            key = np.stack([whole.column(c).to_numpy() for c in keyed])
            same = (key == np.array(last)[:, None]).all(0)
            done = int(np.argmax(same))
            if done:
                yield from _emit(run(whole.slice(0, done).to_batches()))
                held = whole.slice(done).combine_chunks().to_batches()
        if held:
            yield from _emit(run(held))

    def _emit(out):
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)) for i in range(3)], names=["id", "n", "root"])

    return blocks.mapInArrow(compare, "id long, n long, root long")
