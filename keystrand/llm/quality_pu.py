"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_or_empty

GRAMS = 1024
DENSE = 28
#: Bounds of the training samples of labelled rows, which reach the driver as feature vectors.
MAX_POSITIVES = 2000
MAX_UNLABELLED = 4000

_PAIR = (np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(GRAMS)
_PAIR = _PAIR.astype(np.int64)
_CLASS = np.zeros(256, np.int64)  # 0 other, then by kind
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"|\\/_", b"#$%&*@^~+=<>", b"\"'()[]{}-`"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 11


def features(text: str) -> np.ndarray:
    """Features of a whole text: shares of byte pairs (hashed), of kinds of characters, and shape."""
    data = text.encode("utf-8", "replace")
    out = np.zeros(GRAMS + DENSE, np.float32)
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    if n > 1:
        out[:GRAMS] = np.sqrt(np.bincount(_PAIR[b[:-1].astype(np.int64) << 8 | b[1:]], minlength=GRAMS) / (n - 1))
    kinds = np.bincount(_CLASS[b], minlength=12)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    d = out[GRAMS:]
    d[:12] = np.sqrt(kinds / max(n, 1))
    if words:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        lower = list(map(bytes.lower, words))
        d[12] = len(set(lower)) / len(words) ** 0.9
        d[13] = lengths.mean() / 10
        d[14] = lengths.std() / 10
        d[15] = (lengths <= 3).mean()
        d[16] = (lengths >= 12).mean()
        d[17] = sum(map(bytes.isupper, words)) / len(words)
        d[18] = sum(map(bytes.isalpha, words)) / len(words)
        d[19] = sum(map(bytes.isdigit, words)) / len(words)
        d[20] = sum(x == y for x, y in zip(lower, lower[1:], strict=False)) / len(words)
        d[21] = np.log1p(len(words)) / 10
    if lines:
        d[22] = 1 - len(set(lines)) / len(lines)
        d[23] = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines)
        d[24] = np.log1p(n / len(lines)) / 10
        d[25] = sum(map(bytes.isupper, lines)) / len(lines)
        d[26] = sum(x[:1].islower() for x in lines) / len(lines)
    d[27] = 1.0 if not words else 0.0
    return out


class PuModel:
    """Linear scorer on standardised features; ``score`` is its logistic value."""

    def __init__(self, mean, scale, w, b):
        self.mean, self.scale, self.w, self.b = mean, scale, w, b

    def score(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w = (v.astype(np.float32) for v in (self.mean, self.scale, self.w))
        z = np.empty(len(x))
        for at in range(0, len(x), 512):  # few rows at a time: the driver scores its samples too
            part = x[at : at + 512] - mean
            part /= scale
            np.clip(part, -8, 8, out=part)
            z[at : at + 512] = part @ w
        return 1 / (1 + np.exp(-np.clip(z + self.b, -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, rounds: int = 500, rate: float = 0.02, decay: float = 3e-4) -> PuModel:
    """Minimises the non-negative unbiased PU risk with the logistic loss, by full-batch Adam.

    Risk: ``prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])``.  While the second part is
    negative, a step goes up its gradient, as the non-negative estimator prescribes.
    """
    n = len(positive) + len(unlabelled)
    mean = (positive.sum(0, dtype=np.float64) + unlabelled.sum(0, dtype=np.float64)) / n
    # single precision and in place: these are the largest arrays that the driver holds
    p, u = (x - mean.astype(np.float32) for x in (positive, unlabelled))
    spread = sum(np.einsum("ij,ij->j", x[at : at + 512], x[at : at + 512], dtype=np.float64) for x in (p, u) for at in range(0, len(x), 512))
    scale = np.sqrt(spread / n) + 1e-3
    for x in (p, u):
        x /= scale.astype(np.float32)
        np.clip(x, -8, 8, out=x)
    w, b = np.zeros(p.shape[1]), np.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, rounds + 1):
        w32 = w.astype(np.float32)
        zp, zu = (p @ w32).astype(np.float64) + b, (u @ w32).astype(np.float64) + b
        below = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_up = -prior * sigmoid(-zp) / len(p)  # of prior * E_P[l(f)], by zp
        g_np, g_nu = -prior * sigmoid(zp) / len(p), sigmoid(zu) / len(u)  # of the second part
        if below >= 0:
            dp, du = g_up + g_np, g_nu
        else:
            dp, du = -g_np, -g_nu
        g = np.append(dp.astype(np.float32) @ p + du.astype(np.float32) @ u + decay * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return PuModel(mean, scale, w, b)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior of the unlabelled rows, from positives and unlabelled rows alone.

    The prior is at most the ratio of the shares above any score, U to P, and near it where the top scores
    are pure.  The score to cut at is where the ratio plus its sampling error is least (best bin
    estimation).  Two folds by a hash of the features: each is scored by a first model, of prior one
    half, that is fitted on the other, so that no row is scored by a model that has seen it.
    """
    of = lambda x: np.array([zlib.crc32(r.tobytes()) & 1 for r in x], bool)
    fp, fu, found = of(positive), of(unlabelled), []
    for fold in (False, True):
        n_p, n_u = int((fp == fold).sum()), int((fu == fold).sum())
        if n_p in (0, len(fp)) or n_u in (0, len(fu)):
            continue
        model = fit_nnpu(positive[fp != fold], unlabelled[fu != fold], 0.5, rounds=150)
        sp, su = np.sort(model.score(positive)[fp == fold]), np.sort(model.score(unlabelled)[fu == fold])
        above_p, above_u = 1 - np.arange(len(sp)) / len(sp), 1 - np.searchsorted(su, sp) / len(su)
        error = np.sqrt(np.log(40) / 2) * (n_p**-0.5 + n_u**-0.5)
        best = int(((above_u + error) / above_p).argmin())
        found.append(above_u[best] / above_p[best])
    return float(np.clip(np.mean(found), 0.05, 0.95)) if found else 0.5


def held_out(id_: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _feature_rows(batches):
    for b in sliced(batches):
        x = [features(t.as_py() or "").tobytes() for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], names=["id", "kind", "x"])


def train_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", prior: float | None = None, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> PuModel | None:
    """Fits on trusted positives and on documents whose label is not looked at, none of them held out.

    Both are samples of the rows that ``labels`` lists, the first ``max_positives`` and
    ``max_unlabelled`` by a hash of the id; the second takes rows of any label, null ones too, and never reads
    it.  They reach the driver as feature vectors; texts do not.  The class prior, unless given, is
    ``estimate_prior`` of these two samples.  Of several texts under one id one is taken, the same in
    every run.  None without positives or without documents.
    """
    listed = labels.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"))
    first = F.xxhash64("id", F.lit(1))
    positives = listed.where("label = 1").select("id").distinct().orderBy(first, "id").limit(max_positives)
    others = listed.select("id").distinct().orderBy(first, "id").limit(max_unlabelled)
    picked = positives.withColumn("kind", F.lit(1)).unionAll(others.withColumn("kind", F.lit(0)))
    # bounded by the two limits, so it may be broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    rows = rows.select("id", "kind", "text").mapInArrow(_feature_rows, "id long, kind int, x binary")
    got = rows.groupBy("id", "kind").agg(F.min("x").alias("x")).toArrow()
    kind, ids = got.column("kind").to_numpy(), got.column("id").to_numpy()
    if not (kind == 1).any() or not (kind == 0).any():
        return None
    x = np.empty((len(kind), GRAMS + DENSE), np.float32)
    for i, row in enumerate(got.column("x")):
        x[i] = np.frombuffer(row.as_buffer(), np.float32)
    del got
    # rows arrive in any order; a fixed order makes reruns agree
    u, p = (x[np.flatnonzero(kind == k)[np.argsort(ids[kind == k])]] for k in (0, 1))
    del x
    if prior is None:
        prior = estimate_prior(p, u)
    return fit_nnpu(p, u, float(np.clip(prior, 0.01, 0.99)))


def score_quality(docs: DataFrame, model: PuModel | None, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Scores every whole text: ``id, held_out, score, predicted``; with ``keep`` all columns of ``docs`` and
    ``quality_score``, to which an input column of that name gives way.

    Null texts count as empty, and empty texts have a score too; without a model every score is 0.5;
    repeated rows are kept; empty tables give an empty result.  A map over rows, without a shuffle.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    fields = [StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)] if keep else [StructField("c0", docs.schema[id_col].dataType)]
    names = docs.columns if keep else [id_col]
    schema = StructType([*fields, StructField("score", DoubleType())])

    def run(batches):
        for b in sliced(batches):
            x = np.stack([features(t.as_py() or "") for t in b.column(0)])
            s = model.score(x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s, pa.float64())], names=schema.names)

    rows = docs.select(text_or_empty(F.col(text_col)).alias("t"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).mapInArrow(run, schema)
    if keep:
        own = [F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c.lower() != "quality_score"]
        return rows.select(*own, F.col("score").alias("quality_score"))
    return rows.select(F.col("c0").alias(id_col), held_out(F.col("c0")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
