"""Exact substring dedup with run-length (BWT) indexes over content-defined shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, sliced
from .shingles import PIECE, mix

#: Bytes of the anchors that bring equal strings together.
ANCHOR = 32
#: Distinct spans of one anchor that one index takes; anchors with more are split by whole strings.
INDEX_SPANS = 4096
#: Entries that a map task packs at a time.
CHUNK_ENTRIES = 1_000_000
#: Bytes of text whose anchors one part takes, on average; parts grow with the texts.
PART_BYTES = 1 << 24
_STEP = PIECE - 4096
_B = 0x9E3779B97F4A7C15 | 1
_TABLES: list[np.ndarray] = []

_ENTRY = np.dtype([("h", "<u8"), ("dig", "<u8"), ("owner", "<u4"), ("a", "<u4"), ("w", "<u2")])


def _tables() -> list[np.ndarray]:
    """Powers of the base of the rolling hash, and of its inverse."""
    if not _TABLES:
        for base in (_B, pow(_B, -1, 1 << 64)):
            t = np.ones(PIECE + 1, np.uint64)
            t[1:] = np.uint64(base)
            _TABLES.append(np.cumprod(t, dtype=np.uint64))
    return _TABLES


def _rolling(b: np.ndarray) -> np.ndarray:
    power, _ = _tables()
    run = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=run[1:])
    return run


def _hash_range(run: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Hash of the bytes [a, z), whatever their place."""
    _, inverse = _tables()
    return mix(mix((run[z] - run[a]) * inverse[a]) + (z - a).astype(np.uint64))


def anchors(text: bytes, length: int, anchor: int = ANCHOR) -> np.ndarray:
    """The spans of a text: each string of ``length`` bytes belongs to its smallest ``anchor``-gram.

    The anchor of a string depends on its bytes only, so equal strings have equal anchors.  Strings of
    one anchor start at consecutive places ``a .. a + w`` and cover the span ``[a, a + w + length)``.
    Returns entries with the hash of the anchor and of the span.
    """
    view, out = np.frombuffer(text, np.uint8), []
    width = length - anchor + 1
    for at in range(0, max(len(view) - length + 1, 0), _STEP):
        b = view[at : at + _STEP + length - 1]
        run = _rolling(b)
        grams = np.arange(len(b) - anchor + 1)
        h = _hash_range(run, grams, grams + anchor)
        key = h >> np.uint64(18) << np.uint64(18) | grams.astype(np.uint64)
        pad = np.full(-len(key) % width, np.iinfo(np.uint64).max, np.uint64)
        block = np.concatenate([key, pad]).reshape(-1, width)
        ahead = np.minimum.accumulate(block, axis=1).ravel()
        behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = len(b) - length + 1
        least = np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts])
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.append(first[1:], starts) - 1
        e = np.zeros(len(first), _ENTRY)
        e["h"] = h[(least[first] & np.uint64((1 << 18) - 1)).astype(np.int64)]
        e["dig"] = _hash_range(run, first, last + length)
        e["a"], e["w"] = first + at, last - first
        out.append(e)
    return np.concatenate(out) if out else np.zeros(0, _ENTRY)


def whole_strings(text: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """Entries of single strings: hash and digest are two halves of one hash of the string."""
    e = np.zeros(len(starts), _ENTRY)
    for i, s in enumerate(starts.tolist()):
        d = hashlib.blake2b(text[s : s + length], digest_size=16).digest()
        e["h"][i], e["dig"][i] = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")
    e["a"] = starts
    return e


class _Packer:
    """Packs entries of many documents into rows ``part, entries, ids, digs`` by part of the hash space."""

    NAMES = ("part", "entries", "ids", "digs")
    SCHEMA = "part int, entries binary, ids binary, digs binary"

    def __init__(self, parts: int):
        self.parts, self.held, self.ids, self.digs, self.size = parts, [], [], [], 0

    def add(self, e: np.ndarray, id_: int, dig: int):
        if len(e):
            e["owner"] = len(self.ids)
            self.held.append(e)
            self.ids.append(id_)
            self.digs.append(dig)
            self.size += len(e)
        if self.size >= CHUNK_ENTRIES:
            yield self.flush()

    def flush(self):
        e, ids, digs = np.concatenate(self.held), np.array(self.ids, np.int64), np.array(self.digs, np.int64)
        self.held, self.ids, self.digs, self.size = [], [], [], 0
        part = (e["h"] >> np.uint64(33)) % np.uint64(self.parts)
        order = np.argsort(part, kind="stable")
        e, part = e[order], part[order]
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        rows = []
        for a, z in zip(cut, [*cut[1:], len(e)], strict=True):
            x = e[a:z].copy()
            used, x["owner"] = np.unique(x["owner"], return_inverse=True)
            rows.append((int(part[a]), x.tobytes(), ids[used].tobytes(), digs[used].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], names=self.NAMES)


def _pack_anchors(parts: int, length: int):
    def run(batches):
        packer = _Packer(parts)
        for b in batches:
            for id_, dig, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                yield from packer.add(anchors(text.as_py(), length), id_, dig)
        if packer.held:
            yield packer.flush()

    return run


def _resolve(table: pa.Table) -> pa.Table:
    """Of one part: what equal spans settle, and what is left.

    Kind 0: a span that is equal to an earlier one; all its strings start earlier.  Kind 1: the first
    of equal spans whose anchor has other spans too.  Kind 2: the same where these are too many for
    one index.
    """
    entry = [np.frombuffer(x, _ENTRY) for x in table.column("entries").to_pylist()]
    own_id = [np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()]
    own_dig = [np.frombuffer(x, np.int64) for x in table.column("digs").to_pylist()]
    ids = np.concatenate([o[e["owner"]] for o, e in zip(own_id, entry, strict=True)])
    doc = np.concatenate([o[e["owner"]] for o, e in zip(own_dig, entry, strict=True)])
    e = np.concatenate(entry)
    del entry
    # most anchors occur once: drop them before the full sort
    order = np.argsort(e["h"], kind="stable")
    h = e["h"][order]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    alone = new & np.append(new[1:], True)
    order = order[~alone]
    e, ids, doc = e[order], ids[order], doc[order]
    order = np.lexsort((e["a"], doc, ids, e["dig"], e["h"]))
    e, ids, doc = e[order], ids[order], doc[order]
    if len(e):
        same = (e["h"][1:] == e["h"][:-1]) & (e["dig"][1:] == e["dig"][:-1])
        again = same & (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1]) & (e["a"][1:] == e["a"][:-1])
        keep = np.concatenate([[True], ~again])  # a repeated row is the same document
        first = np.concatenate([[True], ~same])
        run = np.cumsum(np.concatenate([[True], e["h"][1:] != e["h"][:-1]])) - 1
        spans = np.bincount(run, weights=first)[run]
        kind = np.where(~first, 0, np.where(spans <= 1, 3, np.where(spans <= INDEX_SPANS, 1, 2)))
        pick = keep & (kind < 3)
        e, ids, doc, kind = e[pick], ids[pick], doc[pick], kind[pick]
    else:
        kind = np.zeros(0, np.int64)
    return pa.table({"kind": kind.astype(np.int32), "id": ids, "doc": doc, "a": e["a"].astype(np.int32), "w": e["w"].astype(np.int32), "h": e["h"].view(np.int64) if len(e) else np.zeros(0, np.int64)})


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of spans, with sampled run ends.

    ``starts`` and ``jumps`` hold, per run of the transform, its first row and where that row's
    suffix goes when it is extended to the left; so one step for any row is a search among the runs.
    ``ends`` are the sampled text places of the run ends.  Rows whose suffixes agree in the first
    ``length`` bytes are a block; ``earliest`` is the smallest text place in each.
    """

    def __init__(self, spans: list[bytes], length: int):
        text = np.zeros(sum(map(len, spans)) + len(spans) + 1, np.uint64)
        at = 1
        self.stops = np.zeros(len(spans), np.int64)
        for i, s in enumerate(spans):
            text[at : at + len(s)] = np.frombuffer(s, np.uint8).astype(np.uint64) + np.uint64(1)
            at += len(s)
            self.stops[i] = at
            at += 1
        n = len(text)
        packed = np.zeros(n, np.uint64)
        for k in range(7):
            packed[: n - k] |= text[k:] << np.uint64(9 * (6 - k))
        rank, depth, at_56 = self._rank(packed), 7, None
        while True:
            if depth == 56:
                at_56 = rank
            if rank.max() == n - 1 and at_56 is not None:
                break
            ahead = np.zeros(n, np.int64)
            ahead[: max(n - depth, 0)] = rank[depth:] + 1
            rank, depth = self._rank(rank.astype(np.uint64) * np.uint64(n + 1) + ahead.astype(np.uint64)), depth * 2
        places = np.empty(n, np.int64)
        places[rank] = np.arange(n)
        before = text[places - 1]
        head = np.concatenate([[True], before[1:] != before[:-1]])
        self.starts = np.flatnonzero(head)
        self.ends = places[np.append(self.starts[1:], n) - 1]
        self.jumps = rank[places[self.starts] - 1]
        tail = length - 56
        other = np.minimum(places + tail, n - 1)
        a, b = at_56[places], at_56[other]
        self.blocks = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        self.earliest = np.minimum.reduceat(places, self.blocks)
        self.rows_of_stops = rank[self.stops]

    @staticmethod
    def _rank(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        new = np.zeros(len(key), np.int64)
        s = key[order]
        new[1:] = np.cumsum(s[1:] != s[:-1])
        rank = np.empty(len(key), np.int64)
        rank[order] = new
        return rank

    def left(self, rows: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.starts, rows, side="right") - 1
        return self.jumps[run] + rows - self.starts[run]

    def has_earlier(self, lengths: np.ndarray, length: int):
        """Streams all spans from their ends to the left; yields (spans, starts) whose match is earlier.

        The row reached after each step is that of the suffix itself; its match of ``length`` bytes
        or more lies in its block, and it is an earlier one if the block's smallest place is smaller.
        """
        live, rows = np.arange(len(lengths)), self.rows_of_stops
        for step in range(1, int(lengths.max(initial=0)) + 1):
            on = lengths[live] >= step
            live, rows = live[on], self.left(rows[on])
            if step >= length:
                block = np.searchsorted(self.blocks, rows, side="right") - 1
                hit = self.earliest[block] < self.stops[live] - step
                if hit.any():
                    yield live[hit], lengths[live[hit]] - step


def _index_shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        ids, doc, a = (table.column(c).to_numpy() for c in ("id", "doc", "a"))
        spans = table.column("bytes").to_pylist()
        order = np.lexsort((a, doc, ids))
        ids, doc, a = ids[order], doc[order], a[order]
        spans = [spans[i] for i in order]
        index = RunLengthIndex(spans, length)
        found = list(index.has_earlier(np.array(list(map(len, spans)), np.int64), length))
        k = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        s = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        order = np.lexsort((s, k))
        k, s = k[order], s[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1] + 1)]) if len(k) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(k)) - 1 if len(k) else first
        return pa.table({"id": ids[k[first]], "doc": doc[k[first]], "start": (a[k[first]] + s[first]).astype(np.int32), "end": (a[k[first]] + s[last] + length).astype(np.int32)})

    return run


def _cut_spans(batches, length: int):
    for b in sliced(batches):
        rows: list[tuple] = []
        for id_, doc, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
            text = text.as_py()
            rows += [(id_, doc, s["a"], s["h"], text[s["a"] : s["a"] + s["w"] + length]) for s in spans if s["kind"] == 1]
        yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())))], names=["id", "doc", "a", "h", "bytes"])


def _cut_strings(batches, parts: int, length: int):
    packer = _Packer(parts)
    for b in batches:
        for id_, doc, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
            starts = [np.arange(s["a"], s["a"] + s["w"] + 1) for s in spans if s["kind"] == 2]
            if starts:
                yield from packer.add(whole_strings(text.as_py(), np.concatenate(starts), length), id_, doc)
    if packer.held:
        yield packer.flush()


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans as maximal runs in order."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> tuple[DataFrame, DataFrame]:
    """``(texts, marks)``: ``texts`` has ``id, doc, text`` (bytes), ``marks`` has ``id, doc, spans``.

    ``spans`` are the byte spans covered by strings of ``length`` bytes that start earlier too: at a
    smaller id, or in the same document before.  ``doc`` is a hash of the text.
    """
    binary = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(2 * shuffle_width(docs.sparkSession), size // PART_BYTES + 1)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(binary).alias("doc"), binary.alias("text"))
    packed = texts.where(F.length("text") >= length).mapInArrow(_pack_anchors(parts, length), _Packer.SCHEMA)
    found = "kind int, id long, doc long, a int, w int, h long"
    settled = packed.groupBy("part").applyInArrow(_resolve, found)
    open_ = settled.where("kind > 0").groupBy("id", "doc").agg(F.collect_list(F.struct("kind", "a", "w", "h")).alias("spans"))
    held = texts.join(open_, ["id", "doc"]).select("id", "doc", "text", "spans")
    shards = 4 * parts
    cut = held.mapInArrow(lambda it: _cut_spans(it, length), "id long, doc long, a int, h long, bytes binary").dropDuplicates(["id", "doc", "a", "h"])
    indexed = cut.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(_index_shard(length), "id long, doc long, start int, end int")
    strings = held.mapInArrow(lambda it: _cut_strings(it, parts, length), _Packer.SCHEMA).groupBy("part").applyInArrow(_resolve, found)
    by_equality = settled.where("kind = 0").unionAll(strings.where("kind = 0")).select("id", "doc", F.col("a").alias("start"), (F.col("a") + F.col("w") + length).alias("end"))
    marks = by_equality.unionAll(indexed).groupBy("id", "doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return texts, marks


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, keep: bool = False) -> DataFrame:
    """Removes each byte covered by a string of ``length`` bytes that also starts earlier.

    1. Every string belongs to its smallest ``ANCHOR``-gram, a function of its bytes, so equal strings
       meet.  The strings of a document with the same anchor form one short span.
    2. Spans meet by the hash of their anchor.  Equal spans are settled at once: all but the first
       are repeats.  Anchors of one distinct span need nothing more.
    3. The distinct spans of an anchor go to a shard.  The shard's run-length index (run-compressed
       BWT with sampled run ends) is built over its spans in corpus order, all spans are streamed
       through it, and strings whose match of ``length`` bytes starts earlier are marked.
    4. An anchor with more than ``INDEX_SPANS`` distinct spans (a short line in a third of all texts)
       is split by whole strings instead, which spreads it over the cluster; equal strings then
       settle it exactly as in step 2.

    Result: ``id, n_bytes, n_removed, n_spans, kept_sha256`` and with ``keep`` all columns of
    ``docs``, the text replaced by what is left (bytes of characters cut in two go), and a struct ``dedup``
    with the spans ``removed`` (an input column of that name gives way to it).  Null texts are empty; null ids come last in order; repeated rows of equal id and text
    are one document, so both stay; rows of equal id and different text are in the order of a hash;
    empty tables give an empty result; other columns are not read.
    """
    texts, marks = repeated_spans(docs, id_col=id_col, text_col=text_col, length=length)
    if keep:
        binary = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
        texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(binary).alias("doc"), binary.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"))
        rows = texts.join(marks, ["id", "doc"], "left").select("text", "spans", "row")
    else:
        rows = texts.join(marks, ["id", "doc"], "left").select("text", "spans", "id")

    def run(batches):
        for b in sliced(batches):
            n, gone, count, sha, left, spans_out = [], [], [], [], [], []
            for text, spans in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                text = text.as_py()
                spans = merge_spans([(s["start"], s["end"]) for s in spans or ()])
                at, parts = 0, []
                for a, z in spans:
                    parts.append(text[at:a])
                    at = z
                kept = b"".join([*parts, text[at:]])
                n.append(len(text))
                gone.append(len(text) - len(kept))
                count.append(len(spans))
                sha.append(hashlib.sha256(kept).hexdigest())
                if keep:
                    left.append(kept.decode("utf-8", "ignore"))
                    spans_out.append([{"start": a, "end": z} for a, z in spans])
            cols = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())]
            if keep:
                cols += [pa.array(left, pa.string()), pa.array(spans_out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([b.column(2), *cols], names=[out[0], "n_bytes", "n_removed", "n_spans", "kept_sha256", "left", "removed"][: 1 + len(cols)])

    digest = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if not keep:
        out = ["id"]
        done = rows.mapInArrow(run, f"id long, {digest}")
        id_ = F.when(F.col("id") != F.lit(2**63 - 1), F.col("id"))
        return done.select(id_.cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    out = ["row"]
    row_type = rows.schema["row"].dataType.simpleString()
    done = rows.mapInArrow(run, f"row {row_type}, {digest}, left string, removed array<struct<start:int,end:int>>")
    columns = [F.col("left").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() != "dedup"]
    return done.select(*columns, F.struct("n_bytes", "n_removed", "n_spans", "removed").alias("dedup"))
