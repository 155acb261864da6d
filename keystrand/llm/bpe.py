"""Byte-level BPE encoding and decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import sys

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the splitting pattern of byte-level BPE vocabularies of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts of ASCII alone, in classes that the standard library's faster engine has.
SPLIT_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
#: Pieces whose ids are remembered per Python worker, half of them since the last time that the younger half was full.
CACHE_PIECES = 100_000
#: Pieces of more bytes are merged with a queue, shorter ones by a search for the lowest rank.
SCAN_BYTES = 32


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary strings."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """Encodes and decodes with a byte-level BPE vocabulary file in the tokenizers library's format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.byte_id = [vocab[s] for s in symbols]
        #: pair of ids -> rank << 32 | id of the merged symbol; a lower rank merges first
        self.merges = {(vocab[a], vocab[b]): rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])}
        back = {s: b for b, s in enumerate(symbols)}
        self.strings = {i: bytes(back[ch] for ch in s) for s, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        self.by_id = [self.strings.get(i, b"") for i in range(max(self.strings) + 1)]
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.split, self.split_ascii = regex.compile(SPLIT), re.compile(SPLIT_ASCII)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece.

        Symbols form a doubly linked list; a priority queue holds mergeable neighbours by rank, then
        place.  An entry is stale, and skipped, once either of its symbols has changed.  In a short
        piece the lowest rank, leftmost first, is searched for instead, which merges in the same order.
        """
        ids = [self.byte_id[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        if n <= SCAN_BYTES:
            rank, none = merges.get, 1 << 64
            ranks = [rank(pair, none) for pair in zip(ids, ids[1:])]
            while ranks and (m := min(ranks)) != none:
                i = ranks.index(m)
                ids[i] = m & 0xFFFFFFFF
                del ids[i + 1], ranks[i]
                if i < len(ranks):
                    ranks[i] = rank((ids[i], ids[i + 1]), none)
                if i:
                    ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            m, i, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = m & 0xFFFFFFFF, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := merges.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(queue, (x, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (x := merges.get((ids[h], ids[i]))) is not None:
                heapq.heappush(queue, (x, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            ids = self.merge(piece.encode())
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self.cache) >= CACHE_PIECES // 2:
                self.older, self.cache = self.cache, {}
            self.cache[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.split_added.split(text) if self.split_added else [text]
        out: list[bytes] = []
        piece = self._piece
        split = self.split_ascii if text.isascii() else self.split
        for k, part in enumerate(parts):
            if k % 2:
                out.append(struct.pack("<I", self.added[part]))
            elif part:
                out += [self.cache.get(x) or piece(x) for x in split.findall(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Concatenates the vocabulary strings of the ids; ids out of the vocabulary give nothing."""
        codes, table = memoryview(ids).cast("I"), self.by_id
        try:
            return b"".join([table[i] for i in codes]).decode("utf-8", "replace")
        except IndexError:
            return b"".join([self.strings.get(i, b"") for i in codes]).decode("utf-8", "replace")


def worker_bpe(path: str) -> Bpe:
    """One coder per Python worker and path, kept across tasks."""
    kept = sys.__dict__.setdefault("_keystrand_bpe", {})
    if path not in kept:
        kept[path] = Bpe(path)
    return kept[path]


def encode_decode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes it again.

    ``path`` is a vocabulary file of the tokenizers library, readable at the same place on every
    executor.  Strings of added tokens in a text become those tokens, as that library does by
    default.  Result per row: ``id, n_tokens, ids_sha256, decoded_sha256`` and with ``with_ids``
    also ``ids array<int>`` and ``decoded string``.  Null texts count as empty; empty texts have no
    tokens; repeated rows are kept; empty tables give an empty result; other columns are not read.
    A map over rows: no shuffle, and memory is bounded by one batch, a long text and the piece cache.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches):
        bpe = worker_bpe(path)
        for b in batches:
            n, ids_sha, text_sha, ids_out, texts = [], [], [], [], []
            for text in b.column(1):
                ids = bpe.encode(text.as_py() or "")
                decoded = bpe.decode(ids)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    ids_out.append(memoryview(ids).cast("I").tolist())
                    texts.append(decoded)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
