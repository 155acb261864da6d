"""Sets of word shingles as sorted 64-bit hashes, computed on whole texts with array operations."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
#: Texts are hashed in pieces of at most this many bytes, cut at white space.
PIECE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of up to this many bytes are hashed together, eight bytes a step; longer ones one by one.
LONG_WORD = 1 << 10


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _digest(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _hash_words(piece: bytes) -> np.ndarray:
    """A hash per word: its length and its bytes, eight at a time, each step scrambled into the next."""
    if len(piece) > PIECE:  # one word longer than a piece
        return np.array([_digest(piece)], np.uint64)
    word = ~_SPACE[np.frombuffer(piece, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    start, size = edge[::2], edge[1::2] - edge[::2]
    # the eight bytes from every place on
    eight = np.ndarray(len(piece) + 1, "<u8", piece + bytes(8), 0, (1,))
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    at, left, place = np.arange(len(start)), size, start
    while len(at):
        unused = (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
        h[at] = mix((h[at] ^ (eight[place] << unused)) * np.uint64(0xD6E8FEB86659FD93))
        more = (left > 8) & (size[at] <= LONG_WORD)
        at, left, place = at[more], left[more] - 8, place[more] + 8
    for k in np.flatnonzero(size > LONG_WORD):
        h[k] = _digest(piece[start[k] : start[k] + size[k]])
    return h


def word_hashes(text: bytes) -> np.ndarray:
    """A hash per word of a text: runs of bytes other than space and 0x09-0x0D, A-Z lower-cased."""
    text = text.lower()
    if len(text) <= PIECE:
        return _hash_words(text)
    out, at = [], 0
    view = np.frombuffer(text, np.uint8)
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text) and not _SPACE[view[end]]:
            back = np.flatnonzero(_SPACE[view[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:  # the piece is inside one word: take the word whole
                while end < len(text) and not _SPACE[view[end]]:
                    ahead = np.flatnonzero(_SPACE[view[end : end + PIECE]])
                    end = end + int(ahead[0]) if len(ahead) else min(len(text), end + PIECE)
                out.append(_hash_words(text[at:end]))
                at = end
                continue
        out.append(_hash_words(text[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; of a shorter text, of all its words as one."""
    if not text:
        return np.zeros(0, np.uint64)
    w = word_hashes(text)
    if not len(w):
        return np.zeros(0, np.uint64)
    k = min(WORDS, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def set_digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
