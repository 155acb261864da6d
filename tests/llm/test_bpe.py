import random

import pytest

from keystrand.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("byte_bpe_50k.json")


def test_a_piece_in_use_is_merged_once(path, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 8)
    coder, merged = bpe.Bpe(path), []
    monkeypatch.setattr(coder, "merge", lambda data, merge=coder.merge: merged.append(data) or merge(data))
    for i in range(40):
        coder.encode(f" often word{i}")
    assert merged.count(b" often") == 1 and len(coder.cache) + len(coder.older) <= 8


def test_scan_and_queue_merge_alike(path, monkeypatch):
    coder, rng = bpe.Bpe(path), random.Random(5)
    pieces = [bytes(rng.choice(b" aehinorst") for _ in range(rng.randint(0, 32))) for _ in range(2000)] + [b"a" * n for n in range(33)]
    short = [coder.merge(p) for p in pieces]
    monkeypatch.setattr(bpe, "SCAN_BYTES", 0)
    assert short == [coder.merge(p) for p in pieces]


def test_ascii_texts_split_alike(path):
    coder, rng = bpe.Bpe(path), random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice([chr(rng.randrange(128)), *" \n\t\x1c\x1fa1'", "'s", "'re"]) for _ in range(rng.randint(0, 40)))
        assert coder.split_ascii.findall(text) == coder.split.findall(text)
