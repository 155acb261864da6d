"""The pipeline, stage by stage, against brute force over what the stage before it kept."""

import collections
import hashlib
import random
import struct

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from keystrand.llm.common import table  # noqa: E402
from keystrand.llm.quality_pu import score_quality, train_quality  # noqa: E402

from test_llm import components_by_brute_force, words  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long, quality_score string, mix int"


def without_repeats(texts):
    seen, out = set(), {}
    for i, x in texts:
        b = (x or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(b[k : k + 100])
        out[i] = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_stages_against_brute_force(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    rng = random.Random(6)
    shared = words(rng, 40)
    texts = []
    for i in range(160):
        x = words(rng, rng.randint(20, 90))
        texts.append(x if i % 5 else "$$$ ".join(x.upper().split()))
        if i % 7 == 1:
            w = x.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        if i % 9 == 2:
            texts.append(x + " " + shared + " " + words(rng, 12))
    texts += [None, "", texts[1], "é" * 150]
    rows = [(i, x, "en", f"s{i % 3}" if i % 11 else None, len(x or ""), "own", 7) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(not (x or "").startswith(("$$$", *"ABCDEFGH")) and bool(x)), 0) for i, x in enumerate(texts) if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, str(tmp_path), "documents")
    stage = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "mix", "bpe"]

    def reread(name, df):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    kept = reread("quality", stage["quality"](spark, docs, str(tmp_path)))
    scores = score_quality(docs, train_quality(docs, table(spark, str(tmp_path), "labels")))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in scores.where("score >= 0.5").collect()}

    one = reread("near", stage["near_duplicates"](spark, kept, str(tmp_path)))
    groups = components_by_brute_force([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert one.columns == docs.columns
    assert sorted(map(tuple, one.collect()), key=lambda r: r[0]) == sorted((tuple(r) for r in kept.collect() if groups[r["doc_id"]][1] == r["doc_id"]), key=lambda r: r[0])

    cut = reread("cut", stage["substrings"](spark, one, str(tmp_path)))
    expected = without_repeats(sorted((r["doc_id"], r["text"]) for r in one.collect()))
    assert cut.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()} == {i: (x, len(x)) for i, x in expected.items()}

    mixed = reread("mix", stage["mix"](spark, cut, str(tmp_path)))
    assert mixed.columns == docs.columns
    size = lambda x: len(x.split())
    taken = collections.Counter(r["doc_id"] for r in mixed.collect())
    own = {r["doc_id"]: r for r in cut.collect()}
    assert set(taken) <= set(own) and max(taken.values()) <= 3
    total = sum(size(r["text"]) for r in own.values())
    assert abs(sum(size(own[i]["text"]) * n for i, n in taken.items()) - total) <= 0.05 * total

    encoded = {r["doc_id"]: r for r in stage["bpe"](spark, mixed, str(tmp_path)).collect()}
    lib = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert set(encoded) == set(taken)
    for i, r in encoded.items():
        ids = lib.encode(own[i]["text"], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())

    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, stage["bpe"](spark, mixed, str(tmp_path)).collect()))
