import collections
import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrand.llm.bpe import encode_decode
from keystrand.llm import common, rindex_dedup, shingles, tgm_jaccard
from keystrand.llm.common import components
from keystrand.llm.covertree_topk import top_k
from keystrand.llm.itq_dedup import embedding_dedup
from keystrand.llm.license_scan import scan_licenses
from keystrand.llm.pareto_mix import mix_sources
from keystrand.llm.quality_pu import estimate_prior, score_quality, train_quality
from keystrand.llm.rindex_dedup import RunLengthIndex, dedup_substrings
from keystrand.llm.site_style_tree import extract_main_text
from keystrand.llm.tgm_jaccard import jaccard_components
from keystrand.llm.url_rules import judge_urls, rules_frame

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string"


def docs(spark, texts):
    return spark.createDataFrame([(i, x, "en", f"s{i % 3}" if i % 7 else None, len(x or ""), "own") for i, x in texts], DOC)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(1, 120)) for _ in range(25)]
    shared, out = words(rng, 30), []
    for i, x in enumerate(base):
        out.append(x)
        w = x.split()
        if len(w) > 20:
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        if i % 3 == 0:
            out.append(x[: len(x) // 2] + " " + shared + " " + x[len(x) // 2 :])
    out += [None, "", "   ", "one", base[0], base[0], "aaaa" * 120, "aaaa" * 90, "é" * 150 + " " + shared]
    return list(enumerate(out))


def sets(texts):
    out = {}
    for i, x in texts:
        w = (x or "").encode().lower().split()
        out[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return out


@pytest.mark.parametrize("per_task", [1, 500_000])
def test_components_of_many_forests(spark, monkeypatch, per_task):
    monkeypatch.setattr(common, "TASK_LINKS", per_task)
    links = [(i, i + 1) for i in range(10, 60)] + [(60, 3), (7, 8), (8, 8), (None, 9)]
    got = dict(map(tuple, common.components(spark.createDataFrame(links, "u long, v long").repartition(5)).collect()))
    assert got == {**dict.fromkeys([3, *range(10, 61)], 3), 7: 7, 8: 7}


def test_components(spark):
    links = [(i, i + 1) for i in range(50) if i % 10 != 9] + [(100, 5), (None, 3), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).distinct().collect()))
    assert got[9] == 0 and got[100] == 0 and got[19] == 10


def test_jaccard_against_brute_force(spark):
    texts = corpus()
    s, parent = sets(texts), {i: i for i, _ in texts}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in s:
        for b in s:
            if a < b and s[a] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs(spark, texts)).collect()}
    assert got == {i: (len(s[i]), find(i)) for i in s}
    assert jaccard_components(docs(spark, [])).count() == 0


def components_by_brute_force(texts):
    s, parent = sets(texts), {i: i for i, _ in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in s}


def loose_copies(rng, m, n, low, high):
    """``m`` texts of ``n`` words that differ from one base in places of their own, mostly just under the threshold."""
    base, out = words(rng, n).split(), []
    while len(out) < m:
        w = list(base)
        for k in rng.sample(range(n), rng.randint(low, high)):
            w[k] = f"changed{rng.random()}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("blocks", [300, 1 << 20])
def test_jaccard_of_loose_groups(spark, monkeypatch, blocks):
    monkeypatch.setattr(tgm_jaccard, "BLOCK_TOKENS", blocks)
    rng = random.Random(8)
    texts = [*loose_copies(rng, 60, 120, 1, 4), *loose_copies(rng, 40, 60, 0, 3), *loose_copies(rng, 10, 30, 0, 2), *(words(rng, 40) for _ in range(20))]
    texts += texts[:5]
    rng.shuffle(texts)
    texts = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs(spark, texts)).collect()}
    assert got == components_by_brute_force(texts)


def test_matrix_rows_grow_with_the_tokens(spark, monkeypatch):
    seen = []
    real = tgm_jaccard._open_groups

    def counted(*a):
        found = real(*a)
        seen[-1].append(found.count())
        return found

    monkeypatch.setattr(tgm_jaccard, "_open_groups", counted)
    for m in (40, 80, 160):
        seen.append([])
        texts = list(enumerate(loose_copies(random.Random(3), m, 200, 4, 4)))
        assert {r["component_id"] for r in jaccard_components(docs(spark, texts)).collect()} == {x[1] for x in components_by_brute_force(texts).values()}
    assert all(x[0] <= 4 * m for x, m in zip(seen, (40, 80, 160), strict=True)), seen


def test_words_hash_apart():
    one = "0"
    for _ in range(10):
        one += one.translate(str.maketrans("01", "10"))
    two = one.translate(str.maketrans("01", "10"))
    got = shingles.word_hashes(f"{one} {two} {one} a b ab {'x' * 300_000} \x0b {'x' * 300_001} A".encode())
    assert len(got) == 9 and len(set(got.tolist())) == 7 and got[0] == got[2] and got[3] == got[8]


@pytest.mark.parametrize("spans", [3, 4096])
def test_substrings_against_brute_force(spark, monkeypatch, spans):
    rng = random.Random(9)
    line = words(rng, 40)
    long = " ".join(words(rng, 300) + " " + line for _ in range(350))  # over the size of a piece
    hot = [words(rng, 3) + " " + line + " " + words(rng, 3) for _ in range(30)]
    texts, seen, expected = list(enumerate([*(x for _, x in corpus()), long, long[1000:9000], *hot])), set(), {}
    for i, x in texts:
        b = (x or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(b[k : k + 100])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        expected[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    monkeypatch.setattr(rindex_dedup, "INDEX_SPANS", spans)
    monkeypatch.setattr(rindex_dedup, "PART_BYTES", 5000)
    got = {r[0]: tuple(r)[1:] for r in dedup_substrings(docs(spark, texts)).collect()}
    assert got == expected
    assert dedup_substrings(docs(spark, [])).count() == 0
    kept = dedup_substrings(docs(spark, texts).withColumn("dedup", F.lit(1)), keep=True)
    assert kept.columns[:-1] == DOC.replace(" string", "").replace(" long", "").split(", ") and kept.columns[-1] == "dedup"
    assert sorted(len((r["text"] or "").encode()) for r in kept.collect()) <= sorted(x[0] - x[1] for x in expected.values())


def test_run_length_index_marks_earlier_matches():
    rng = random.Random(5)
    one = bytes(rng.choice(b"ab") for _ in range(140))
    spans = [one, b"x" + one[10:130], bytes(rng.choice(b"cd") for _ in range(110))]
    index = RunLengthIndex(spans, 100)
    hits = {(k, s) for ks, ss in index.has_earlier(np.array([len(x) for x in spans]), 100) for k, s in zip(ks.tolist(), ss.tolist(), strict=True)}
    assert hits == {(1, s) for s in range(1, 22)}


def test_bpe_against_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    texts = [*corpus(), (900, "It's  a <|endoftext|>test\n\n 123 ünï 漢字 🙂\t  "), (901, "<|endoftext|>"), (902, "x" * 5000)]
    got = {r["doc_id"]: r for r in encode_decode(docs(spark, texts), path).collect()}
    for i, x in texts:
        ids = lib.encode(x or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((x or "").encode()).hexdigest()


def test_mix_nears_targets_and_repeats(spark):
    rng = random.Random(2)
    texts = [(i, words(rng, rng.randint(0, 60))) for i in range(400)]
    rows = mix_sources(docs(spark, texts)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix_sources(docs(spark, texts)).collect()))
    taken, target = collections.Counter(), {}
    for r in rows:
        source = f"s{r['doc_id'] % 3}" if r["doc_id"] % 7 else None
        taken[source] += r["taken"]
        target[source] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    for s, x in target.items():
        assert abs(taken[s] - x) <= 0.002 * x + 1
    assert abs(sum(target.values()) - sum(r["size"] for r in rows)) < 1e-6
    assert mix_sources(docs(spark, [])).count() == 0
    assert [r["taken"] for r in mix_sources(docs(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_mix_of_few_large_documents(spark):
    """First fit in the Pareto order: what stays out does not fit; ties, repeated rows and extra columns do no harm."""
    rows = [(i, "w " * n, "a", n, "own") for i, n in enumerate([900, 400, 313, 40, 40, 7, 3, 2000, 1500, 120, 90, 60, 33])]
    rows += [(50, "w " * 6000, "b", 0, None), (60, None, None, 0, None), (61, "w w", None, 0, None), (61, "w w", None, 0, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, mix long, size string")
    mixed = mix_sources(d).collect()
    assert len(mixed) == len(rows)
    for source, own in (("a", range(13)), ("b", [50]), (None, [60, 61])):
        of = [r for r in mixed if r["doc_id"] in own]
        missing = of[0]["target"] - sum(r["taken"] for r in of)
        copies = of[0]["target"] // of[0]["source_size"]
        out = [r["size"] for r in of if r["size"] and r["taken"] == copies * r["size"]]
        assert missing <= max(0.002 * of[0]["target"], 0) or all(x > missing for x in out)
        assert missing >= 0 or all(-missing < x for x in out)
        assert all(r["taken"] <= 3 * r["size"] for r in of)
    kept = mix_sources(d, keep=True)
    assert kept.columns == ["doc_id", "text", "source", "size", "mix"]
    assert sorted((r["doc_id"], r["mix"]["taken"]) for r in kept.collect()) == sorted((r["doc_id"], r["taken"]) for r in mixed)


def test_url_rules(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
    urls = ["http://a.example.com/en/1", "https://WWW.Example.com/en/x?q#f", "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/en", "http://example.com", None, "nothing", "http://com/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id long, url string, rule string")
    got = [(r["page_id"], r["host"], r["rule"], r["verdict"]) for r in judge_urls(pages, rules_frame(spark, rules)).orderBy("page_id").collect()]
    assert got == [
        (0, "a.example.com", "example.com/en/", "block"),
        (0, "a.example.com", "example.com/en/", "block"),
        (1, "www.example.com", "www.example.com/en/", "allow"),
        (2, "notexample.com", "com/", "allow"),
        (3, "x.net", "net/es/", "block"),
        (4, "x.net", None, "allow"),
        (5, "example.com", None, "allow"),
        (6, "", None, "allow"),
        (7, "", None, "allow"),
        (8, "com", "com/", "allow"),
    ]


def test_license_scan(spark):
    notice = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    texts = [(1, "x CC-BY cc by cc by. MIT LICENSE"), (2, f"a\n{notice}\nb"), (3, None), (4, "committed by cc bye mit licenses")]
    got = {r["doc_id"]: tuple(r)[1:] for r in scan_licenses(docs(spark, texts)).collect()}
    assert got[1] == (9, 4, 1, 7, "cc-by,mit", "cc-by,mit", 1.0)
    assert got[2][4:] == ("", "bsd", 1.0)
    assert got[3] == (0, 0, None, None, "", "", 0.0) and got[4][1] == 0


def test_license_scan_of_wrapped_notices(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:"
    mit = "# Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated\n# documentation files (the Software)"
    rest = "IN NO EVENT SHALL THE COPYRIGHT\nOWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,\nSPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT\nLIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,\nDATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
    far = "\n".join(w + " other" * 30 for w in bsd.split())
    filler = "some words before\n" * 40
    texts = [(1, filler + bsd + "\n" + filler), (2, mit), (3, rest), (4, far), (5, bsd.replace("provided", "changed").replace("met", "so met"))]
    got = {r["doc_id"]: tuple(r)[6:] for r in scan_licenses(docs(spark, texts)).collect()}
    assert got[1] == ("bsd", 1.0) and got[2] == ("mit", 1.0) and got[3] == ("bsd", 1.0) and got[4] == ("", 0.0)
    assert got[5][0] == "bsd" and 0.8 <= got[5][1] < 1


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((120, 16))
    x[60:80] = x[0] + 0.05 * rng.standard_normal((20, 16))
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] + [1.0] * 15), (503, [None] * 16)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    got = {r["vec_id"]: r for r in embedding_dedup(vectors).collect()}
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * (link.sum() - 120)
    assert all(got[i]["component_id"] == 0 for i in range(60, 80)) and got[501]["kept"] and len(got) == 124
    ints = np.floor(64 * x)
    expected = [(q, k + 1, i, int(s)) for q in range(0, 120, 20) for k, (s, i) in enumerate(sorted(((-(ints[q] @ ints[i]), i) for i in range(120) if i != q))[:20]) for s in [-s]]
    assert sorted(map(tuple, top_k(vectors).collect())) == sorted(expected)


@pytest.mark.parametrize("case", ["hot group", "skewed spectrum", "at the threshold", "few dimensions"])
def test_vector_links_recall(spark, case):
    rng = np.random.default_rng(5)
    d = 4 if case == "few dimensions" else 32
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)

    def near(v, low, high):
        side = rng.standard_normal(v.shape)
        cos = rng.uniform(low, high, (len(v), 1))
        return cos * v + np.sqrt(1 - cos**2) * unit(side - (side * v).sum(1, keepdims=True) * v)

    x = unit(rng.standard_normal((800, d)) / (np.arange(1, d + 1) if case == "skewed spectrum" else 1))
    more = {"hot group": lambda: near(np.repeat(x[:1], 400, 0), 0.95, 0.99), "at the threshold": lambda: near(x[:400], 0.9, 0.92)}
    x = np.concatenate([x, more[case]()]) if case in more else x
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    links = (x @ x.T >= 0.9).sum() - len(x)
    found = embedding_dedup(vectors).agg({"n_links": "sum"}).first()[0]
    assert 0.9 * links <= found <= links


def test_main_text(spark):
    page = '<html><head><title>t</title></head><body><nav><a>m</a></nav><header>h</header><article><h1>A &amp; b</h1><p><b>One\n two<br><p>x<script>"</p>"</script>y</p><div class="comments"><p>no</p></div></article><aside>s</aside><footer>f</footer></body>'
    rows = [(1, "http://a/1", page), (2, "http://a/2", None), (3, None, "<p>plain"), (4, "http://a/3", "")]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "A & b\nOne two\nxy", 2: "", 3: "plain", 4: ""}
    # a low-importance node of a host goes, its text elsewhere stays
    rows = [(i, f"http://h/{i}", f"<body><div id=promo1x><p>same words</p></div><div id=body><p>text {i}</p></div>") for i in range(8)]
    got = [r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got) == [f"text {i}" for i in range(8)]


def test_quality_orders_held_out_rows(spark):
    rng = random.Random(4)
    texts = [(i, words(rng, 50) if i % 4 else "$$$ ".join(words(rng, 50).upper().split())) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 600, 3)], "doc_id long, quality int")
    d = docs(spark, [*texts, (1000, None), (1001, "")])
    got = {r["doc_id"]: r for r in score_quality(d, train_quality(d, labels)).collect()}
    hit = [got[i]["predicted"] == int(i % 4 > 0) for i in range(600) if got[i]["held_out"]]
    assert sum(hit) >= 0.95 * len(hit) and 0 <= got[1000]["score"] <= 1
    assert train_quality(d, labels.limit(0)) is None


def test_quality_learns_no_negative_label(spark):
    rng = random.Random(4)
    good = lambda i: words(rng, 50) if i % 4 else "$$$ ".join(words(rng, 50).upper().split())
    d = docs(spark, [*((i, good(i)) for i in range(900)), (3, "another text of this id"), (5, None), (2000, "x " * 200_000)])
    labels = [(i, int(i % 4 > 0)) for i in range(900)]
    own = spark.createDataFrame(labels, "doc_id long, quality int")
    hidden = spark.createDataFrame([(i, q or None) for i, q in labels], "doc_id long, quality int")
    one, two = (train_quality(d, x) for x in (own, hidden))
    assert np.array_equal(one.w, two.w) and np.array_equal(one.w, train_quality(d.repartition(7), own).w)
    got = score_quality(d, one).collect()
    assert len(got) == 903
    hit = [r["predicted"] == int(r["doc_id"] % 4 > 0) for r in got if r["held_out"] and r["doc_id"] not in (3, 5, 2000)]
    assert sum(hit) >= 0.95 * len(hit)
    clash = d.withColumnRenamed("score", "quality_score")
    kept = score_quality(clash, one, keep=True)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "quality_score"] and kept.where("quality_score between 0 and 1").count() == 903
    assert score_quality(d.limit(0), one).count() == 0


def test_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(2)
    draw = lambda n, at: (rng.standard_normal((n, 6)) + at).astype(np.float32)
    for prior in (0.3, 0.6, 0.85):
        n = int(4000 * prior)
        found = estimate_prior(draw(2000, 1.5), np.concatenate([draw(n, 1.5), draw(4000 - n, -1.5)]))
        assert abs(found - prior) < 0.06


def test_main_text_keeps_what_only_sounds_like_furniture(spark):
    inside = '<h1 class="post-header">Head</h1><div class="article-header"><h2>Sub</h2></div><div class="social-history"><p>Past</p></div><p>x <math><mi>y</mi></math></p>'
    gone = '<div class="share-buttons">Share</div><div class="ad">Ad</div><ul class="related links"><li>More</li></ul>'
    pages = [(1, "http://a/1", f"<body><nav>n</nav><article>{inside}{gone}</article></body>"), (1, "http://a/1", "<p>" + "long " * 200_000)]
    got = [r["text"] for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()]
    assert sorted(got, key=len)[0] == "Head\nSub\nPast\nx y" and len(max(got, key=len)) == 5 * 200_000 - 1
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_top_k_ties_repeats_and_range(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(60)] + [(7, [1.0, 1.0]), (3, None)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    ints = {i: (64 * (i % 3), 64) for i in range(60)}
    for q in (0, 20, 40):
        order = sorted((-(ints[q][0] * v[0] + ints[q][1] * v[1]), i) for i, v in ints.items() if i != q)[:20]
        assert [(r["vec_id"], -r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(i, s) for s, i in order]
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    with pytest.raises(Exception, match="62 bits"):
        top_k(spark.createDataFrame([(0, [1e300, 1.0]), (60, [1e300, 2.0])], "vec_id long, embedding array<double>")).collect()
