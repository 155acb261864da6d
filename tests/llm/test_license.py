"""The license scan against a brute-force version."""

import math
import random
import re

import pytest

from keystrand.llm.license_scan import NOTICES, PHRASES, posting_lists, scan_licenses
from keystrand.llm.queries import ORACLES

SCHEMA = "doc_id long, text string, token string, held int"


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, notices=NOTICES, threshold=0.8):
    text = text or ""
    words, starts, base, named, best = words_of(text), [], set(), set(), 0.0
    for phrase, label in PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    for notice, label in notices:
        n = set(notice.split())
        width = math.ceil(len(notice.split()) / threshold - 1e-9)
        blocks = [words_of(line) for line in text.split("\n")] + [words[i : i + width] for i in range(len(words))]
        most = max((len(n & set(b)) for b in blocks), default=0)
        if most >= math.ceil(threshold * len(n) - 1e-9):
            named.add(label)
            best = max(best, most / len(n))
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | named)), 1.0 if starts else best)


def fragments(seed):
    """Notices with words lost, put in, wrapped and mixed with other text."""
    rng, out = random.Random(seed), []
    for i in range(120):
        words = rng.choice(NOTICES)[0].split()
        lost, more = rng.choice([0, 0.1, 0.2, 0.3]), rng.choice([0, 0.1, 0.4])
        kept = [w for w in words if rng.random() >= lost]
        mixed = [x for w in kept for x in ([w, f"x{rng.randrange(9)}"] if rng.random() < more else [w])]
        wrapped = "".join(w + ("\n" if rng.random() < 0.1 else " ") for w in mixed)
        before = " ".join(rng.choice(["the", "of", "software", "Été", "gnu general public license", "cc by"]) for _ in range(rng.randrange(30)))
        out.append((i, f"{before}\n{wrapped.title() if i % 3 else wrapped}\n{before}"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_license_scan_is_brute_force(spark, seed):
    rows = fragments(seed) + [(500, None), (501, ""), (502, "\n\n \n"), (503, "cc by " * 20_000), (None, NOTICES[0][0]), (None, None)]
    got = scan_licenses(spark.createDataFrame([(*r, "the", 1) for r in rows], SCHEMA)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted([(id_, *brute(text)) for id_, text in rows], key=key)
    assert len({r["labels"] for r in got if not r["n_base"]}) > 3


def test_license_scan_edges(spark):
    same = [(1, NOTICES[4][0], "a", 1)] * 5 + [(1, "other", "a", 1)]
    got = [tuple(r)[5:] for r in scan_licenses(spark.createDataFrame(same, SCHEMA)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("", "bsd", 1.0)] * 5 + [("", "", 0.0)]))
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
    bare = scan_licenses(spark.createDataFrame(same, SCHEMA), notices=[], phrases=[]).collect()
    assert len(bare) == 6 and {(r["n_base"], r["first_word"], r["labels"], r["score"]) for r in bare} == {(0, None, "", 0.0)}


def test_license_scan_of_many_notices(spark):
    """Thousands of notices as posting lists."""
    rng = random.Random(3)
    notices = [(" ".join(f"w{rng.randrange(4000)}" for _ in range(12)), f"l{i}") for i in range(1500)]
    rows = [(i, "some text\nthen " + notices[i * 37][0].replace(" ", "\n") + " end") for i in range(40)] + [(99, "w1 w2 w3")]
    got = {r["doc_id"]: r["labels"] for r in scan_licenses(spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA), notices=notices).collect()}
    assert got == {id_: brute(text, notices)[5] for id_, text in rows}
    assert len(posting_lists(notices, dict.fromkeys({w for t, _ in notices for w in t.split()}, 0), 0.8)) < 12 * 1500


def test_license_scan_sql_is_brute_force():
    duckdb, pd = pytest.importorskip("duckdb"), pytest.importorskip("pandas")
    rows = [*fragments(4), (500, None), (501, "")]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert sorted(con.execute(ORACLES["op8_license_scan"]).fetchall()) == sorted((id_, *brute(text)) for id_, text in rows)
