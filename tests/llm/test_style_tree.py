import math

import pytest

from keystrand.llm.site_style_tree import _key, _text_key, extract_main_text, style_importance

PAGES = "page_id long, url string, html string"


def test_importances_by_hand(spark):
    # the menu has two styles, its words recur; the text of the body differs but for one word
    menu = lambda i: "<ul><li>home<li>news</ul>" if i < 6 else "<ul><li>home</ul>"
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<div>{menu(i)}<p>text{i} word</p></div>") for i in range(8)], PAGES)
    got = {r["node"]: r for r in style_importance(pages).collect()}
    li = 1 - (math.log(8) + math.log(6)) / 2 / math.log(8)
    p = 1 - 1 / 9
    assert got[_text_key("/div/ul/li")]["importance"] == pytest.approx(li) and got[_text_key("/div/p")]["importance"] == pytest.approx(p)
    entropy = lambda *n: -sum(x / sum(n) * math.log(x / sum(n)) for x in n) / math.log(sum(n))
    ul = (1 - 0.81) * entropy(6, 2) + 0.81 * 0.9 * li
    assert got[_key("/div/ul")]["importance"] == pytest.approx(ul, abs=1e-5)
    assert got[_key("/div")]["importance"] == pytest.approx(0.9 * (ul + 0.9 * p) / 2, abs=1e-5)
    assert {n for n, r in got.items() if r["noisy"]} == {_text_key("/div/ul/li"), _key("/div/ul/li"), _key("/div/ul")}


def test_shared_words_make_text_noisy_on_pages_without_an_article(spark):
    # every page has a line of its own order, of the words of all others: no two contents are equal
    words = "home news sport contact about".split()
    line = lambda i: " ".join(words[i % 5 :] + words[: i % 5])
    rows = [(i, f"http://h/{i}", f"<div id=top><p>{line(i)}</p></div><div id=body><p>own{i} text{i}</p></div>") for i in range(5)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"own{i} text{i}" for i in range(5)}
