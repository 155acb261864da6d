"""Main-text extraction with a site style tree per host."""

from __future__ import annotations

import hashlib
import html as html_lib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width
from .url_rules import host_of

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas textarea select title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body head html option tbody td tfoot th thead tr caption legend".split())
NOISE_TAGS = frozenset("nav header footer aside form menu dialog button label fieldset search head".split())
# Words in class, id or role that name page furniture.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus"
    " breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets cookie cookies consent gdpr notice notices popup modal overlay"
    " newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies"
    " respond pagination pager toolbar form search complementary contentinfo".split()
)
# Words that say nothing more about an element whose other words name furniture.
GENERIC_WORDS = frozenset("area bar block body bottom box button buttons container content group inner item items left link links list panel right section slot top unit wrap wrapper".split())
ARTICLE_WORDS = frozenset("article main content post entry story".split())

_MARK = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=\s|$|=)|aria-hidden\s*=\s*["']?true)""", re.I)


class Block:
    """A run of text that block elements delimit.

    ``path``: its node in the style tree; ``inside``: it is in an article; ``plain``: no element
    between it and the article has a class, id or role; ``element``: its element's place in the page's tree.
    """

    __slots__ = ("path", "inside", "plain", "element", "parts")

    def __init__(self, path, inside, plain, element):
        self.path, self.inside, self.plain, self.element, self.parts = path, inside, plain, element, []

    @property
    def judged(self) -> bool:
        """Whether the style tree decides on it: plain article text always stays."""
        return not (self.inside and self.plain)

    def text(self) -> str:
        return " ".join(html_lib.unescape("".join(self.parts)).split())


#: Within an article these belong to it.
_PART_OF_ARTICLE = frozenset(("header", "masthead"))


def _furniture_inside(names: list[str]) -> bool:
    """Whether one of the names, inside an article, is of furniture words alone; ``post-header`` or ``social-history`` are not."""
    for name in names:
        for token in name.split():
            words = set(_WORDS.findall(token))
            if words & NOISE_WORDS - _PART_OF_ARTICLE and words <= NOISE_WORDS | GENERIC_WORDS:
                return True
    return False


def _signature(tag: str, attrs: str) -> tuple[str, set[str], list[str]]:
    names: list[str] = []
    for m in _NAMES.finditer(attrs):
        names.append(re.sub(r"\d+", "#", (m[2] or m[3] or m[4] or "").lower()))
    words = {w for n in names for w in _WORDS.findall(n)}
    return tag + "".join(f".{n.strip()}" for n in names if n.strip()), words, names


def parse_blocks(page: str, tree: list | None = None) -> tuple[list[Block], bool]:
    """Text blocks of a page in page order, without furniture, and whether it has an article.

    ``tree`` takes the page's block elements outside furniture, each as its path, its parent's place in the
    list and its children: places of elements, and blocks.
    Open elements are kept on a stack of (tag, style path, furniture, article, plain, place in the tree).  Furniture is what
    its element or its class, id or role names as such; within an article, ``header`` is part of it, and
    a name must be of furniture words alone.
    A ``p`` ends where a block begins; an end tag closes its element and those opened inside it.
    """
    stack: list[tuple[str, str, bool, bool, bool, int]] = [("", "", False, False, True, 0)]
    if tree is not None:
        tree.append(("", -1, []))
    blocks: list[Block] = []
    fresh, has_article, at, end = True, False, 0, len(page)

    def add(data: str) -> None:
        nonlocal fresh
        _, path, noise, inside, plain, element = stack[-1]
        if noise or not data:
            return
        if fresh:
            blocks.append(Block(path, inside, plain, element))
            if tree is not None:
                tree[element][2].append(blocks[-1])
            fresh = False
        blocks[-1].parts.append(data)

    while at < end:
        m = _MARK.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if page.startswith("<![CDATA[", m.start()):
                add(page[m.start() + 9 : at].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    fresh = fresh or any(x[0] in BLOCK for x in stack[k:])
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "body") and tag not in BLOCK:
                    break
            fresh = fresh or tag in BLOCK
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            if tag in BLOCK:
                fresh = True
            continue
        if tag in BLOCK:
            fresh = True
            if tag in CLOSES_P:
                # a block ends the open paragraph, with the inline elements left open in it
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCK:
                        break
            same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag)
            if same and stack[-1][0] in same:
                stack.pop()
        if tag in VOID:
            continue
        sig, words, names = _signature(tag, m[3]) if m[3] and "=" in m[3] else (tag, (), [])
        _, path, noise, inside, plain, element = stack[-1]
        article = tag in ("article", "main") or tag in ("div", "section") and not inside and bool(ARTICLE_WORDS & set(words)) and not NOISE_WORDS & set(words)
        if article and not noise:
            has_article = True
        noise = (
            noise
            or (tag in NOISE_TAGS and not (tag == "header" and inside))
            or (tag not in ("html", "body", "article", "main") and bool(words) and (_furniture_inside(names) if inside else bool(NOISE_WORDS & set(words))))
            or (bool(m[3]) and bool(_HIDDEN.search(m[3])) and tag not in ("html", "body"))
        )
        if article and inside and any(x[0] == "article" for x in stack) and tag == "article":
            noise = True  # an article within an article is a reader comment
        plain = article and not inside or plain and (tag not in BLOCK or sig == tag)
        if tag in BLOCK:
            path = f"{path}/{sig}"
            if tree is not None and not noise:
                tree[element][2].append(len(tree))
                tree.append((path, element, []))
                element = len(tree) - 1
        stack.append((tag, path, noise, inside or article, plain, element))
    return blocks, has_article


def _key(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _text_key(path: str) -> int:
    """The leaf of the style tree that the text directly in an element is."""
    return _key(path, "#text")


def _page_rows(page: str):
    """What a page adds to its host's tree: ``node, parent, depth, kind, item, share``."""
    tree: list = []
    parse_blocks(page, tree)
    texts = [{x: t for x in children if isinstance(x, Block) and (t := x.text())} for _, _, children in tree]
    keys = [_key(path) for path, _, _ in tree]
    depths, once, shares = [0] * len(tree), {}, [SHARE] * len(tree)
    for i, (path, parent, children) in enumerate(tree):
        children = [x for x in children if not isinstance(x, Block) or x in texts[i]]
        share = SHARE // max(1, len(children))
        for x in children:
            if not isinstance(x, Block):
                shares[x] = share
        if parent >= 0:
            depths[i] = depths[parent] + 1
        style = _key(*("#text" if isinstance(x, Block) else tree[x][0] for x in children))
        yield keys[i], keys[parent] if parent >= 0 else 0, depths[i], STYLE, style, shares[i]
        leaf = _text_key(path)
        for x, text in texts[i].items():
            yield leaf, keys[i], depths[i] + 1, TEXT, 0, share
            once[leaf, keys[i], depths[i] + 1, PAGE if x.judged else PLAIN, 0, 0] = None
            if x.judged:
                once.update(((leaf, keys[i], depths[i] + 1, FEATURE, _key(w), 0), None) for w in text.lower().split())
    yield from once


def _style_rows(batches):
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    for b in batches:
        hosts, rows = [], []
        for host, page in zip(b.column(0), b.column(1), strict=True):
            more = list(_page_rows(page.as_py() or ""))
            hosts += [host.as_py()] * len(more)
            rows += more
        columns = zip(*rows, strict=True) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["host", "node", "parent", "depth", "kind", "item", "share"])


#: Kinds of rows: an element and its style; text; a page with text that the tree judges; a word of it; plain article text.
STYLE, TEXT, PAGE, FEATURE, PLAIN = range(5)
#: The unit of a child's share of its parent, and how fast the weight of the children falls with the styles.
SHARE = 1 << 20
GAMMA = 0.9


def _composite(min_pages: int, min_importance: float):
    """Goes up the trees: rows come by host, deepest nodes first; held are the sums of parents yet to come."""

    def run(batches):
        at, sums, clean = None, {}, set()
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["host"] != at:
                    at, sums, clean = r["host"], {}, set()
                node, text = r["node"], r["times"] == 0
                if text:
                    # plain text of an article always counts; else one minus the mean entropy of the words over the pages
                    m, words = r["pages"], r["words"]
                    imp = 1.0 if r["plain"] or m < 2 or not words else 1 - r["word_logs"] / words / math.log(m)
                    noisy = not r["plain"] and m >= min_pages and imp < min_importance
                else:
                    n = r["times"]
                    own = 1.0 if n < 2 else (math.log(n) - r["nlogn"] / n) / math.log(n)
                    fade = GAMMA ** r["styles"]
                    imp = (1 - fade) * own + fade * sums.pop(node, 0.0) / (SHARE * n)
                    noisy = imp < min_importance and node not in clean
                    clean.discard(node)
                sums[r["parent"]] = sums.get(r["parent"], 0.0) + r["share"] * imp
                if not noisy:
                    clean.add(r["parent"])
                out.append((at, node, text, r["pages"] if text else r["times"], imp, noisy))
            columns = zip(*out, strict=True) if out else [()] * 6
            types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "node", "text", "pages", "importance", "noisy"])

    return run


def style_importance(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", min_pages: int = 5, min_importance: float = 0.3) -> DataFrame:
    """The site style tree of each host: ``host, node, text, pages, importance, noisy``.

    An element node is a path of block elements with their class, id and role; occurrences on the pages
    of a host are merged on it.  Its style nodes are the sequences of its children.  Text directly in an
    element is a leaf (``text``).  Importances are those of the method:

    - a leaf: 1 minus the mean over its words of ln(pages with the word) / ln(pages with the leaf), 1 on one page;
    - the presentation of an element: the entropy of its styles over its n occurrences, to base n; 1 if n is 1;
    - composite: (1 - g^l) presentation + g^l mean importance of the children over the styles as often as they occur,
      for l styles and g 0.9.

    A node is ``noisy`` if its importance and that of all nodes under it is under ``min_importance``; leaves on
    fewer than ``min_pages`` pages are not.  Counts per (host, node, kind, item) are aggregated map-side; only nodes, which follow the templates,
    meet by host, and pass bottom-up as a stream.
    """
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(_style_rows, "host string, node long, parent long, depth int, kind int, item long, share long")
    counts = rows.groupBy("host", "node", "kind", "item").agg(F.count("*").alias("n"), F.sum("share").alias("share"), F.max("parent").alias("parent"), F.max("depth").alias("depth"))
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    nodes = counts.groupBy("host", "node").agg(
        F.max("parent").alias("parent"),
        F.max("depth").alias("depth"),
        F.sum("share").alias("share"),
        F.coalesce(of(STYLE, F.col("n")), F.lit(0)).alias("times"),
        F.count(F.when(F.col("kind") == STYLE, 1)).alias("styles"),
        of(STYLE, F.col("n") * F.ln("n")).alias("nlogn"),
        F.coalesce(of(PAGE, F.col("n")), F.lit(0)).alias("pages"),
        F.count(F.when(F.col("kind") == FEATURE, 1)).alias("words"),
        of(FEATURE, F.ln("n")).alias("word_logs"),
        F.max(F.col("kind") == PLAIN).alias("plain"),
    )
    ordered = nodes.repartition("host").sortWithinPartitions("host", F.desc("depth"), "node")
    return ordered.mapInArrow(_composite(min_pages, min_importance), "host string, node long, text boolean, pages long, importance double, noisy boolean")


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 5, min_importance: float = 0.3) -> DataFrame:
    """Main text of each page: ``id, url, text, n_chars``.

    Page furniture that the markup names (menus, headers, footers, sidebars, adverts, notices,
    forms, comments, scripts, styles) has importance 0 by its presentation, and so has all outside
    the article of a page that has one.  Of what is left, text goes that is noisy in the host's style
    tree: on ``min_pages`` pages or more and of an importance under ``min_importance``.  Plain
    article text (paragraphs, headings, lists without a style of their own) has importance 1 by its
    presentation, whatever it repeats.  Blocks have their character references decoded and white space turned into one space;
    they are joined by one newline in page order.  Null and empty html give an empty text; null
    urls belong to the empty host; repeated rows are kept; empty tables give an empty result; other
    columns are not read.

    Only (host, low node) pairs are joined to the pages: their number follows the number of
    templates, not of pages.
    """
    low = (
        style_importance(pages, url_col=url_col, html_col=html_col, min_pages=min_pages, min_importance=min_importance)
        .where("text AND noisy")
        .groupBy("host")
        .agg(F.collect_list("node").alias("low"))
    )
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    # a hot host is spread by a salt, and its few low nodes are repeated for each salt
    salts = shuffle_width(pages.sparkSession)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int"))
    low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.join(low, ["host", "salt"], "left").select("id", "url", "html", "low")
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = []
            for page, drop in zip(b.column(2), b.column(3), strict=True):
                blocks, has_article = parse_blocks(page.as_py() or "")
                if has_article:
                    blocks = [x for x in blocks if x.inside]
                if drop := set(drop.as_py() or ()):
                    blocks = [x for x in blocks if not x.judged or _text_key(x.path) not in drop]
                texts.append("\n".join(t for x in blocks if (t := x.text())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[id_col, "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, url string, text string, n_chars long")
