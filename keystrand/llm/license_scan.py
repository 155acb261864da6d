"""License scan: exact phrase places and an exact containment join against license notices."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, text_or_empty

# Phrases that name a license outright.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Well-known public license notices, clause by clause, with their labels.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under a creative commons attribution international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit"),
    ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit"),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache"),
    ("see the license for the specific language governing permissions and limitations under the license", "apache"),
    ("as published by the free software foundation either version 3 of the license or at your option any later version", "gpl"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gpl"),
    ("you should have received a copy of the gnu general public license along with this program", "gpl"),
    ("to view a copy of this license visit http creativecommons org licenses by 4 0 or send a letter to creative commons po box 1866 mountain view ca 94042 usa", "cc-by"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd"),
    ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "bsd"),
    ("in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption", "bsd"),
    ("however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", "bsd"),
    ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mpl"),
]

#: The posting lists of the notices are broadcast up to this many bytes; beyond it they are joined by a shuffle.
POSTING_BYTES = 32 << 20

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def padded_words(text: Column) -> Column:
    """The lower-cased words of a text with one space before, between and after them."""
    return F.regexp_replace(F.concat(F.lit(" "), ascii_lower(text), F.lit(" ")), NOT_WORD, " ")


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _words_of(text: Column) -> Column:
    return F.split(padded_words(text), " ")


def _distinct_of(tokens: Column, words: list[str]) -> Column:
    """The distinct tokens that are among ``words``; a hash look-up per token, however long the list."""
    return F.filter(F.array_distinct(tokens), lambda w: w.isin(words))


def token_order(docs: DataFrame, words: list[str], text_col: str = "text") -> dict[str, int]:
    """Number of documents that hold each of ``words``, over all documents; one entry per word."""
    held = _distinct_of(_words_of(text_or_empty(F.col(text_col))), words)
    rows = docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    return dict.fromkeys(words, 0) | {r["w"]: r["n"] for r in rows}


def posting_lists(notices: list[tuple[str, str]], order: dict[str, int], threshold: float) -> list[dict]:
    """One entry per prefix word of a notice: ``token, words, prefix, need, width, label``.

    ``words`` are the notice's distinct words, rarest first.  Of two sets that share ``need`` words,
    each holds one of the first ``n - need + 1`` words of the notice, the prefix.
    """
    out = []
    for text, label in notices:
        words = sorted(set(text.split()), key=lambda w: (order[w], w))
        need = max(1, math.ceil(threshold * len(words) - 1e-9))
        entry = {"words": words, "prefix": words[: len(words) - need + 1], "need": need, "width": math.ceil(len(text.split()) / threshold - 1e-9), "label": label}
        out += [{"token": w, **entry} for w in entry["prefix"]]
    return out


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def notice_matches(docs: DataFrame, notices: list[tuple[str, str]], threshold: float) -> DataFrame:
    """Set-similarity join of the blocks of ``docs`` (``id, raw, digest``) with ``notices``: ``id, digest, share, named``.

    A document meets the posting lists by its words of any prefix.  It meets a notice once for each
    prefix word that they share; only the first of them in the notice's order is kept, so pairs are
    distinct without a shuffle, and all of the notice's words before it are known to be missing.
    """
    vocabulary = sorted({w for text, _ in notices for w in text.split()})
    lists = posting_lists(notices, token_order(docs, vocabulary, "raw"), threshold)
    packed = json.dumps(lists)
    schema = "array<struct<token:string,words:array<string>,prefix:array<string>,need:int,width:int,label:string>>"
    index = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(packed), schema)))
    if len(packed) <= POSTING_BYTES:
        index = F.broadcast(index)
    held = docs.withColumn("held", _distinct_of(_words_of(F.col("raw")), vocabulary))
    rare = held.withColumn("rare", F.filter("held", lambda w: w.isin(sorted({x["token"] for x in lists}))))
    met = rare.select("*", F.explode("rare").alias("token")).join(index, "token")
    pairs = met.where(F.col("token") == F.get(F.array_intersect("prefix", "rare"), F.lit(0)))
    # length and positional filter: words of the notice from the first shared one on, in the whole text
    pairs = pairs.where(F.size("words") - F.array_position("words", F.col("token")) + 1 >= F.col("need"))
    pairs = pairs.where(F.size(F.array_intersect("words", "held")) >= F.col("need"))
    places = F.transform(_words_of(F.col("raw")), lambda w, i: F.struct(i.alias("at"), w.alias("w")))
    pairs = pairs.withColumn("hits", F.filter(places, lambda x: x["w"].isin(vocabulary) & F.array_contains("words", x["w"])))

    def in_window(hit: Column, k: Column) -> Column:
        near = F.filter(F.slice("hits", k + 1, F.col("width")), lambda x: x["at"] < hit["at"] + F.col("width"))
        return F.size(F.array_distinct(F.transform(near, lambda x: x["w"])))

    in_line = F.array_max(F.transform(F.split("raw", "\n"), lambda line: F.size(F.array_intersect("words", _words_of(line)))))
    pairs = pairs.withColumn("most", F.greatest(in_line, F.array_max(F.transform("hits", in_window))))
    shares = pairs.where(F.col("most") >= F.col("need")).select("id", "digest", "label", (F.col("most").cast("double") / F.size("words")).alias("share"))
    return shares.groupBy("id", "digest").agg(F.max("share").alias("share"), F.collect_set("label").alias("named"))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES, threshold: float = 0.8) -> DataFrame:
    """Labels documents with the licenses that they name or quote.

    ``base_labels`` come from ``phrases`` whose words stand consecutively.  The method's labels come
    from an exact set-similarity join of text blocks with ``notices``: a block is a match if it holds
    at least ``threshold`` of a notice's distinct words.  Blocks are the lines, and all windows of as
    many consecutive words as the notice has, over ``threshold``; windows run across line breaks, so a
    wrapped notice is found, with words put in or left out up to the threshold.  Words are ordered by
    their document frequency over the whole corpus, rarest first.  Documents join the posting lists of
    the notices' prefix words; length and positional filters leave few pairs, whose lines and windows
    (of the places that hold a word of the notice) are counted exactly.

    Texts are not shuffled: the posting lists are broadcast behind a check of their size, and the
    matches, one row per document that has any, come back to the documents' counts by id and digest of
    the text.  Their rows are spread by document, so a frequent notice or source is no hot key.

    Result per document: ``id, n_words, n_base, first_word, last_word, base_labels, labels, score``.
    ``score`` is 1 with a base label, else the largest containment of a matching block, else 0.
    Null and empty texts have no words; empty tables give an empty result; repeated rows are kept;
    ids may be null; no phrases or notices give no labels; other columns are not read.
    """
    text = text_or_empty(F.col(text_col))
    given = docs.select(F.col(id_col).alias("id"), text.alias("raw"), F.md5(text.cast("binary")).alias("digest"))
    rows = given.select("id", "digest", padded_words(F.col("raw")).alias("norm"))
    rows = rows.withColumn("n_words", F.greatest(_spaces(F.col("norm")) - 1, F.lit(0)).cast("long"))

    counts, firsts, lasts, base = [], [], [], []
    for phrase, label in phrases:
        hit = f" {phrase} "
        here = F.contains("norm", F.lit(hit))
        # a place is the space before the phrase; a zero-width match finds overlapping places too
        counts.append(F.when(here, F.regexp_count("norm", F.lit(f"(?={hit})"))).otherwise(0))
        firsts.append(F.when(here, _spaces(F.substring(F.col("norm"), F.lit(1), F.instr("norm", hit) - 1))))
        after = F.length("norm") - F.instr(F.reverse("norm"), hit[::-1]) - len(hit) + 1
        lasts.append(F.when(here, _spaces(F.substring(F.col("norm"), F.lit(1), after))))
        base.append(F.when(here, F.lit(label)))
    nothing = F.array().cast("array<string>")
    base_rows = rows.select(
        "id",
        "digest",
        "n_words",
        sum(counts, F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.array(F.lit(None).cast("int"), *firsts)).cast("long").alias("first_word"),
        F.array_max(F.array(F.lit(None).cast("int"), *lasts)).cast("long").alias("last_word"),
        F.filter(F.concat(nothing, F.array(*base)), lambda x: x.isNotNull()).alias("base"),
    )
    found = notice_matches(given, notices, threshold).withColumnsRenamed({"id": "found_id", "digest": "found_digest"})
    done = base_rows.join(found, base_rows["id"].eqNullSafe(F.col("found_id")) & (F.col("digest") == F.col("found_digest")), "left")
    return done.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        _joined(F.col("base")).alias("base_labels"),
        _joined(F.concat("base", F.coalesce("named", nothing))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
