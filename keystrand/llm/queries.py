"""Queries ``opN_*`` over the whole tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode
from .common import table
from .covertree_topk import top_k
from .itq_dedup import embedding_dedup
from .license_scan import NOTICES, PHRASES, scan_licenses
from .pareto_mix import mix_sources
from .quality_pu import score_quality, train_quality
from .rindex_dedup import dedup_substrings
from .site_style_tree import extract_main_text
from .tgm_jaccard import jaccard_components
from .url_rules import judge_urls, rules_frame

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def op2_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op5_rindex_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark, URL_RULES))


def op7_covertree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_tgm_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_pu": op1_quality_pu,
    "op2_itq_dedup": op2_itq_dedup,
    "op3_bpe": op3_bpe,
    "op4_pareto_mix": op4_pareto_mix,
    "op5_rindex_dedup": op5_rindex_dedup,
    "op6_url_rules": op6_url_rules,
    "op7_covertree_topk": op7_covertree_topk,
    "op8_license_scan": op8_license_scan,
    "op9_site_style_tree": op9_site_style_tree,
    "op10_tgm_jaccard": op10_tgm_jaccard,
}
_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_PHRASES_SQL = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES)
_AHEAD_SQL = "".join(f", lead(word, {k}) OVER (PARTITION BY rid ORDER BY pos)" for k in range(1, max(len(p.split()) for p, _ in PHRASES)))
_NOTICES_SQL = ", ".join(f"({i}, {n.split()}, '{label}')" for i, (n, label) in enumerate(NOTICES))
_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS_SQL = rf"regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES: dict[str, str] = {
    "op8_license_scan": f"""
WITH docs AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {_WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents
),
phrases(p, label) AS (VALUES {_PHRASES_SQL}),
notices AS (
    SELECT n, label, list_distinct(words) AS words, len(list_distinct(words)) AS size,
        CAST(ceil(0.8 * len(list_distinct(words)) - 1e-9) AS BIGINT) AS need, CAST(ceil(len(words) / 0.8 - 1e-9) AS BIGINT) AS width
    FROM (VALUES {_NOTICES_SQL}) v(n, words, label)
),
tokens AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs),
ahead AS (SELECT rid, word, pos - 1 AS pos, [word{_AHEAD_SQL}] AS following FROM tokens),
places AS (SELECT rid, label, pos FROM ahead JOIN phrases ON word = p[1] AND following[1:len(p)] = p),
base AS (
    SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY rid
),
notice_words AS (SELECT n, unnest(words) AS word FROM notices),
hits AS MATERIALIZED (SELECT rid, n, word, pos FROM tokens JOIN notice_words USING (word)),
maybe AS MATERIALIZED (
    SELECT rid, n FROM hits JOIN notices USING (n) GROUP BY rid, n HAVING count(DISTINCT word) >= min(need)
),
kept AS MATERIALIZED (SELECT rid, n, word, pos, width FROM hits SEMI JOIN maybe USING (rid, n) JOIN notices USING (n)),
windows AS (
    SELECT a.rid, a.n, count(DISTINCT b.word) AS held FROM kept a JOIN kept b ON a.rid = b.rid AND a.n = b.n AND b.pos >= a.pos AND b.pos < a.pos + a.width
    GROUP BY a.rid, a.n, a.pos
),
lines AS (SELECT rid, n, words, unnest(string_split(t, chr(10))) AS line FROM maybe JOIN docs USING (rid) JOIN notices USING (n)),
blocks AS (
    SELECT rid, n, held FROM windows
    UNION ALL SELECT rid, n, len(list_intersect(words, {_WORDS_SQL.format("line")})) FROM lines
),
named AS (
    SELECT rid, list(DISTINCT label) AS labels, max(held / CAST(size AS DOUBLE)) AS share FROM blocks JOIN notices USING (n) WHERE held >= need GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
    CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM docs LEFT JOIN base b USING (rid) LEFT JOIN named m USING (rid)""",
    "op6_url_rules": rf"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
    SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
),
rules(rule_host, rule_path, v) AS (VALUES {_RULES_SQL}),
judged AS (
    SELECT p.page_id, p.host, p.path,
        (SELECT max_by(rule_host || rule_path, length(rule_host || rule_path)) FROM rules
         WHERE ends_with('.' || p.host, '.' || rule_host) AND starts_with(p.path, rule_path)) AS rule
    FROM parts p
)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(r.v, 'allow') AS verdict
FROM judged j LEFT JOIN rules r ON r.rule_host || r.rule_path = j.rule""",
    "op7_covertree_topk": """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20""",
}
