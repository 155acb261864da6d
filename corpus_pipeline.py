"""Corpus pipeline over ``documents``: each stage is written as Parquet and read again by the next.

Quality classifier, n-gram Jaccard join, suffix-array dedup, mixing to target weights, BPE.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand.llm.bpe import encode_decode
from keystrand.llm.common import shared_folder, table
from keystrand.llm.pareto_mix import mix_sources
from keystrand.llm.quality_pu import score_quality, train_quality
from keystrand.llm.rindex_dedup import dedup_substrings
from keystrand.llm.tgm_jaccard import jaccard_components


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on them and the trusted positives, does not reject."""
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, keep=True).where("quality_score >= 0.5").select(*docs.columns)


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id; null ids stay."""
    kept = jaccard_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start earlier too; ``n_chars`` follows the text."""
    cut = dedup_substrings(docs, keep=True)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    mixed = mix_sources(docs, keep=True)
    return mixed.withColumn("_copy", F.explode(F.expr("array_repeat(0, cast(mix.copies as int))"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixed texts as digests, with the round trip's digest."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_representatives),
    ("substrings", cut_repeats),
    ("mix", mix),
    ("bpe", encode),
]

#: Not expressible in SQL: the classifier is trained and the mix is drawn by a hash of Spark's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what lies between them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
