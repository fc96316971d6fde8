"""The corpus pipeline: documents in, packed sequences out.

STAGES are run in turn; each takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` stores as
Parquet in the shared scratch folder and rereads as the next stage's docs. All but the last return the
columns of ``documents``; the last returns the packed pieces. Stages pass on what they are given in every
column but text (and n_chars, which follows the text); a stage's own docstring says what it does with
nulls, empty texts and repeats.

SQL cannot express these stages (models, token vocabularies, iterated components), so there is no
ORACLE_SQL; tests hold ``run`` against the stages' brute-force counterparts on a small table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.llm import jaccard_join, language_id, packing, quality, suffix_dedup
from chronolake.llm.common import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return language_id.keep_identified(docs)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies outside their language's limits go."""
    return quality.keep_good(docs, quality.labels_of(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    return jaccard_join.keep_one(docs)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``suffix_dedup.PASSAGE`` bytes that also start elsewhere are cut out: passages of over 50
    words are longer. Every document stays, n_chars follows."""
    cleaned = suffix_dedup.remove_repeats(docs, suffix_dedup.PASSAGE).drop("removed")
    if "n_chars" not in docs.columns:
        return cleaned
    kind = docs.schema["n_chars"].dataType
    changed = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind))
    return cleaned.withColumn("n_chars", changed)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", judge_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", remove_repeated_strings),
    ("best-fit packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{at}")
    return docs
