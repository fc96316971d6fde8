"""Queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chronolake.llm import (
    ann_search,
    byte_bpe,
    impact_search,
    jaccard_join,
    language_id,
    maxent_lm,
    packing,
    passage_trees,
    quality,
    resampling,
    suffix_dedup,
    url_filter,
    vector_codes,
)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0", 5)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), quality.labels_of(spark, sf_dir))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judge_urls(pages, url_filter.rule_table(spark, url_filter.RULES))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.links_by_document(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return byte_bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 100 = 0", 10)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_digests(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_passage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_trees.removal_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_language_id": op4_language_id,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_url_filters": op6_url_filters,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_vector_codes": op11_vector_codes,
    "op12_passage_trees": op12_passage_trees,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLE = {
    "op6_url_filters": url_filter.ORACLE,
    "op10_exact_top_k": impact_search.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_passage_trees": passage_trees.ORACLE,
}
