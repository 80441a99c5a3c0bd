"""The operators over whole tables, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventlens.llm import (
    html, jaccard, language, minhash, mixing, packing, parsing, resample, rules, search, subword, tokens, whitening,
)
from eventlens.llm.common import table


def vocabulary() -> str:
    """Where the public word vocabulary lies on this machine; operators take the path as an argument."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.with_suffix_sums(tokens.length_histogram(table(spark, sf_dir, "documents"), vocabulary()))


def without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.without_repeats(table(spark, sf_dir, "documents"), "doc_id")


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_of(table(spark, sf_dir, "documents"))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword.quality_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.weak_quality(table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"))


def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_token_counts": token_counts,
    "op2_suffix_array_dedup": without_repeats,
    "op3_language_id": languages,
    "op4_quality_classifier": quality_classifier,
    "op5_quality_rules": quality_rules,
    "op6_near_duplicates": near_duplicates,
    "op7_html_text": page_texts,
    "op8_best_fit_packing": packed,
    "op9_mixing": mixed,
    "op10_top_k": neighbours,
    "op11_resampling": resampled,
    "op12_ngram_join": similar,
    "op13_whitening": whitened,
}
