"""A training corpus from raw documents, in stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventlens.llm import minhash, mixing, packing, parsing, rules
from eventlens.llm.common import importable, settle, table
from eventlens.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed votes of the rules accept."""
    importable(spark)
    return rules.kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five-word shingles and a similarity of 0.8."""
    importable(spark)
    return minhash.one_of_each(docs, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that start more than once in all of them."""
    importable(spark)
    return parsing.stripped(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    importable(spark)
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    importable(spark)
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: The stages vote by floating-point estimates, join by similarity and encode tokens, which SQL does not
#: express; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
