"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowkin.llm import mixing, ngram_join, packing, passages, toxicity
from rowkin.llm.common import stored
from rowkin.session import ship_package


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the folder's labels, does not reject. Null and empty texts stay; columns of any names pass."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.accepted(docs, toxicity.fit(docs, labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship_package(spark)
    return ngram_join.deduplicated(docs)


def repeats_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that earlier documents have."""
    ship_package(spark)
    return passages.without_repeats(docs)


def mix_of_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of fixed length."""
    ship_package(spark)
    return packing.pack(docs, added_tokens=True)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", repeats_once),
    ("source_mixing", mix_of_sources),
    ("best_fit_packing", packed),
]

#: SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = stored(docs, f"stage{k}")
    return docs
