"""The corpus pipeline: five stages, each written and read again as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftset.functions.shared import discard, fresh_path, materialise, temporary
from driftset.llm import boilerplate, decontam, jaccard, mixing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return quality.apply_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go from the texts; every document stays."""
    return boilerplate.dedup_documents(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: 5-word shingles, similarity 0.8."""
    return jaccard.keep_one_of_each(docs, k=5, t=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window like a benchmark item go."""
    return decontam.drop_contaminated(docs, decontam.item_blocks(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with size, source_size, target and taken words."""
    return mixing.mix_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
]

#: The first stage learns its rules and the third hashes; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; the tables a stage makes on its way go with it, and its input once it is read."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        label = name.replace(" ", "-")
        path = fresh_path(spark, label)
        with temporary(spark):
            docs = materialise(stage(spark, docs, sf_dir), label, path)
        if before:
            discard(spark, before)
        before = path
    return docs
