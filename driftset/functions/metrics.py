"""Measures of a run: cardinalities, changes, case counts, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cardinality(mis: DataFrame) -> DataFrame:
    return mis.agg(F.count("*").alias("mis_size"))


def deltas(sizes: DataFrame) -> DataFrame:
    """Adds mis_delta, the absolute change of the set in each batch."""
    return sizes.withColumn("mis_delta", F.abs(F.col("mis_size") - F.col("mis_before")))


def slowest_worker_total(times: DataFrame) -> DataFrame:
    """Per stage, the sum over batches of the slowest worker (batch_id, stage, worker, ms)."""
    return times.groupBy("batch_id", "stage").agg(F.max("ms").alias("ms")).groupBy("stage").agg(F.sum("ms").alias("total_ms"), F.avg("ms").alias("avg_ms"))


def summary(metrics: DataFrame) -> DataFrame:
    """Batches, first and last size, absolute change, total ms and batches per second."""
    m = metrics.where("stage = 'total'")
    return m.agg(
        F.count("*").alias("batches"), F.min_by("mis_before", "batch_id").alias("mis_first"), F.max_by("mis_size", "batch_id").alias("mis_last"),
        F.sum("ms").alias("total_ms"),
    ).withColumn("mis_change", F.abs(F.col("mis_last") - F.col("mis_first"))).withColumn("batches_per_s", F.col("batches") * 1000.0 / F.col("total_ms"))
