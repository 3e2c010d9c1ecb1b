"""ROC-AUC from ranks, exact under ties, without sorting all scores in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AUC_KEYS = ["metric"]


def auc(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(metric, auc) for each named (0/1 label, score); null if a class is absent.

    Equal scores merge first. The distinct scores are then range-partitioned, ranked inside each
    range, and shifted by the negatives of the lower ranges: one row per range and metric.
    """
    each = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), y.cast("double").alias("y"), s.cast("double").alias("score"))
            for m, (y, s) in pairs.items()
        ]
    )
    rows = df.select(F.inline(each)).filter(F.col("score").isNotNull() & F.col("y").isNotNull())
    scores = rows.groupBy("metric", "score").agg(
        F.count_if(F.col("y") > 0).alias("pos"), F.count_if(F.col("y") <= 0).alias("neg")
    )
    ranged = scores.repartitionByRange("metric", "score").withColumn("range", F.spark_partition_id())
    inside = Window.partitionBy("metric", "range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("neg").over(inside), F.lit(0)).cast("double")
    per_range = ranged.withColumn("won", F.col("pos") * (lower + F.col("neg") / 2)).groupBy("metric", "range").agg(
        F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min("score").alias("first")
    )
    before = Window.partitionBy("metric").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("neg").over(before), F.lit(0)).cast("double")
    return (
        per_range.withColumn("won", F.col("won") + F.col("pos") * offset)
        .groupBy("metric")
        .agg(F.sum("won").alias("won"), F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"))
        .select("metric", F.try_divide(F.col("won"), F.col("p") * F.col("n")).alias("auc"))
    )


def one_vs_rest(label: Column, scores: dict[str, Column]) -> dict[str, tuple[Column, Column]]:
    """Label/score pairs for :func:`auc`, one per class."""
    return {c: ((label == c).cast("double"), s) for c, s in scores.items()}


def mean_auc(per_metric: DataFrame) -> DataFrame:
    """(mean_auc) of the metrics; null if any of them is."""
    whole = F.count("auc") == F.count("*")
    return per_metric.agg(F.when(whole, F.avg("auc")).alias("mean_auc"))
