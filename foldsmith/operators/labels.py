"""Labels: two 0/1 labels to one class, cohorts, one-hot columns and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsmith.functions import expressions as E
from foldsmith.roles import LABEL_ANY, LABEL_CLASS, Roles

CLASSES = ("H", "HS", "S")
NONE_CLASS = "N"


def with_classes(df: DataFrame, roles: Roles, keep_labels: bool = True) -> DataFrame:
    a, b = roles.labels
    out = df.withColumn(LABEL_CLASS, E.label_class(F.col(a), F.col(b)))
    out = out.withColumn(LABEL_ANY, E.label_any(F.col(LABEL_CLASS)))
    return out if keep_labels else out.drop(a, b)


def positive_cohort(df: DataFrame, roles: Roles) -> DataFrame:
    a, b = roles.labels
    return df.filter((F.col(a) > 0) | (F.col(b) > 0))


def class_onehot(df: DataFrame, label: str, classes: tuple[str, ...]) -> DataFrame:
    """One 0/1 column per class, named by the class, and its complement ``no_<class>``."""
    hot = {c: F.coalesce(F.col(label) == c, F.lit(False)).cast("int") for c in classes}
    return df.withColumns(hot).withColumns({f"no_{c}": 1 - F.col(c) for c in classes})


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balancing weight n / (k * n_class) for each class present."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    # One entry per class from here on, however large ``df`` is.
    every = counts.agg(F.collect_list(F.struct(label, "n")).alias("each"), F.sum("n").alias("total"))
    share = F.col("total").cast("double")

    def weighted(c: Column) -> Column:
        weight = F.try_divide(share, F.size("each") * c["n"])
        return F.struct(c[label].alias(label), c["n"].alias("n"), weight.alias("weight"))

    return every.select(F.inline(F.transform("each", weighted)))


def label_summary(labels: DataFrame, roles: Roles, n_features: int) -> DataFrame:
    """Row count, share of positives per label, and number of features."""
    a, b = roles.labels
    n = F.count("*")
    return labels.agg(
        n.alias("n_rows"),
        F.try_divide(F.sum(a).cast("double"), n).alias(f"{a}_ratio"),
        F.try_divide(F.sum(b).cast("double"), n).alias(f"{b}_ratio"),
        F.lit(n_features).cast("bigint").alias("n_features"),
    )
