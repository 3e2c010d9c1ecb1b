"""Reading features and labels, and writing scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsmith.functions import expressions as E
from foldsmith.operators import splits
from foldsmith.roles import Roles


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    df = reader.format(fmt).load(path)
    doubles = {f.name: E.finite(F.col(f.name)) for f in schema if isinstance(f.dataType, T.DoubleType)}
    return df.withColumns(doubles) if doubles else df


def read_features(
    spark: SparkSession, path: str, roles: Roles, fmt: str = "csv", debug: bool = False
) -> DataFrame:
    """Features, labelled or to be scored. ``debug`` keeps a fixed tenth of the keys."""
    df = _read(spark, path, roles.feature_schema(), fmt)
    return splits.sample(df, roles.key) if debug else df


def read_labels(spark: SparkSession, path: str, roles: Roles, fmt: str = "csv") -> DataFrame:
    return _read(spark, path, roles.label_schema(), fmt)


def join_labels(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return features.join(labels, key, "inner")


def rows_without_label(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return features.join(labels.select(key), key, "left_anti")


def write_scores(df: DataFrame, path: str, key: str, scores: list[str]) -> None:
    """Key and scores as CSV with a header; one file per partition, nothing through the driver."""
    df.select(key, *scores).write.option("header", True).csv(path)
