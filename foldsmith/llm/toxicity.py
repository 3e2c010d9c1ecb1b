"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsmith.llm.chargrams import gram_sets
from foldsmith.llm.tables import look_up
from foldsmith.llm.words import text_blocks
from foldsmith.scratch import fresh_path, materialise

BITS = 18
# At most this many labelled rows of each class, taken by a hash of the key, are learned from.
ROWS_PER_CLASS = 20_000
SAMPLE_PARTS = 16
SMOOTHING = 1.0
# Buckets whose log-count ratio is small, or within so many of its standard deviations, carry no weight.
LEAST_RATIO, LEAST_DEVIATIONS = 0.5, 2.5
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def held_out(key: Column) -> Column:
    """Rows that are never learned from: a third, by the CRC-32 of the key's text."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """Stored (text, label, weight): a bounded sample of each class, weighted back to the class's size."""
    known = labels.select(key, F.col(label).cast("int").alias("label")).dropna()
    known = known.filter(~held_out(F.col(key)) & F.col("label").isin(0, 1)).groupBy(key).agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one per class
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / (1 << 30)
    share = {c: min(1.0, ROWS_PER_CLASS / n) for c, n in sizes.items()}
    kept = F.when(F.col("label") == 1, F.lit(share.get(1, 1.0))).otherwise(F.lit(share.get(0, 1.0)))
    picked = materialise(known.withColumn("weight", 1 / kept).filter(place < kept), "training-keys")
    texts = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = look_up(texts, picked, [key], "inner").dropDuplicates([key])
    return materialise(rows.select("text", "label", "weight").repartition(SAMPLE_PARTS), "training-rows")


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), dtype=np.int64)
    for part, texts in text_blocks(batches, "text"):
        labels = part.column(part.schema.get_field_index("label")).to_pylist()
        for grams, label in zip(gram_sets(texts, BITS), labels):
            counts[label, grams] += 1
    seen = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen.astype(np.int64)), pa.array(counts[0, seen]), pa.array(counts[1, seen])], names=["gram", "n0", "n1"]
    )


def log_count_ratios(sample: DataFrame) -> np.ndarray:
    """The log ratio of each bucket's smoothed shares of toxic and other rows; one number per bucket."""
    counted = sample.mapInArrow(_count_rows, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = counted.toPandas()  # at most 2 ** BITS rows
    n0, n1 = np.zeros(1 << BITS), np.zeros(1 << BITS)
    n0[found["gram"]], n1[found["gram"]] = found["n0"], found["n1"]
    rows = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = lambda n, label: (n + SMOOTHING) / (rows.get(label, 0) + 2 * SMOOTHING)
    ratios = np.log(share(n1, 1) / share(n0, 0))
    deviation = np.sqrt(1 / (n0 + SMOOTHING) + 1 / (n1 + SMOOTHING))
    ratios[np.abs(ratios) < np.maximum(LEAST_RATIO, LEAST_DEVIATIONS * deviation)] = 0
    return ratios


_VECTOR = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def _vector_rows(batches: Iterator[pa.RecordBatch], ratios: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part, texts in text_blocks(batches, "text"):
        used = [np.sort(g[ratios[g] != 0]) for g in gram_sets(texts, BITS)]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(u) for u in used])]).astype(np.int32))
        flat = np.concatenate(used)
        n = len(used)
        vectors = pa.StructArray.from_arrays(
            [
                pa.array(np.zeros(n, dtype=np.int8)),
                pa.array(np.full(n, 1 << BITS, dtype=np.int32)),
                pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(ratios[flat])),
            ],
            names=["type", "size", "indices", "values"],
        )
        columns = [part.column(part.schema.get_field_index(c)) for c in ("label", "weight")]
        yield pa.RecordBatch.from_arrays([*columns, vectors], names=["label", "weight", "features"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from labelled rows that are not held out.

    Without rows of both classes the model says 0 or 1 for every text, as all labels do, or 0 if there are none.
    """
    spark = docs.sparkSession
    sample = training_sample(docs, labels, key, text, label)
    classes = {r["label"] for r in sample.select("label").distinct().collect()}
    if classes != {0, 1}:
        return Model(np.zeros(1 << BITS), 30.0 if classes == {1} else -30.0)
    ratios = log_count_ratios(sample)
    held = spark.sparkContext.broadcast(ratios)
    path = fresh_path(spark, "training-vectors")
    sample.mapInArrow(lambda it: _vector_rows(it, held.value), f"label int, weight double, features {_VECTOR}").write.parquet(path)
    # Spark ML stores sparse vectors as this struct, so the table is read as vectors.
    kinds = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("features", VectorUDT())])
    vectors = spark.read.schema(kinds).parquet(path)
    fit = LogisticRegression(regParam=1e-4, maxIter=60, standardization=False, weightCol="weight").fit(vectors)
    return Model(fit.coefficients.toArray() * ratios, float(fit.intercept))


def _score_rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for part, texts in text_blocks(batches, "text"):
        margins = np.array([model.weights[g].sum() for g in gram_sets(texts, BITS)]) + model.bias
        scores = 1 / (1 + np.exp(-np.clip(margins, -500, 500)))
        yield pa.RecordBatch.from_arrays(
            [part.column(part.schema.get_field_index("node")), pa.array(scores)], names=["node", "score"]
        )


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, held_out, score, predicted (1 from 0.7 on).

    Whole texts are scored, whatever their length. Null and empty texts have no n-grams of words and get the score of the model's
    bias; null keys are not held out. The model is of fixed size and goes to every task. Other columns are not read.
    """
    texts = docs.select(F.col(key).alias("node"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(texts.dtypes)["node"]
    scored = texts.mapInArrow(lambda it: _score_rows(it, sent.value), f"node {kind}, score double")
    return scored.select(
        F.col("node").alias(key), held_out(F.col("node")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
