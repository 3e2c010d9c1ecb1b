"""Fixed-width array columns as numpy blocks inside Arrow tasks."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tasks carry these helpers with them, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Numbers per block, so temporaries stay small however wide the array is.
BLOCK_NUMBERS = 1 << 21


def blocks(batches: Iterable[pa.RecordBatch], column: str, width: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """(rows x width matrix with NaN for null, the batch slice it came from); a width of -1 is read off the rows."""
    for batch in batches:
        found = batch.schema.get_field_index(column)
        step = max(1, BLOCK_NUMBERS // max(1, width if width >= 0 or not batch.num_rows else len(batch.column(found)[0])))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            flat = part.column(part.schema.get_field_index(column)).flatten()
            yield flat.to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, width), part


def array_means(df: DataFrame, column: str, width: int) -> np.ndarray:
    """Mean of each array position over the known values; 0 where there is none."""

    def sums(batches):
        total, known = np.zeros(width), np.zeros(width)
        for x, _ in blocks(batches, "x", width):
            total += np.nansum(x, axis=0)
            known += (~np.isnan(x)).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"p": np.arange(width, dtype="int32"), "s": total, "n": known})

    out = np.zeros(width)
    per_task = df.select(F.col(column).alias("x")).mapInArrow(sums, "p int, s double, n double")
    mean = F.try_divide(F.sum("s"), F.sum("n"))
    for r in per_task.groupBy("p").agg(mean.alias("m")).collect():  # one number per position
        if r["m"] is not None and np.isfinite(r["m"]):
            out[r["p"]] = r["m"]
    return out


def array_sums(df: DataFrame, column: str, width: int, by: str) -> DataFrame:
    """(by, pos, known, total) of each array position over the known values, per value of a column of few values."""

    def sums(batches):
        found: dict = {}
        for x, part in blocks(batches, "x", width):
            group = part.column(part.schema.get_field_index("g")).to_pylist()
            for g in set(group):
                own = x[[v == g for v in group]]
                known, total = found.setdefault(g, (np.zeros(width, dtype=np.int64), np.zeros(width)))
                known += (~np.isnan(own)).sum(axis=0)
                total += np.nansum(own, axis=0)
        for g, (known, total) in found.items():
            yield pa.RecordBatch.from_pydict(
                {"g": pa.array([g] * width, type=pa.string()), "pos": np.arange(width, dtype="int32"), "known": known, "total": total}
            )

    rows = df.select(F.col(column).alias("x"), F.col(by).cast("string").alias("g"))
    per_task = rows.mapInArrow(sums, "g string, pos int, known long, total double")
    return per_task.groupBy(F.col("g").alias(by), "pos").agg(F.sum("known").alias("known"), F.sum("total").alias("total"))
