"""Whitening of embeddings: exact integer moments in Spark, components by contour integration."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsmith.llm.contour import leading_eigenpairs
from foldsmith.llm.vectors import lists, matrix, usable, width
from foldsmith.scratch import materialise

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
ROWS = 8192
# Entries whose integers stay below this are summed exactly; larger ones are refused.
LARGEST = 1 << 46
EXACT = float(1 << 53)
WHOLE = pa.decimal128(38, 0)


def _integers(column: pa.Array, d: int) -> np.ndarray:
    x = np.floor(SCALE * matrix(column, d)) + SHIFT
    if len(x) and np.abs(x).max(initial=0.0) >= LARGEST:
        raise ValueError(f"an entry is too large to be summed exactly: {np.abs(x).max():.3g}")
    return x.astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, _integers(part.column(part.schema.get_field_index("vector")), d)


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], type=WHOLE)


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension; one row per dimension reaches the driver."""

    def sums(batches):
        n, total = 0, np.zeros(d, dtype=object)
        for _, x in _parts(batches, d):
            n += len(x)
            total += x.sum(axis=0, dtype=np.int64)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d, dtype=np.int32)), _decimals(total), _decimals([n] * d)], names=["p", "s", "n"]
            )

    per_task = rows.mapInArrow(sums, "p int, s decimal(38,0), n decimal(38,0)")
    out = per_task.groupBy("p").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("p").collect()
    return (int(out[0]["n"]), [int(r["s"]) for r in out]) if out else (0, [])


def _products(y: np.ndarray) -> np.ndarray:
    """Exact sums of products as Python integers: in doubles while they hold them, else by integers of any size."""
    most = float(np.abs(y).max(initial=0))
    if most * most * max(1, len(y)) < EXACT:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    big = y.astype(object)
    return big.T @ big


def covariance(rows: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance over ``rows`` with divisor n: entries are centred at the integer next to their mean before they are
    multiplied, products are summed exactly, and the rest of the mean is taken off in integers."""
    centre = [round(s / n) for s in sums]
    at = np.array(centre, dtype=np.int64)
    upper = np.triu_indices(d)

    def scatter(batches):
        total = np.zeros((d, d), dtype=object)
        for _, x in _parts(batches, d):
            total += _products(x - at)
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), _decimals(total[upper])],
            names=["i", "j", "s"],
        )

    per_task = rows.mapInArrow(scatter, "i int, j int, s decimal(38,0)")
    rest = [s - n * c for s, c in zip(sums, centre)]
    out = np.zeros((d, d))
    for r in per_task.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # d * (d + 1) / 2 rows
        i, j = r["i"], r["j"]
        out[i, j] = out[j, i] = (n * int(r["s"]) - rest[i] * rest[j]) / (n * n)
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S) squared, exact; null beyond 64 bits."""
    centre = np.array([round(s / n) for s in sums], dtype=np.int64)
    rest = np.array([s - n * int(c) for s, c in zip(sums, centre)], dtype=object)
    y = x - centre
    most = n * float(np.abs(y).max(initial=0)) + n
    if most * most * max(1, x.shape[1]) < 2.0**62:
        z = n * y - rest.astype(np.int64)
        return (z * z).sum(axis=1).tolist()
    z = y.astype(object) * n - rest
    return [v if v < 1 << 63 else None for v in (z * z).sum(axis=1).tolist()]


def _identity_error(stored: DataFrame, k: int, live: np.ndarray) -> float | None:
    """Largest absolute entry of the covariance of what was whitened minus the identity, over components with variance."""
    if not live.any():
        return None

    def moments(batches):
        n, s, p = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = matrix(batch.column(batch.schema.get_field_index("projected")), k)
            n, s, p = n + len(w), s + w.sum(axis=0), p + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([float(n)]), lists(s[None]), lists(p.reshape(1, -1))], names=["n", "s", "p"])

    per_task = stored.select("projected").mapInArrow(moments, "n double, s array<double>, p array<double>")
    each = [F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(k)]]
    each += [F.sum(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(k * k)]
    r = per_task.agg(*each).first()
    mean = np.array([r[f"s{i}"] for i in range(k)]) / r["n"]
    cov = np.array([r[f"p{i}"] for i in range(k * k)]).reshape(k, k) / r["n"] - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k))[np.ix_(live, live)].max())


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: key, component, n, deviation, whitened, explained, identity_error.

    Entries become integers floor(1024 c) + 100000. Sums, squares and products over all usable rows are exact
    integers; the covariance is rounded once. Its leading eigenpairs come from :mod:`foldsmith.llm.contour`.

    Rows whose vector is null or has null or non-finite entries are left out, of the fit too. Shorter vectors are
    filled with zeros to the longest one's length; there are at most as many components as dimensions. A component
    without variance (one row only, equal rows, too few rows) has null ``whitened`` values and explains 0;
    ``identity_error`` looks at the others and is null if there are none. ``explained`` is null if all rows are
    equal. ``deviation`` is null beyond 64 bits. Null keys and repeated rows come back as given. An empty table gives
    no rows. Entries of 2 ** 36 or more are an error. Other columns are not read.
    """
    names = f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = table.sparkSession
    rows = table.filter(usable(vector)).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")
    )
    d = width(rows, "vector")
    n, sums = _sums(rows, d) if d else (0, [])
    if not n:
        return spark.createDataFrame([], names)
    cov = covariance(rows, d, n, sums)
    values, vectors = leading_eigenpairs(cov, components)
    k, trace = len(values), float(np.trace(cov))
    live = values > d * np.finfo(float).eps * max(float(values.max()), 0.0) * 16
    turn = np.where(live, vectors / np.sqrt(np.where(live, values, 1.0)), 0.0)
    centre = np.array([round(s / n) for s in sums], dtype=np.int64)
    rest = np.array([(s - n * int(c)) / n for s, c in zip(sums, centre)])

    def project(batches):
        for part, x in _parts(batches, d):
            w = ((x - centre) - rest) @ turn
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("id")), pa.array(_deviations(x, n, sums), type=pa.int64()), lists(w)],
                names=["id", "deviation", "projected"],
            )

    stored = materialise(rows.mapInArrow(project, "id long, deviation long, projected array<double>"), "whitened")
    error = _identity_error(stored, k, live)
    each = [
        F.struct(
            F.lit(i + 1).alias("component"),
            (F.get("projected", F.lit(i)) if live[i] else F.lit(None).cast("double")).alias("whitened"),
            F.lit(max(float(values[i]), 0.0) / trace if trace > 0 else None).cast("double").alias("explained"),
        )
        for i in range(k)
    ]
    long = stored.select("id", "deviation", F.inline(F.array(*each)))
    return long.select(
        F.col("id").alias(key),
        "component",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        "explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
