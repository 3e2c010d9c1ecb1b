"""Pairwise-complete correlation of many columns from block moments, and the drop list."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsmith.functions import expressions as E
from foldsmith.functions.blocks import array_means, array_sums, blocks
from foldsmith.scratch import materialise, short_lived

# Columns that one scan compares at most, and cells of each of a task's six moment matrices.
BLOCK = 1000
MOMENT_CELLS = 2_000_000
# Columns without nulls that all others without nulls are measured against first.
PIVOTS = 16
# Radians left for rounding before an angle rules a pair out.
SLACK = 1e-3
PAIRS_PER_BATCH = 1 << 16
MOMENTS = ("n", "si", "sj", "sii", "sjj", "sij")
_SCHEMA = "i int, j int, " + ", ".join(f"{m} double" for m in MOMENTS)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, n, r) for positions i < j of ``columns``; r is null where a column is constant."""
    x = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    return array_correlation(x, "x", list(range(len(columns))))


def array_correlation(
    df: DataFrame, column: str, order: list[int], rows: Sequence[int] | None = None, cols: Sequence[int] | None = None,
    means: np.ndarray | None = None, wanted: np.ndarray | None = None, whole: bool = False,
) -> DataFrame:
    """(i, j, n, r), i < j, where i and j count along ``order``, positions of an array<double> column.

    ``rows`` and ``cols`` limit i and j; ``wanted``, rows by cols, marks the pairs to return, in place of i < j;
    ``means`` holds the column means along ``order``, if known. ``whole`` says that ``order`` has all positions in their order.

    Each task adds the moments of its own rows with matrix products and emits them once, one row
    per column pair; no row of ``df`` is shuffled. Values are shifted by the column means first so
    that sums of squares keep their digits.
    """
    rows = range(len(order)) if rows is None else rows
    cols = range(len(order)) if cols is None else cols
    used = sorted({*rows, *cols})
    at = {k: n for n, k in enumerate(used)}
    x = df.select((F.col(column) if whole else E.pick(column, [order[k] for k in used])).alias("x"))
    shift = array_means(x, "x", len(used)) if means is None else means[used]
    left, right = np.array(rows), np.array(cols)
    li, ri = [at[k] for k in rows], [at[k] for k in cols]
    a, b = np.nonzero(left[:, None] < right[None, :] if wanted is None else wanted)

    def moments(batches):
        n, si, sj, sii, sjj, sij = (np.zeros((len(li), len(ri))) for _ in MOMENTS)
        for v, _ in blocks(batches, "x", len(shift)):
            v = v - shift
            m = (~np.isnan(v)).astype(float)
            v = np.nan_to_num(v, nan=0.0)
            vi, mi, vj, mj = v[:, li], m[:, li], v[:, ri], m[:, ri]
            n += mi.T @ mj
            si += vi.T @ mj
            sj += mi.T @ vj
            sii += (vi * vi).T @ mj
            sjj += mi.T @ (vj * vj)
            sij += vi.T @ vj
        if n.any():
            for s in range(0, len(a), PAIRS_PER_BATCH):
                p, q = a[s : s + PAIRS_PER_BATCH], b[s : s + PAIRS_PER_BATCH]
                out = {"i": left[p].astype("int32"), "j": right[q].astype("int32")}
                out.update({k: v[p, q] for k, v in zip(MOMENTS, (n, si, sj, sii, sjj, sij))})
                yield pa.RecordBatch.from_pydict(out)

    total = x.mapInArrow(moments, _SCHEMA).groupBy("i", "j").agg(*[F.sum(m).alias(m) for m in MOMENTS])
    return total.select(
        "i", "j", F.col("n").cast("bigint").alias("n"), E.pearson(*[F.col(m) for m in MOMENTS]).alias("r")
    )


def drop_list(matrix: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Positions j that correlate beyond the threshold with any earlier one, dropped or not."""
    return matrix.filter(F.abs("r") > threshold).select("j").distinct()


def drop_positions(
    df: DataFrame, column: str, order: list[int], threshold: float = 0.95, block: int = BLOCK, whole: bool = False
) -> set[int]:
    """Positions of an array column to drop, "earlier" meaning earlier in ``order``; ``whole`` says that it has all, in their order.

    Up to ``block`` columns take one scan. Wider arrays are stored as one column per block of positions, and each block
    is compared with itself and all later ones in one scan that reads the blocks it needs. The angle between two
    columns, arccos |r|, is a distance; so columns without nulls whose angles to a pivot differ by more than the
    threshold's angle cannot correlate beyond it and are not compared. Nor is a column again that is dropped already.
    Pairs with nulls are all compared. Only column facts, angles to pivots and dropped positions reach the driver.
    """
    if len(order) <= block:
        hits = drop_list(array_correlation(df, column, order, whole=whole), threshold).collect()
        return {order[r["j"]] for r in hits}
    size = min(block, max(1, MOMENT_CELLS // len(order)))
    ranges = [range(s, min(s + size, len(order))) for s in range(0, len(order), size)]
    full, means = _column_facts(df, column, order)
    with short_lived(df.sparkSession):
        parts = [E.pick(column, [order[k] for k in r]).alias(f"b{n}") for n, r in enumerate(ranges)]
        store = materialise(df.select(*parts), "column-blocks")
        angles = _pivot_angles(store, ranges, full, means)
        gone = np.zeros(len(order), dtype=bool)
        for rows in ranges:
            later = np.arange(rows.start, len(order))
            wanted = _open_pairs(angles, rows, later, threshold) & ~gone[later]
            if wanted.any():
                matrix, used = _between(store, ranges, np.array(rows), later, wanted, means)
                for r in drop_list(matrix, threshold).collect():  # at most one row per column
                    gone[used[r["j"]]] = True
    return {order[k] for k in np.nonzero(gone)[0]}


def _column_facts(df: DataFrame, column: str, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each column has no null, and its mean over the known values (0 where there is none)."""
    # A column of ones, added last, is known in every row.
    x = df.select(F.array_append(E.pick(column, order), F.lit(1.0)).alias("x"), F.lit("all").alias("of"))
    known, means = np.zeros(len(order) + 1, dtype=np.int64), np.zeros(len(order) + 1)
    for r in array_sums(x, "x", len(order) + 1, "of").collect():  # one row per column
        known[r["pos"]] = r["known"]
        if r["known"] and np.isfinite(r["total"]):
            means[r["pos"]] = r["total"] / r["known"]
    return known[:-1] == known[-1], means[:-1]


def _between(
    store: DataFrame, ranges: list[range], left: np.ndarray, right: np.ndarray, wanted: np.ndarray, means: np.ndarray
) -> tuple[DataFrame, np.ndarray]:
    """Correlations of the wanted pairs, read from the blocks that hold them, and the columns that i and j count along."""
    left, right, wanted = left[wanted.any(axis=1)], right[wanted.any(axis=0)], wanted[wanted.any(axis=1)][:, wanted.any(axis=0)]
    used = np.union1d(left, right)
    held = [n for n, r in enumerate(ranges) if ((used >= r.start) & (used < r.stop)).any()]
    place = {k: n for n, k in enumerate(k for b in held for k in ranges[b])}
    x = store.select(F.concat(*[F.col(f"b{b}") for b in held]).alias("x"))
    i, j = np.searchsorted(used, left).tolist(), np.searchsorted(used, right).tolist()
    return array_correlation(x, "x", [place[k] for k in used.tolist()], i, j, means[used], wanted), used


def _pivot_angles(store: DataFrame, ranges: list[range], whole: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Angles of each column to some pivots, pivots by columns; not a number where nothing can be ruled out."""
    full = np.nonzero(whole)[0]
    if len(full) < 2:
        return np.full((0, len(whole)), np.nan)
    pivots = full[np.unique(np.linspace(0, len(full) - 1, PIVOTS).astype(int))]
    angles = np.full((len(pivots), len(whole)), np.nan)
    matrix, used = _between(store, ranges, pivots, full, pivots[:, None] != full[None, :], means)
    row = {k: n for n, k in enumerate(pivots.tolist())}
    for r in matrix.filter("r is not null").collect():  # one row per pivot and column
        angles[row[int(used[r["i"]])], used[r["j"]]] = np.arccos(min(1.0, abs(r["r"])))
        angles[row[int(used[r["i"]])], used[r["i"]]] = 0.0
    return angles


def _open_pairs(angles: np.ndarray, rows: range, later: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs, rows by later columns, in order, that no pivot rules out."""
    reach = np.arccos(np.clip(threshold, 0.0, 1.0)) + SLACK
    pairs = np.arange(rows.start, rows.stop)[:, None] < later[None, :]
    for own in angles:
        pairs &= ~(np.abs(own[rows.start : rows.stop, None] - own[None, later]) > reach)
    return pairs


def drop_correlated(df: DataFrame, columns: list[str], threshold: float = 0.95) -> list[str]:
    """Names of the columns to drop, in the given order."""
    x = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    gone = drop_positions(x, "x", list(range(len(columns))), threshold)
    return [c for k, c in enumerate(columns) if k in gone]
