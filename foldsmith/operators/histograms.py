"""Counts of many numbers in many groups, by the cells that cuts of each number make: one Arrow pass for all group sets.

A task counts blocks of rows in numpy and sends one row per group, number and cell that has values, so what is shuffled
depends on groups and cells, not on rows times sets times numbers.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsmith.functions import expressions as E
from foldsmith.operators import bins

# Tasks carry these helpers with them, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cells of a number that has more values than that.
CELLS_PER_NUMBER = 256
# Numbers per block of a task, and rows of counts that a task holds before it adds them up.
BLOCK_NUMBERS, HELD_ROWS = 1 << 22, 1 << 21
# The number of the set whose rows give the least and the greatest value of each cell.
RANGES = -1
COUNTS = "set_id int, k1 string, k2 string, num_id int, cell int, n long, lo double, hi double"
_WEIGHT = "w"
_WHERE = ["set_id", "k1", "k2", "num_id", "cell"]


def fit_cuts(df: DataFrame, nums: list[str]) -> list[np.ndarray]:
    """Rising cuts of each number, about even in rows; any cuts give right counts. They reach the driver."""
    array = df.select(F.array(*[F.col(E.quoted(n)).cast("double") for n in nums]).alias("x"))
    found = bins.collected(bins.fit_edges(array, "x", len(nums), CELLS_PER_NUMBER), len(nums))
    return [e[~np.isnan(e)] for e in found]


def cell_counts(
    df: DataFrame, sets: list[tuple[str, ...]] | None, nums: list[str], cuts: list[np.ndarray], weight: str | None = None
) -> DataFrame:
    """COUNTS rows, still to be added up: ``n`` values of a number that a group has in a cell.

    ``sets`` are one or two columns each; None if ``df`` has one row per group already, with set_id, k1 and k2. Null
    keys and null numbers are left out; NaN has the last cell. Rows of the set RANGES have the ends of each cell, except
    of those of NaN. ``weight`` names a column that says how many rows a row stands for.
    """
    columns = ["set_id", "k1", "k2"] if sets is None else list(dict.fromkeys(c for s in sets for c in s))
    plan = [(i, [columns.index(c) for c in s]) for i, s in enumerate(sets or [])]
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        # Minus zero is zero, as for every grouping.
        zero = F.lit(0.0).cast(kinds[c]) if kinds[c] in ("float", "double") else None
        return (F.col(E.quoted(c)) if zero is None else F.col(E.quoted(c)) + zero).cast("string")

    keys = [text(c).alias(f"k{j}") for j, c in enumerate(columns)]
    values = [F.col(E.quoted(n)).cast("double").alias(f"n{i}") for i, n in enumerate(nums)]
    values += [F.col(E.quoted(weight)).cast("long").alias(_WEIGHT)] if weight else []
    most = max(1, BLOCK_NUMBERS // max(1, len(nums)))

    def count(batches):
        held, rows = [], 0
        for block in _tables(batches, most):
            for part in _counted(block, plan, cuts):
                held.append(part)
                rows += part.num_rows
            if rows > HELD_ROWS:
                held = [_added(held)]
                rows = held[0].num_rows
                if rows > HELD_ROWS // 2:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from _added(held).to_batches()

    return df.select(*keys, *values).mapInArrow(count, COUNTS)


def _tables(batches, most: int):
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _added(parts: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(parts).group_by(_WHERE).aggregate([("n", "sum"), ("lo", "min"), ("hi", "max")])
    return sums.select([*_WHERE, "n_sum", "lo_min", "hi_max"]).rename_columns([*_WHERE, "n", "lo", "hi"])


def _part(set_id, k1, k2, num, cell, n, lo=None, hi=None) -> pa.Table:
    size = len(cell)
    none = pa.nulls(size, pa.float64())
    each = [set_id, k1, k2, num.astype(np.int32), cell.astype(np.int32), n.astype(np.int64)]
    each = [pa.array(a) if isinstance(a, np.ndarray) else a for a in each]
    each += [none if lo is None else pa.array(lo), none if hi is None else pa.array(hi)]
    return pa.table(each, names=[*_WHERE, "n", "lo", "hi"])


def _text(size: int) -> pa.Array:
    return pa.repeat(pa.scalar("", pa.string()), size)


def _counted(table: pa.Table, plan: list, cuts: list[np.ndarray]):
    """COUNTS tables of one block."""
    cells = []
    for i, e in enumerate(cuts):
        column = table.column(f"n{i}")
        x = column.to_numpy(zero_copy_only=False).astype(float) if table.num_rows else np.zeros(0)
        null = pc.is_null(column).to_numpy(zero_copy_only=False)
        nan = np.isnan(x) & ~null
        cell = np.searchsorted(e, x).astype(np.int64) + 1
        cell[nan] = len(e) + 2
        cell[null] = 0
        cells.append(cell)
        width = len(e) + 3
        lo, hi = np.full(width, np.inf), np.full(width, -np.inf)
        x = np.where(null | nan, 0.0, x)  # their cells have no ends
        np.minimum.at(lo, cell, x)
        np.maximum.at(hi, cell, x)
        live = np.flatnonzero(np.bincount(cell, minlength=width))
        live = live[(live > 0) & (live < len(e) + 2)]
        zero = np.zeros(len(live))
        yield _part(np.full(len(live), RANGES, dtype=np.int32), _text(len(live)), _text(len(live)), zero + i, live, zero, lo[live], hi[live])

    coded, known = [], []
    weight = table.column(_WEIGHT).to_numpy() if _WEIGHT in table.column_names else None
    for j in range(sum(n.startswith("k") for n in table.column_names)):
        each = pc.dictionary_encode(table.column(f"k{j}").combine_chunks())
        each = each.combine_chunks() if isinstance(each, pa.ChunkedArray) else each
        coded.append(pc.fill_null(each.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64))
        known.append(each.dictionary)
    for set_id, places in plan or [(None, range(len(coded)))]:
        ok = np.all([coded[p] >= 0 for p in places], axis=0)
        group = np.zeros(int(ok.sum()), dtype=np.int64)
        for p in places:
            group = group * max(1, len(known[p])) + coded[p][ok]
        groups, own = np.unique(group, return_inverse=True)
        if not len(groups):
            continue
        stands = None if weight is None else weight[ok]
        found = [_cells_of(own, cell[ok], len(e) + 3, len(groups), stands) for cell, e in zip(cells, cuts)]
        at = np.concatenate([f[0] for f in found])
        text, rest = [], groups
        for p in reversed(list(places)):
            text.insert(0, known[p].take(pa.array(rest % max(1, len(known[p])))))
            rest = rest // max(1, len(known[p]))
        taken = [t.take(pa.array(at)).cast(pa.string()) for t in text]
        if set_id is None:
            first = taken.pop(0).cast(pa.int32())
        else:
            first = np.full(len(at), set_id, dtype=np.int32)
        k1, k2 = taken if len(taken) > 1 else (taken[0], _text(len(at)))
        num = np.concatenate([np.full(len(f[0]), i) for i, f in enumerate(found)])
        yield _part(first, k1, k2, num, np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found]))


def _cells_of(
    group: np.ndarray, cell: np.ndarray, width: int, n_groups: int, weight: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, cell, n) of what has values; cell 0, null, is left out."""
    place = group * width + cell
    if n_groups * width <= 4 * len(place) + (1 << 16):
        n = np.bincount(place, weight, minlength=n_groups * width)
        at = np.flatnonzero(n)
        n = n[at]
    else:
        at, own = np.unique(place, return_inverse=True)
        n = np.bincount(own, weight)
    group, cell = at // width, at % width
    real = cell > 0
    return group[real], cell[real], n[real]
