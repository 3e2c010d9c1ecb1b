"""Shared by every per-group fit: group sets (one or two category columns) as long keys.

A fitted artifact has one row per (set, keys): ``set`` names the columns joined with '_', ``keys``
holds their values as strings in the order the set lists its columns.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsmith.functions import expressions as E
from foldsmith.functions.blocks import array_sums
from foldsmith.functions.names import set_name
from foldsmith.scratch import BROADCAST_CELLS, attach, materialise

# Tasks carry these helpers with them, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KeySet = tuple[str, ...]
GROUP = ["set_id", "k1", "k2"]
# Spark numbers grouping sets with one bit per column.
MAX_COLUMNS = 60
# The array that attach_values adds, and the number it gives the rows meanwhile.
VALUES, ROW = "_values", "_row"
# A key with more than one in HOT_SHARE of the rows is spread over several tasks; each set has HOT_SHARE such keys at most.
HOT_SHARE = 1000
# Numbers per block of an Arrow task.
BLOCK_NUMBERS = 1 << 22


def keys_of(s: KeySet) -> Column:
    return F.array(*[F.col(c).cast("string") for c in s])


def check_sets(sets: list[KeySet]) -> None:
    """Refuse sets that could not be told apart."""
    if len({set_name(s) for s in sets}) < len(sets):
        raise ValueError("two group sets share a name; rename a column")
    if len({frozenset(s) for s in sets}) < len(sets):
        raise ValueError("two group sets have the same columns")


def grouping_sets_agg(df: DataFrame, sets: list[KeySet], aggs: list[Column], within: tuple[str, ...] = ()) -> DataFrame:
    """One pass over ``df`` for all sets: columns set, keys, then the aggregates.

    ``within`` names columns that part every group further; they come along. Groups with a null key are dropped afterwards, told apart from rolled-up columns by
    ``grouping_id``. Partial aggregation runs before the shuffle, so a hot group sends one row
    per task.
    """
    check_sets(sets)
    cols = list(dict.fromkeys(c for s in sets for c in s))
    if len(cols) > MAX_COLUMNS:
        return reduce(DataFrame.unionByName, [grouping_sets_agg(df, part, aggs, within) for part in _chunks(sets)])
    wide = df.groupingSets([[*within, *s] for s in sets], *within, *cols).agg(F.grouping_id().alias("_gid"), *aggs)
    width = len(cols)

    def gid(s: KeySet) -> int:
        return sum(1 << (width - 1 - i) for i, c in enumerate(cols) if c not in s)

    name = keys = None
    for s in sets:
        hit = F.col("_gid") == gid(s)
        name = F.when(hit, set_name(s)) if name is None else name.when(hit, set_name(s))
        keys = F.when(hit, keys_of(s)) if keys is None else keys.when(hit, keys_of(s))
    out = wide.withColumn("set", name).withColumn("keys", keys)
    return out.filter(~F.exists("keys", lambda k: k.isNull())).drop("_gid", *cols)


def _chunks(sets: list[KeySet]) -> list[list[KeySet]]:
    """The sets in order, cut so that no part has more than MAX_COLUMNS distinct columns."""
    parts: list[list[KeySet]] = [[]]
    for s in sets:
        if len({c for t in (*parts[-1], s) for c in t}) > MAX_COLUMNS:
            parts.append([])
        parts[-1].append(s)
    return parts


def explode_sets(df: DataFrame, sets: list[KeySet], keep: list[str | Column]) -> DataFrame:
    """One row per input row and set (null keys left out): the GROUP columns and the kept ones.

    Plain scalars only, so everything up to the aggregate stays in generated code.
    """

    def entry(i: int, s: KeySet) -> Column:
        second = F.col(s[1]).cast("string") if len(s) > 1 else F.lit("")
        return F.struct(
            F.lit(i).alias("set_id"), F.col(s[0]).cast("string").alias("k1"), second.alias("k2")
        )

    out = df.select(F.inline(F.array(*[entry(i, s) for i, s in enumerate(sets)])), *keep)
    return out.filter(F.col("k1").isNotNull() & F.col("k2").isNotNull())


def named_groups(df: DataFrame, sets: list[KeySet]) -> DataFrame:
    """GROUP columns to (set, keys)."""
    names = F.array(*[F.lit(set_name(s)) for s in sets])
    single = F.get(F.array(*[F.lit(len(s) == 1) for s in sets]), "set_id")
    keys = F.when(single, F.array("k1")).otherwise(F.array("k1", "k2"))
    rest = [c for c in df.columns if c not in GROUP]
    return df.select(F.get(names, "set_id").alias("set"), keys.alias("keys"), *rest)


def numbered_groups(df: DataFrame, sets: list[KeySet]) -> DataFrame:
    """(set, keys) to GROUP columns; sets not listed are left out."""
    at = F.array_position(F.array(*[F.lit(set_name(s)) for s in sets]), F.col("set"))
    rest = [c for c in df.columns if c not in ("set", "keys")]
    return df.filter(at > 0).select(
        (at - 1).cast("int").alias("set_id"),
        F.get("keys", F.lit(0)).alias("k1"),
        F.coalesce(F.get("keys", F.lit(1)), F.lit("")).alias("k2"),
        *rest,
    )


def attach_set(
    df: DataFrame, lookup: DataFrame, s: KeySet, salt_on: list[str] | None = None, cells: int | None = None
) -> DataFrame:
    """Left-join a lookup keyed by ``keys`` on the columns of ``s``; rows with a null key get nulls."""
    key = "_keys_" + set_name(s)
    bare = df.withColumn(key, F.when(~F.exists(keys_of(s), lambda k: k.isNull()), keys_of(s)))
    return attach(bare, lookup.withColumnRenamed("keys", key), [key], "left", salt_on, cells=cells).drop(key)


def value_lookup(parts: list[DataFrame], items: dict[KeySet, list[str]]) -> DataFrame:
    """(set_id, k1, k2, values): the fitted numbers of each group as an array in the order of its set's ``items``.

    ``parts`` are (set, keys, item, value) tables. Sets are numbered in the order of ``items``; what was not fitted is
    null, and what is not listed is left out.
    """
    rows = reduce(DataFrame.unionByName, parts)
    listed = [(set_name(s), n, i, p) for i, (s, names) in enumerate(items.items()) for p, n in enumerate(names)]
    places = rows.sparkSession.createDataFrame(listed, "set string, item string, set_id int, pos int")
    placed = rows.join(F.broadcast(places), ["set", "item"])  # one row per item of the plan
    second = F.coalesce(F.get("keys", F.lit(1)), F.lit("")).alias("k2")
    placed = placed.select("set_id", F.get("keys", F.lit(0)).alias("k1"), second, "pos", "value")
    grouped = placed.groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("found"))
    length = F.get(F.lit([len(n) for n in items.values()]).cast("array<int>"), "set_id")
    known = F.map_from_entries("found")
    filled = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.try_element_at(known, i))
    values = F.when(F.size("found") == length, F.col("found.value")).otherwise(filled)
    return grouped.select(*GROUP, values.alias("values"))


@dataclass(frozen=True)
class Pick:
    """What becomes of the values of a row: ``base`` (an array column) and the values looked up stand one after the
    other, and element i of the result is that at ``first[i]``, plus the row's ``fold`` where ``step[i]`` is 1."""

    base: str
    first: list[int]
    step: list[int]
    fold: str

    def column(self, values: Column) -> Column:
        first, step = F.lit(self.first).cast("array<int>"), F.lit(self.step).cast("array<int>")
        return E.let(
            F.struct(F.concat(self.base, values).alias("x"), F.col(self.fold).alias("f")),
            lambda r: F.zip_with(first, step, lambda p, s: F.get(r["x"], p + s * r["f"])),
        )


def attach_values(
    df: DataFrame,
    lookup: DataFrame | None,
    items: dict[KeySet, list[str]],
    wanted: dict[KeySet, list[str]] | None = None,
    pick: Pick | None = None,
    max_cells: int | None = None,
) -> DataFrame:
    """Add the array<double> ``VALUES``: the ``wanted`` items (all of ``items``) of every set, one set after the other.

    ``lookup`` is a :func:`value_lookup` laid out by ``items``. Unknown groups and null keys give nulls. A lookup of bin
    numbers (array<tinyint>) gives those, 0 for what is unknown. ``pick`` makes another array of them. Sets whose numbers together stay within ``max_cells`` (BROADCAST_CELLS) travel to the tasks,
    where numpy picks each row's groups. All others are attached at once, however many they are: the rows are listed by
    (set, keys), joined to the lookup and gathered.
    """
    max_cells = BROADCAST_CELLS if max_cells is None else max_cells
    wanted = items if wanted is None else wanted
    order = list(items)
    ids = [order.index(s) for s in wanted]
    kind = "array<double>" if lookup is None else dict(lookup.dtypes)["values"]
    if not ids:
        empty = F.array().cast(kind)
        out = df.withColumn(VALUES, pick.column(empty) if pick else empty)
        return out.drop(pick.base, pick.fold) if pick else out
    counts = lookup.filter(F.col("set_id").isin(ids)).groupBy("set_id").agg(F.count("*").alias("n"))
    groups = {r["set_id"]: r["n"] for r in counts.collect()}  # one per set
    cells = {i: groups.get(i, 0) * (len(wanted[order[i]]) + 1) for i in ids}
    near, total = set(), 0
    for i in sorted(ids, key=cells.get):
        total += cells[i]
        if total <= max_cells:
            near.add(i)
    at = {order[i]: {n: p for p, n in enumerate(items[order[i]])} for i in ids}
    picks = {i: [at[order[i]][n] for n in wanted[order[i]]] for i in ids}
    whole = all(picks[i] == list(range(len(items[order[i]]))) for i in ids)
    part = lookup if whole else lookup.withColumn("values", _picked(picks, len(order)))

    out = df
    far = [i for i in ids if i not in near]
    if far:
        out = _gathered(out, part.filter(F.col("set_id").isin(far)), {i: order[i] for i in far})
    here = [i for i in ids if i in near]
    if here:
        sets = {i: (order[i], len(picks[i])) for i in here}
        out = _looked_up(out, part.filter(F.col("set_id").isin(here)), sets, None if far else pick)
    if not far:
        return out
    parts, start = [], 1
    for is_near, run in groupby(ids, key=near.__contains__):
        run = list(run)
        if is_near:
            size = sum(len(picks[i]) for i in run)
            parts.append(F.slice(VALUES, start, size))
            start += size
        else:
            missing = F.lit(0).cast("tinyint") if kind == "array<tinyint>" else F.lit(None).cast("double")
            none = [F.array_repeat(missing, len(picks[i])) for i in run]
            parts += [F.coalesce(F.try_element_at("_gathered", F.lit(i)), n) for i, n in zip(run, none)]
    values = F.concat(*parts)
    out = out.withColumn(VALUES, pick.column(values) if pick else values).drop("_gathered")
    return out.drop(pick.base, pick.fold) if pick else out


def _picked(picks: dict[int, list[int]], n_sets: int) -> Column:
    places = F.lit([picks.get(i, []) for i in range(n_sets)]).cast("array<array<int>>")
    return F.transform(F.get(places, "set_id"), lambda p: F.get("values", p))


def _gathered(df: DataFrame, lookup: DataFrame, sets: dict[int, KeySet]) -> DataFrame:
    """``df`` with ``_gathered``, a map from set number to values: one join on (set, keys) and one grouping by row.

    Keys that many rows share are counted first; their rows, and copies of their lookup row, are dealt over as many
    tasks as they need.
    """
    keyed = materialise(df.withColumn(ROW, F.monotonically_increasing_id()), "keyed-rows")
    numbers = F.lit(list(sets)).cast("array<int>")
    long = explode_sets(keyed, list(sets.values()), [ROW]).withColumn("set_id", F.get(numbers, "set_id"))
    n = keyed.count()
    share = F.ceil(F.col("n") * HOT_SHARE / max(1, n)).cast("int").alias("pieces")
    hot = long.groupBy(*GROUP).agg(F.count("*").alias("n")).filter(F.col("n") > n / HOT_SHARE).select(*GROUP, share)
    hot = F.broadcast(materialise(hot, "hot-keys"))  # HOT_SHARE rows per set at most
    pieces = F.coalesce("pieces", F.lit(1))
    dealt = long.join(hot, GROUP, "left").withColumn("piece", F.pmod(F.xxhash64(ROW), pieces).cast("int")).drop("pieces")
    copies = lookup.join(hot, GROUP, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("pieces")
    found = dealt.join(copies, [*GROUP, "piece"]).groupBy(ROW)
    found = found.agg(F.map_from_entries(F.collect_list(F.struct("set_id", "values"))).alias("_gathered"))
    return keyed.join(found, ROW, "left").drop(ROW)


def _looked_up(df: DataFrame, lookup: DataFrame, sets: dict[int, tuple[KeySet, int]], pick: Pick | None) -> DataFrame:
    """``df`` with ``VALUES`` of sets whose size the caller has checked: their lookups are sent to the tasks as matrices."""
    columns = list(dict.fromkeys(c for s, _ in sets.values() for c in s))
    coded = dict(lookup.dtypes)["values"] == "array<tinyint>"
    number = np.int8 if coded else float
    shared = df.sparkSession.sparkContext.broadcast(_matrices(lookup, sets, columns, number))
    base, fold = (pick.base, pick.fold) if pick else ("", "")
    total = len(pick.first) if pick else sum(w for _, w in sets.values())
    first, moved = (np.array(pick.first), np.flatnonzero(pick.step)) if pick else (None, None)
    keys = {f"_k{j}": F.col(c).cast("string") for j, c in enumerate(columns)}
    names, wide = [c for c in df.columns if c not in (base, fold)], BLOCK_NUMBERS

    def look_up(batches):
        known, plan = shared.value
        step = max(1, wide // max(1, total))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = [values[row] for row, values in _places(part, columns, known, plan)]
                if base:
                    own = part.column(part.schema.get_field_index(base)).flatten().to_numpy(zero_copy_only=False)
                    found = np.hstack([own.astype(number).reshape(part.num_rows, -1), *out])
                    result = found[:, first]
                    if len(moved):
                        slot = part.column(part.schema.get_field_index(fold)).to_numpy()
                        result[:, moved] = np.take_along_axis(found, first[moved] + slot[:, None], axis=1)
                else:
                    result = np.hstack(out)
                flat = pa.array(result.ravel(), from_pandas=True)
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * total)
                kept = [part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(ends, flat)], names=[*names, VALUES])

    kept = [f for f in df.schema.fields if f.name in names]
    schema = T.StructType([*kept, T.StructField(VALUES, T.ArrayType(T.ByteType() if coded else T.DoubleType()))])
    return df.withColumns(keys).mapInArrow(look_up, schema)


def _matrices(lookup: DataFrame, sets: dict[int, tuple[KeySet, int]], columns: list[str], number: type) -> tuple[dict, list]:
    """Values of every column, and by set its columns, its keys in order, their places, and a matrix of one row per key and a
    last one of what is unknown."""
    missing = 0 if number is np.int8 else np.nan
    table = lookup.toArrow()
    found = table.column("set_id").to_numpy() if table.num_rows else np.zeros(0, dtype=np.int32)
    of = {i: table.filter(pa.array(found == i)).combine_chunks() for i in sets}
    known = {
        c: pc.unique(pa.chunked_array([of[i].column(f"k{s.index(c) + 1}") for i, (s, _) in sets.items() if c in s], type=pa.string()))
        for c in columns
    }
    known = {c: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for c, v in known.items()}
    plan = []
    for i, (s, width) in sets.items():
        rows = of[i]
        codes = [pc.index_in(rows.column(f"k{k + 1}"), value_set=known[c]).to_numpy().astype(np.int64) for k, c in enumerate(s)]
        key = codes[0] if len(s) == 1 else codes[0] * len(known[s[1]]) + codes[1]
        flat = pc.list_flatten(rows.column("values")).to_numpy(zero_copy_only=False).astype(number)
        values = np.vstack([flat.reshape(len(key), width), np.full((1, width), missing, dtype=number)])
        by_key = np.argsort(key)
        plan.append((s, key[by_key], by_key, values))
    return known, plan


def _places(part: pa.RecordBatch, columns: list[str], known: dict, plan: list):
    """By set of the plan: the row of its matrix that each row of the batch gets, and the matrix."""
    code = {}
    for j, c in enumerate(columns):
        x = pc.index_in(part.column(part.schema.get_field_index(f"_k{j}")).cast(pa.string()), value_set=known[c])
        code[c] = pc.fill_null(x, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    for s, key, by_key, values in plan:
        own, ok = code[s[0]], code[s[0]] >= 0
        if len(s) > 1:
            own, ok = own * len(known[s[1]]) + code[s[1]], ok & (code[s[1]] >= 0)
        place = np.minimum(np.searchsorted(key, own), max(0, len(key) - 1))
        ok &= (key[place] == own) if len(key) else False
        yield np.where(ok, by_key[place] if len(key) else 0, len(values) - 1), values


def attached_sums(
    df: DataFrame, lookup: DataFrame | None, items: dict[KeySet, list[str]], pick: Pick, slots: int, by: str, max_cells: int | None = None
) -> DataFrame:
    """(by, pos, known, total): sums over known values of the array that :func:`attach_values` makes of all ``items``, per value
    of a column of few values.

    Every row's groups are looked up in its task. What rows take from the lookup is counted there, by group and ``pick.fold``
    (less than ``slots``), and the counted numbers are added up as often as they were taken, so no row gets a copy of them. A lookup too large for the tasks is attached instead.
    """
    max_cells = BROADCAST_CELLS if max_cells is None else max_cells
    order = list(items)
    width = len(pick.first)
    groups = {r["set_id"]: r["n"] for r in lookup.groupBy("set_id").agg(F.count("*").alias("n")).collect()}  # one per set
    if sum(groups.get(i, 0) * (len(items[s]) + 1) for i, s in enumerate(order)) > max_cells:
        return array_sums(attach_values(df, lookup, items, pick=pick, max_cells=max_cells), VALUES, width, by)
    sets = {i: (s, len(items[s])) for i, s in enumerate(order)}
    columns = list(dict.fromkeys(c for s in order for c in s))
    shared = df.sparkSession.sparkContext.broadcast(_matrices(lookup, sets, columns, float))
    first, step, wide = np.array(pick.first), np.array(pick.step), BLOCK_NUMBERS

    def sums(batches):
        known, plan = shared.value
        # By value of ``by``: sums of the rows' own numbers, and by set how often each row of its matrix is taken in each slot.
        own: dict = {}
        taken: dict = {}
        for batch in batches:
            rows = max(1, wide // max(1, len(batch.column(1)[0]) if batch.num_rows else 1))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                slot = part.column(2).to_numpy().astype(np.int64)
                each = pc.dictionary_encode(part.column(0), null_encoding="encode")
                names, group = each.dictionary.to_pylist(), each.indices.to_numpy()
                for g, name in enumerate(names):
                    mine = x if len(names) == 1 else x[group == g]
                    found = own.setdefault(name, (np.zeros(x.shape[1], dtype=np.int64), np.zeros(x.shape[1])))
                    found[0][:] += (~np.isnan(mine)).sum(axis=0)
                    found[1][:] += np.nansum(mine, axis=0)
                for k, (row, values) in enumerate(_places(part, columns, known, plan)):
                    n = np.bincount((group * len(values) + row) * slots + slot, minlength=len(names) * len(values) * slots)
                    for name, c in zip(names, n.reshape(len(names), len(values), slots)):
                        found = taken.setdefault(name, {}).setdefault(k, np.zeros((len(values), slots), dtype=np.int64))
                        found += c
        for name, (n, total) in own.items():
            one = np.arange(slots) == 0
            counts, totals = [n[:, None] * one], [np.where(one, total[:, None], 0.0)]
            for k, (*_, values) in enumerate(plan):
                counts.append(_weighted(~np.isnan(values), taken[name][k]))
                totals.append(_weighted(np.where(np.isnan(values), 0.0, values), taken[name][k]))
            n, total = np.vstack(counts), np.vstack(totals)
            still = step == 0
            known_of, total_of = np.zeros(width), np.zeros(width)
            known_of[still], total_of[still] = n[first[still]].sum(axis=1), total[first[still]].sum(axis=1)
            moved = first[~still][:, None] + np.arange(slots)
            known_of[~still], total_of[~still] = n[moved, np.arange(slots)].sum(axis=1), total[moved, np.arange(slots)].sum(axis=1)
            yield pa.RecordBatch.from_pydict(
                {
                    "g": pa.array([name] * width, type=pa.string()),
                    "pos": np.arange(width, dtype="int32"),
                    "known": np.rint(known_of).astype(np.int64),
                    "total": total_of,
                }
            )

    keys = [F.col(c).cast("string").alias(f"_k{j}") for j, c in enumerate(columns)]
    rows = df.select(F.col(by).cast("string").alias("g"), F.col(pick.base).alias("x"), F.col(pick.fold).alias("f"), *keys)
    per_task = rows.mapInArrow(sums, "g string, pos int, known long, total double")
    return per_task.groupBy(F.col("g").alias(by), "pos").agg(F.sum("known").alias("known"), F.sum("total").alias("total"))


def _weighted(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values``, each taken ``n`` times, for every column of ``n``: one row per column of values."""
    endless = np.isinf(values)
    if not endless.any():
        return values.astype(float).T @ n.astype(float)
    out = np.where(endless, 0.0, values).T @ n.astype(float)
    for sign in (np.inf, -np.inf):
        out += np.where((values == sign).T.astype(float) @ n.astype(float) > 0, sign, 0.0)
    return out


def spread_values(df: DataFrame, items: dict[KeySet, list[str]]) -> DataFrame:
    """The array of :func:`attach_values` as one column per item."""
    names = [n for each in items.values() for n in each]
    return df.withColumns({n: F.get(VALUES, F.lit(i)) for i, n in enumerate(names)}).drop(VALUES)
