"""Group statistics: mean, median, min, max per category or pair, plain and normalised."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsmith.functions import expressions as E
from foldsmith.functions.names import category_pairs, set_name
from foldsmith.operators import histograms
from foldsmith.operators.keysets import (
    GROUP,
    KeySet,
    attach_set,
    attach_values,
    explode_sets,
    grouping_sets_agg,
    named_groups,
    numbered_groups,
    spread_values,
    value_lookup,
)
from foldsmith.operators.medians import DIRECT_ROWS, fits_direct, wide_medians
from foldsmith.scratch import attach, materialise

STATS = ("mean", "med", "min", "max")
OUTLIER_WIDTH = 1.5
# How many rows a row of counted_groups stands for.
ROWS = "_rows"
# Numbers aggregated per pass: keeps each aggregate inside generated code.
CHUNK = 24
# Chunks whose medians are found side by side: each is a row of short Spark jobs.
CHUNKS_AT_ONCE = 4


def single_sets(categories: tuple[str, ...]) -> list[KeySet]:
    return [(c,) for c in categories]


def pair_sets(categories: tuple[str, ...], mode: str = "all") -> list[KeySet]:
    return [(categories[i], categories[j]) for i, j in category_pairs(len(categories), mode)]


def _chunks(names: list[str]) -> list[list[str]]:
    return [names[i : i + CHUNK] for i in range(0, len(names), CHUNK)]


def _long(wide: DataFrame, nums: list[str], fields: tuple[str, ...]) -> DataFrame:
    """Wide aggregates named ``<field>_<position>`` to one row per number."""
    each = [
        f"named_struct('num', {E.text(n)}, " + ", ".join(f"'{f}', {f}_{i}" for f in fields) + ")" for i, n in enumerate(nums)
    ]
    return wide.selectExpr("set", "keys", f"inline(array({', '.join(each)}))")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _value_rows(groups: DataFrame, nums: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per group row and number: GROUP columns, those carried along, ``num_id`` and ``value``."""
    each = [f"named_struct('num_id', {i}, 'value', CAST({E.quoted(n)} AS DOUBLE))" for i, n in enumerate(nums)]
    return groups.select(*GROUP, *carry, F.expr(f"inline(array({', '.join(each)}))"))


def _medians(
    rows: DataFrame,
    own: list[KeySet] | None,
    sets: list[KeySet],
    nums: list[str],
    cuts: list[np.ndarray] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """(set, keys, num, med) by counts of cells; ``own`` is None if ``rows`` has GROUP columns, else the sets."""
    med = wide_medians(rows, own, nums, cuts, weight=weight)
    num = F.get(F.array(*[F.lit(n) for n in nums]), "num_id").alias("num")
    return named_groups(med.select(*GROUP, num, "med"), sets)


def counted_groups(df: DataFrame, sets: list[KeySet], columns: list[str]) -> DataFrame:
    """The distinct values of the columns in every group (GROUP columns), and in ROWS how many rows have them: all that the
    statistics of numbers made of these columns need."""
    every = [E.quoted(c) for c in dict.fromkeys([*[c for s in sets for c in s], *columns])]
    long = explode_sets(df.groupBy(*every).agg(F.count("*").alias(ROWS)), sets, [*columns, ROWS])
    counted = long.groupBy(*GROUP, *[E.quoted(c) for c in columns]).agg(F.sum(ROWS).alias(ROWS))
    return materialise(counted, "counted-groups")


def _by_group(df: DataFrame, sets: list[KeySet], aggs: list[Column], weight: str | None) -> DataFrame:
    """(set, keys, aggregates) of rows, or of :func:`counted_groups`."""
    return named_groups(df.groupBy(*GROUP).agg(*aggs), sets) if weight else grouping_sets_agg(df, sets, aggs)


def _count(x: str, weight: str | None) -> str:
    return f"coalesce(sum(CASE WHEN {x} IS NOT NULL THEN {E.quoted(weight)} END), 0)" if weight else f"count({x})"


def _mean(x: str, weight: str | None) -> str:
    if not weight:
        return f"avg({x})"
    # A number that is the same in all rows is its own mean, to the last digit.
    w = E.quoted(weight)
    mean = f"sum(CAST({x} AS DOUBLE) * {w}) / nullif(sum(CASE WHEN {x} IS NOT NULL THEN {w} END), 0)"
    return f"CASE WHEN min({x}) = max({x}) THEN CAST(min({x}) AS DOUBLE) ELSE {mean} END"


def _median(x: str, weight: str | None) -> str:
    return f"percentile({x}, 0.5D, {E.quoted(weight)})" if weight else f"median({x})"


def fit_group_stats(
    df: DataFrame, sets: list[KeySet], nums: list[str], direct_rows: int = DIRECT_ROWS, weight: str | None = None
) -> DataFrame:
    """(set, keys, num, n, mean, med, min, max) over every group set and number.

    Everything but the median aggregates in one pass per chunk of numbers. The median shares that
    pass while the table is small enough for its buffers, else it is found by counts of cells.
    With ``weight`` the table is one of :func:`counted_groups` of the sets, whose rows stand for so many.
    """
    direct = fits_direct(df, direct_rows, min(len(nums), CHUNK))
    fields = ("n", "mean", "min", "max") + (("med",) if direct else ())
    parts = []
    for chunk in _chunks(nums):
        aggs = []
        for i, c in enumerate(chunk):
            x = E.quoted(c)
            aggs += [f"{_count(x, weight)} AS n_{i}", f"{_mean(x, weight)} AS mean_{i}"]
            aggs += [f"CAST(min({x}) AS DOUBLE) AS min_{i}", f"CAST(max({x}) AS DOUBLE) AS max_{i}"]
            if direct:
                aggs.append(f"{_median(x, weight)} AS med_{i}")
        aggs = [F.expr(a) for a in aggs]
        parts.append(_long(_by_group(df, sets, aggs, weight), chunk, fields))
    stats = _union(parts)
    if not direct:
        med = _medians(df, None if weight else sets, sets, list(nums), weight=weight)
        stats = stats.join(med, ["set", "keys", "num"], "left")
    return stats.select("set", "keys", "num", "n", *STATS)


def fit_bounds(df: DataFrame, sets: list[KeySet], nums: list[str], weight: str | None = None) -> DataFrame:
    """(set, keys, num, mean, sd): what the outlier rule needs, fitted on training rows.

    With ``weight`` the table is one of :func:`counted_groups` of the sets, whose rows stand for so many.
    """
    shift = _middles(df, nums, weight) if weight else {}
    parts = []
    for chunk in _chunks(nums):
        aggs = []
        for i, c in enumerate(chunk):
            x = E.quoted(c)
            sd = _spread(x, weight, shift[c]) if weight else f"stddev_samp({x})"
            aggs += [F.expr(f"{_mean(x, weight)} AS mean_{i}"), F.expr(f"{sd} AS sd_{i}")]
        parts.append(_long(_by_group(df, sets, aggs, weight), chunk, ("mean", "sd")))
    return _union(parts)


def _middles(df: DataFrame, nums: list[str], weight: str) -> dict[str, float]:
    """The mean of every number, 0 where there is none; one number each reaches the driver."""
    out: dict[str, float] = {}
    for chunk in _chunks(nums):
        found = df.agg(*[F.expr(f"{_mean(E.quoted(c), weight)} AS m_{i}") for i, c in enumerate(chunk)]).first()
        out.update({c: m if m is not None and np.isfinite(m) else 0.0 for c, m in zip(chunk, found)})
    return out


def _spread(x: str, weight: str, shift: float) -> str:
    """stddev_samp of weighted rows, by moments around a number near the values, which keeps their digits."""
    w, v = E.quoted(weight), f"(CAST({x} AS DOUBLE) - {shift!r}D)"
    n, s, ss = f"sum(CASE WHEN {x} IS NOT NULL THEN {w} END)", f"sum({v} * {w})", f"sum({v} * {v} * {w})"
    sd = f"sqrt(greatest({ss} - {s} * {s} / {n}, 0D) / ({n} - 1))"
    return f"CASE WHEN {n} > 1 THEN CASE WHEN min({x}) = max({x}) THEN 0D ELSE {sd} END END"


def _kept(
    df: DataFrame,
    bounds: DataFrame,
    sets: list[KeySet],
    nums: list[str],
    width: float,
    carry: tuple[str, ...] = (),
    grouped: bool = False,
) -> DataFrame:
    """GROUP columns, those carried along, and the numbers, null where the outlier rule takes the value out.

    ``grouped`` rows have GROUP columns already.
    """
    per_group = numbered_groups(bounds, sets).groupBy(*GROUP).agg(
        *[
            F.expr(f"max(CASE WHEN num = {E.text(n)} THEN {f} END) AS _{f}_{i}")
            for i, n in enumerate(nums)
            for f in ("mean", "sd")
        ]
    )
    listed = df.select(*GROUP, *carry, *nums) if grouped else explode_sets(df, sets, [*carry, *nums])
    rows = attach(listed, per_group, GROUP)

    def kept(i: int, n: str) -> str:
        out = E.is_outlier_sql(n, f"_mean_{i}", f"_sd_{i}", width)
        return f"CASE WHEN NOT {out} THEN {E.quoted(n)} END AS {E.quoted(n)}"

    return rows.selectExpr(*GROUP, *[E.quoted(c) for c in carry], *[kept(i, n) for i, n in enumerate(nums)])


def outlier_flags(
    df: DataFrame, bounds: DataFrame, category: str, nums: list[str], width: float = OUTLIER_WIDTH
) -> DataFrame:
    """Add ``<num>_outlier`` 0/1 against the bounds of the row's category."""
    per_key = bounds.filter(F.col("set") == category).groupBy("keys").agg(
        F.map_from_entries(F.collect_list(F.struct("num", F.struct("mean", "sd")))).alias("_b")
    )
    out = attach_set(df, per_key, (category,))
    flags = {
        f"{n}_outlier": E.is_outlier(F.col(n), F.col("_b")[n]["mean"], F.col("_b")[n]["sd"], width).cast("int")
        for n in nums
    }
    return out.withColumns(flags).drop("_b")


def kept_rows(
    df: DataFrame, bounds: DataFrame, sets: list[KeySet], nums: list[str], width: float = OUTLIER_WIDTH
) -> DataFrame:
    """(set, keys, num, value): every known value the outlier rule keeps in its category."""
    parts = []
    for chunk in _chunks(nums):
        values = _value_rows(_kept(df, bounds, sets, chunk, width), chunk).filter(F.col("value").isNotNull())
        num = F.get(F.array(*[F.lit(n) for n in chunk]), "num_id").alias("num")
        parts.append(named_groups(values.select(*GROUP, num, "value"), sets))
    return _union(parts)


def normalised_rows(
    df: DataFrame,
    bounds: DataFrame,
    category: str,
    num: str,
    width: float = OUTLIER_WIDTH,
    salt_on: list[str] | None = None,
) -> DataFrame:
    """Non-outlier rows with ``<num>_normalized``, scaled to 0..1 within the row's category."""
    flagged = outlier_flags(df.filter(F.col(category).isNotNull()), bounds, category, [num], width)
    kept = flagged.filter(F.col(f"{num}_outlier") == 0).drop(f"{num}_outlier")
    ends = materialise(kept.groupBy(category).agg(F.min(num).alias("_lo"), F.max(num).alias("_hi")), "ends")
    scaled = E.min_max(F.col(num), F.col("_lo"), F.col("_hi"))
    return attach(kept, ends, [category], "left", salt_on).withColumn(f"{num}_normalized", scaled).drop("_lo", "_hi")


def normalised_values(
    df: DataFrame, bounds: DataFrame, sets: list[KeySet], nums: list[str], key: str, width: float = OUTLIER_WIDTH
) -> DataFrame:
    """(key, set, keys, num, value): every known non-outlier of every set, scaled to 0..1 within its group; one pass for all."""
    parts = []
    for chunk in _chunks(nums):
        long = _value_rows(_kept(df, bounds, sets, chunk, width, (key,)), chunk, (key,)).filter(F.col("value").isNotNull())
        group = [*GROUP, "num_id"]
        ends = materialise(long.groupBy(*group).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi")), "ends")
        out = attach(long, ends, group, "left", [key])
        num = F.get(F.array(*[F.lit(n) for n in chunk]), "num_id").alias("num")
        scaled = E.min_max(F.col("value"), F.col("_lo"), F.col("_hi")).alias("value")
        parts.append(named_groups(out.select(*GROUP, key, num, scaled), sets).select(key, "set", "keys", "num", "value"))
    return _union(parts)


def fit_normalised_stats(
    df: DataFrame,
    bounds: DataFrame,
    sets: list[KeySet],
    nums: list[str],
    width: float = OUTLIER_WIDTH,
    direct_rows: int = DIRECT_ROWS,
    weight: str | None = None,
) -> DataFrame:
    """(set, keys, num, mean, med, min, max) of min-max scaled non-outliers.

    Scaling is affine, so the scaled mean and median follow from the unscaled ones: one pass over
    the kept values, no second one over scaled rows. With ``weight`` the table is one of :func:`counted_groups` of the sets.
    """
    direct = fits_direct(df, direct_rows, min(len(nums), CHUNK))
    bounds = materialise(bounds, "bounds")
    fields = ("lo", "hi", "mean") + (("med",) if direct else ())
    cuts = None if direct else dict(zip(nums, histograms.fit_cuts(df, nums)))

    def part_of(chunk: list[str]) -> DataFrame:
        rows = _kept(df, bounds, sets, chunk, width, (weight,) if weight else (), bool(weight))
        aggs = []
        for i, c in enumerate(chunk):
            x = E.quoted(c)
            aggs += [f"CAST(min({x}) AS DOUBLE) AS lo_{i}", f"CAST(max({x}) AS DOUBLE) AS hi_{i}", f"{_mean(x, weight)} AS mean_{i}"]
            if direct:
                aggs.append(f"{_median(x, weight)} AS med_{i}")
        part = _long(named_groups(rows.groupBy(*GROUP).agg(*[F.expr(a) for a in aggs]), sets), chunk, fields)
        if not direct:
            med = _medians(rows, None, sets, chunk, [cuts[n] for n in chunk], weight)
            part = part.join(med, ["set", "keys", "num"], "left")
        return part

    with ThreadPoolExecutor(CHUNKS_AT_ONCE) as pool:
        parts = list(pool.map(part_of, _chunks(nums)))
    raw = _union(parts)
    lo, hi = F.col("lo"), F.col("hi")
    spread = hi > lo
    return raw.select(
        "set",
        "keys",
        "num",
        F.when(spread, E.min_max(F.col("mean"), lo, hi)).alias("mean"),
        F.when(spread, E.min_max(F.col("med"), lo, hi)).alias("med"),
        F.when(spread, F.lit(0.0)).alias("min"),
        F.when(spread, F.lit(1.0)).alias("max"),
    )


def stat_name(s: KeySet, num: str, stat: str, normalised: bool = False) -> str:
    return f"{set_name(s)}_{num}_{'normalized_' * normalised}{stat}"


def stat_names(sets: list[KeySet], nums: list[str], normalised: bool = False) -> list[str]:
    return [stat_name(s, n, f, normalised) for s in sets for n in nums for f in STATS]


def stat_items(artifact: DataFrame, normalised: bool = False) -> DataFrame:
    """(set, keys, item, value) for a lookup, items named like the columns they become."""
    middle = [F.lit("normalized")] if normalised else []
    each = F.array(
        *[
            F.struct(F.concat_ws("_", "set", "num", *middle, F.lit(f)).alias("item"), F.col(f).alias("value"))
            for f in STATS
        ]
    )
    return artifact.select("set", "keys", F.inline(each))


def attach_group_stats(
    df: DataFrame,
    artifact: DataFrame,
    sets: list[KeySet],
    nums: list[str],
    normalised: bool = False,
) -> DataFrame:
    """Add ``<set>_<num>_<stat>`` columns; rows with a null or unseen key get nulls."""
    items = {s: stat_names([s], nums, normalised) for s in sets}
    lookup = materialise(value_lookup([stat_items(artifact, normalised)], items), "stats-lookup")
    return spread_values(attach_values(df, lookup, items), items)
