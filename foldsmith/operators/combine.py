"""Boolean combinations of 0/1 flags, as columns (small role sets) or as one array column."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsmith.functions import expressions as E
from foldsmith.functions.names import TRIPLE_FORMS, TripleForm, flag_pairs, flag_triples, pair_column

# Tasks carry these helpers with them, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLIPPED = "_comb"
# Numbers per block of a task.
BLOCK_NUMBERS = 1 << 21


def _triple_value(form: TripleForm, a: Column, b: Column, c: Column) -> Column:
    b = 1 - b if form.not_b else b
    c = 1 - c if form.not_c else c
    return (a * b if form.join == "and" else a + b) + c


def pair_columns(flags: tuple[str, ...], mode: str = "all") -> dict[str, Column]:
    out = {}
    for i, j in flag_pairs(len(flags), mode):
        name = pair_column(flags[i], flags[j])
        value = F.col(flags[i]) + F.col(flags[j])
        out[name] = value
        out[name + CLIPPED] = E.clip_to_one(value)
    return out


def triple_columns(flags: tuple[str, ...], form: TripleForm, mode: str = "all") -> dict[str, Column]:
    out = {}
    for i, j, k in flag_triples(len(flags), mode):
        name = form.column(flags[i], flags[j], flags[k])
        value = _triple_value(form, F.col(flags[i]), F.col(flags[j]), F.col(flags[k]))
        out[name] = value
        out[name + CLIPPED] = E.clip_to_one(value)
    return out


def combination_names(flags: tuple[str, ...], mode: str = "all") -> list[tuple[str, str]]:
    """(name, kind) of every combination in the order of :func:`combination_array`."""
    pairs = [pair_column(flags[i], flags[j]) for i, j in flag_pairs(len(flags), mode)]
    triples = [
        form.column(flags[i], flags[j], flags[k])
        for form in TRIPLE_FORMS
        for i, j, k in flag_triples(len(flags), mode)
    ]
    return [(n, "comb_sum") for n in pairs + triples] + [(n + CLIPPED, "comb") for n in pairs + triples]


def _triple_array(form: TripleForm, x: Column, triples: Column) -> Column:
    return F.transform(
        triples, lambda t: _triple_value(form, F.get(x, t["a"]), F.get(x, t["b"]), F.get(x, t["c"]))
    )


def combination_array(flags: tuple[str, ...], mode: str = "all") -> Column:
    """All pairs and all triple forms, then their clipped twins, as one array<double>.

    The plan holds one lambda per form over a constant list of index triples, so its size does not
    depend on how many combinations there are.
    """
    pairs = flag_pairs(len(flags), mode)
    if not pairs:
        return F.array().cast("array<double>")
    triples = flag_triples(len(flags), mode)

    def values(x: Column) -> Column:
        picks = [F.struct(F.lit(i).alias("a"), F.lit(j).alias("b")) for i, j in pairs]
        parts = [F.transform(F.array(*picks), lambda t: F.get(x, t["a"]) + F.get(x, t["b"]))]
        if triples:
            picks = [
                F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.lit(k).alias("c")) for i, j, k in triples
            ]
            parts += [_triple_array(form, x, F.array(*picks)) for form in TRIPLE_FORMS]
        return F.concat(*parts)

    flags_array = F.array(*[F.col(f).cast("double") for f in flags])
    return E.let(E.let(flags_array, values), lambda raw: F.concat(raw, F.transform(raw, E.clip_to_one)))


def with_combinations(
    df: DataFrame, flags: tuple[str, ...], name: str, mode: str = "all", positions: list[int] | None = None
) -> DataFrame:
    """``df`` with :func:`combination_array`, or what it has at ``positions``, as a column made by numpy from blocks of rows."""
    pairs = np.array(flag_pairs(len(flags), mode), dtype=int).reshape(-1, 2)
    if not len(pairs):
        return df.withColumn(name, combination_array(flags, mode))
    triples = np.array(flag_triples(len(flags), mode), dtype=int).reshape(-1, 3)
    forms = [(f.join == "and", f.not_b, f.not_c) for f in TRIPLE_FORMS] if len(triples) else []
    every, kept, most = 2 * (len(pairs) + len(forms) * len(triples)), list(df.columns), BLOCK_NUMBERS
    at = list(range(every)) if positions is None else list(positions)
    width = len(at)

    def combine(batches):
        step = max(1, most // every)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                columns = [part.column(len(kept) + i) for i in range(len(flags))]
                x = np.array([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])
                none = np.array([pc.is_null(c).to_numpy(zero_copy_only=False) for c in columns])
                values, nulls = _combined(x, none, pairs, triples, forms)
                flat = pa.array(np.ascontiguousarray(values[at].T).ravel(), mask=np.ascontiguousarray(nulls[at].T).ravel())
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * width)
                own = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(ends, flat)], names=[*kept, name])

    given = df.select("*", *[F.col(f).cast("double").alias(f"_flag_{i}") for i, f in enumerate(flags)])
    return given.mapInArrow(combine, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def _combined(x: np.ndarray, none: np.ndarray, pairs: np.ndarray, triples: np.ndarray, forms: list) -> tuple[np.ndarray, np.ndarray]:
    """Values and nulls of all combinations, then of their clipped twins, one row each; ``x`` and ``none`` have a row per flag."""
    a, b = pairs.T
    values, nulls = [x[a] + x[b]], [none[a] | none[b]]
    for join_and, not_b, not_c in forms:
        a, b, c = triples.T
        second, third = (1 - x[b] if not_b else x[b]), (1 - x[c] if not_c else x[c])
        values.append((x[a] * second if join_and else x[a] + second) + third)
        nulls.append(none[a] | none[b] | none[c])
    raw, nulls = np.vstack(values), np.vstack(nulls)
    # NaN is above 1, as for every comparison in Spark.
    return np.vstack([raw, np.where((raw > 1) | np.isnan(raw), 1.0, raw)]), np.vstack([nulls, nulls])


def clipped_columns(flags: tuple[str, ...], mode: str = "all", limit: int | None = None) -> dict[str, Column]:
    """The first ``limit`` clipped combinations: pairs, then the triple forms in order."""
    out = {n: c for n, c in pair_columns(flags, mode).items() if n.endswith(CLIPPED)}
    for form in TRIPLE_FORMS:
        if limit is not None and len(out) >= limit:
            break
        out.update({n: c for n, c in triple_columns(flags, form, mode).items() if n.endswith(CLIPPED)})
    return dict(list(out.items())[:limit])


def clipped_names(flags: tuple[str, ...], mode: str = "all", limit: int | None = None) -> list[str]:
    """Names of :func:`clipped_columns`; needs no session."""
    return list(dict.fromkeys(n for n, kind in combination_names(flags, mode) if kind == "comb"))[:limit]


def add_combinations(df: DataFrame, flags: tuple[str, ...], mode: str = "all") -> DataFrame:
    cols = pair_columns(flags, mode)
    for form in TRIPLE_FORMS:
        cols.update(triple_columns(flags, form, mode))
    return df.withColumns(cols)
