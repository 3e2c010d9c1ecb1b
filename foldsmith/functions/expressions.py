"""Column expressions; every one is a built-in Spark expression with the null rules spelled out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip_to_one(x: Column) -> Column:
    """1 above 1, otherwise the value itself; null stays null (``least`` would turn it into 1)."""
    return F.when(x > 1, F.lit(1.0)).otherwise(x)


def ordinal_code(col: Column, levels: Sequence[str], default: float = -1.0) -> Column:
    """1-based position in ``levels``; anything else, null included, is ``default``."""
    code = F.array_position(F.array(*[F.lit(v) for v in levels]), col)
    return F.when(code > 0, code.cast("double")).otherwise(F.lit(float(default)))


def shifted_log(col: Column, shift: float = 2.0) -> Column:
    return F.ln(col + F.lit(shift))


def label_class(a: Column, b: Column, names: Sequence[str] = ("HS", "H", "S", "N")) -> Column:
    """Class of two 0/1 labels: both, first only, second only, everything else (null included)."""
    both, first, second, none = names
    return (
        F.when((a == 1) & (b == 1), F.lit(both))
        .when((a == 1) & (b == 0), F.lit(first))
        .when((a == 0) & (b == 1), F.lit(second))
        .otherwise(F.lit(none))
    )


def label_any(cls: Column, none: str = "N", some: str = "Y") -> Column:
    return F.when(cls == none, F.lit(none)).otherwise(F.lit(some))


def is_outlier(x: Column, mean: Column, sd: Column, width: float = 1.5) -> Column:
    """True outside mean +- width*sd; a missing operand is not an outlier."""
    beyond = (x < mean - F.lit(width) * sd) | (x > mean + F.lit(width) * sd)
    return F.coalesce(beyond, F.lit(False))


def quoted(name: str) -> str:
    """A column name for SQL text. Wide plans are written as text: one call per number, not one per operator."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """A string literal for SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_outlier_sql(x: str, mean: str, sd: str, width: float = 1.5) -> str:
    """:func:`is_outlier` as SQL text over column names."""
    x, mean, sd, w = quoted(x), quoted(mean), quoted(sd), f"{float(width)!r}D"
    return f"coalesce({x} < {mean} - {w} * {sd} OR {x} > {mean} + {w} * {sd}, false)"


def min_max(x: Column, lo: Column, hi: Column) -> Column:
    return F.try_divide(x - lo, hi - lo)


def finite(x: Column) -> Column:
    """NaN as null: Spark orders NaN above every number, so it must not enter comparisons."""
    return F.when(~F.isnan(x), x)


def hash32(*parts: Column) -> Column:
    """First 32 bits of the md5 of the parts joined with '|': the same number on any engine."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def bucket(seed: int, key: Column, buckets: int, *salt: Column) -> Column:
    return F.pmod(hash32(F.lit(str(seed)), *salt, key), F.lit(buckets)).cast("int")


def uniform(seed: int, index: int, key: Column) -> Column:
    """Uniform (0, 1) number fixed by seed, column index and row key, whatever the partitioning."""
    return (hash32(F.lit(str(seed)), F.lit(str(index)), key) + F.lit(0.5)) / F.lit(float(1 << 32))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pick(array: str, positions: Sequence[int]) -> Column:
    """The elements at ``positions``, as an array: one lambda however many there are."""
    wanted = F.lit(list(positions)).cast("array<int>")
    return let(F.col(array), lambda x: F.transform(wanted, lambda p: F.get(x, p)))


def pearson(n: Column, si: Column, sj: Column, sii: Column, sjj: Column, sij: Column) -> Column:
    """Correlation from summed moments; null unless both variances are positive."""
    cov = sij - si * sj / n
    vi, vj = sii - si * si / n, sjj - sj * sj / n
    tiny = F.lit(1e-12)
    ok = (n > 1) & (vi > tiny * sii) & (vj > tiny * sjj)
    return F.when(ok, cov / F.sqrt(vi * vj))
