"""Splits and samples decided by a hash of the row key, so a row always lands on the same side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsmith.functions import expressions as E

SPLIT = "split"
# Shares are kept to one in a million.
GRAIN = 1_000_000


def sample(df: DataFrame, key: str, share: float = 0.1, seed: int = 1) -> DataFrame:
    return df.filter(E.bucket(seed, F.col(key), GRAIN) < round(share * GRAIN))


def holdout(df: DataFrame, key: str, share: float = 0.2, seed: int = 100) -> DataFrame:
    """Add ``split``: 'holdout' for about ``share`` of the keys, else 'train'."""
    held = E.bucket(seed, F.col(key), GRAIN) < round(share * GRAIN)
    return df.withColumn(SPLIT, F.when(held, "holdout").otherwise("train"))


def fold_column(repeat: int) -> str:
    return f"fold_{repeat}"


def folds(df: DataFrame, key: str, n_folds: int = 5, repeats: int = 5, seed: int = 100) -> DataFrame:
    """One fold number per repeat, as columns ``fold_0 .. fold_<repeats-1>``; rows are not copied."""
    return df.withColumns(
        {fold_column(r): E.bucket(seed, F.col(key), n_folds, F.lit(str(r))) for r in range(repeats)}
    )


def probes(df: DataFrame, key: str, n: int = 10, seed: int = 1, prefix: str = "rand") -> DataFrame:
    """Random uniform columns ``rand1..randN`` that useful features must beat."""
    return df.withColumns({f"{prefix}{i}": E.uniform(seed, i, F.col(key)) for i in range(1, n + 1)})


def probe_names(n: int = 10, prefix: str = "rand") -> list[str]:
    return [f"{prefix}{i}" for i in range(1, n + 1)]
