"""Joins whose broadcast side is counted first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsmith.scratch import BROADCAST_CELLS, materialise

# A key is dealt over several tasks if it has more rows than this, and more than one in HOT_KEYS of all rows.
LEAST_ROWS, HOT_KEYS = 1000, 10_000


def look_up(df: DataFrame, table: DataFrame, on: list[str], how: str = "left", cells: int | None = None) -> DataFrame:
    """Join to a stored table with one row per key: broadcast while it is small, else by shuffling both sides.

    ``cells`` is the number of values in the table, where lists make it more than rows times columns.
    """
    if cells is None:
        cells = table.count() * len(table.columns)
    return df.join(F.broadcast(table) if cells <= BROADCAST_CELLS else table, on, how)


def spread_join(df: DataFrame, lookup: DataFrame, on: list[str], place: list[str], how: str = "left") -> DataFrame:
    """Join to a stored table with one row per key and ``n``, the rows of ``df`` that have the key.

    Both sides are shuffled by the key. The keys with very many rows, HOT_KEYS at most, are broadcast: their rows are
    dealt by a hash of ``place`` over as many tasks as they need, and only their lookup rows are copied.
    """
    total = lookup.agg(F.sum("n")).first()[0] or 0
    most = max(LEAST_ROWS, total // HOT_KEYS)
    pieces = F.greatest(F.ceil(F.col("n") / most), F.lit(1)).cast("int")
    hot = F.broadcast(materialise(lookup.filter(F.col("n") > most).select(*on, pieces.alias("_pieces")), "hot-keys"))
    copies = lookup.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("n")
    return _dealt(df, hot, on, place).join(copies, [*on, "_piece"], how).drop("_piece")


def deal_join(df: DataFrame, lookup: DataFrame, on: list[str], place: list[str], how: str = "inner") -> DataFrame:
    """Like ``spread_join``, with a lookup that has no counts: the rows of ``df`` are counted by key here.

    Only the lookup's rows of the counted hot keys are copied, so wide ones, such as sets, are shuffled once.
    """
    counts = df.groupBy(*on).agg(F.count("*").alias("n"))
    most = max(LEAST_ROWS, df.count() // HOT_KEYS)
    pieces = F.ceil(F.col("n") / most).cast("int")
    hot = F.broadcast(materialise(counts.filter(F.col("n") > most).select(*on, pieces.alias("_pieces")), "hot-keys"))
    copied = F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))
    copies = lookup.join(hot, on, "left").withColumn("_piece", copied).drop("_pieces")
    return _dealt(df, hot, on, place).join(copies, [*on, "_piece"], how).drop("_piece")


def _dealt(df: DataFrame, hot: DataFrame, on: list[str], place: list[str]) -> DataFrame:
    piece = F.pmod(F.xxhash64(*place), F.coalesce("_pieces", F.lit(1))).cast("int")
    return df.join(hot, on, "left").withColumn("_piece", piece).drop("_pieces")
