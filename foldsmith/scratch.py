"""Session helpers: where intermediate tables live, and lookups that check what they broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup is broadcast only when its counted cells (rows x columns) stay at or below this.
BROADCAST_CELLS = 4_000_000
# Copies made of a lookup that is too large to broadcast, so a hot key spreads over as many tasks.
SALT_BUCKETS = 32


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``; a local folder only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foldsmith-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Paths stored inside each open ``short_lived`` block.
_BLOCKS: list[list[str]] = []


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    ``keep`` leaves the table in place at the end of a ``short_lived`` block.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _BLOCKS and not keep:
        _BLOCKS[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def short_lived(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the tables stored inside; nothing that is used later may read them."""
    _BLOCKS.append([])
    try:
        yield
    finally:
        for path in _BLOCKS.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _cells(lookup: DataFrame) -> int:
    """Values in the table; a list or map has as many as entries."""
    nested = [c for c, kind in lookup.dtypes if kind.startswith(("array", "map"))]
    plain = len(lookup.columns) - len(nested)
    each = F.lit(plain)
    for c in nested:
        each = each + F.coalesce(F.size(c), F.lit(0))
    return lookup.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]


def attach(
    df: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "left",
    salt_on: list[str | Column] | None = None,
    max_cells: int = BROADCAST_CELLS,
    cells: int | None = None,
) -> DataFrame:
    """Equi-join ``df`` to a many-to-one lookup.

    The lookup is counted first, unless its size is given in ``cells``. Small: broadcast, so ``df`` does not move. Large: both sides
    shuffle on the key plus a salt taken from the row, so one hot (or null) key never lands in a
    single task.
    """
    if cells is None:
        cells = _cells(lookup)
    if cells <= max_cells:
        return df.join(F.broadcast(lookup), on, how)
    return salted_join(df, lookup, on, how, salt_on)


def salted_join(
    df: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "left",
    salt_on: list[str | Column] | None = None,
    buckets: int = SALT_BUCKETS,
) -> DataFrame:
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*(salt_on or df.columns)), F.lit(buckets)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
