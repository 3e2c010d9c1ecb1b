"""Shards in random order by a two-pass external shuffle. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldsmith.llm.tables import look_up
from foldsmith.scratch import materialise

BUCKET_BYTES = 16 << 20
ROW_BYTES = 16
SEED = 8191
GROUP = 1024
# Copies of one row that a task writes out at once; copies are numbered if they would fill more than 1 / CROWDED of a bucket.
COPIES, CROWDED = 1000, 4


def size_of(text: str) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + ROW_BYTES).cast("long")


def _offsets(counts: DataFrame) -> DataFrame:
    """(bucket, offset): rows of all earlier buckets, summed in groups so that no task sees all buckets."""
    grouped = materialise(counts.withColumn("grp", F.floor(F.col("bucket") / GROUP)), "bucket-counts")
    before = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("grp").agg(F.sum("rows").alias("rows"))
    groups = groups.select("grp", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("grp").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = grouped.withColumn("inside", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
    return placed.join(groups, "grp").select("bucket", (F.col("base") + F.col("inside")).alias("offset"))


def shard(docs: DataFrame, n_shards: int, path: str, text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes ``docs`` to ``path`` in shards and returns what was written: its columns, shard and slot.

    First pass: a seeded hash of the whole row scatters rows uniformly into buckets of about ``bucket_bytes``.
    Second pass: each bucket is put in a fixed order, Fisher-Yates shuffled (``shuffle``) and written. The buckets one
    after the other are a random order of all rows; shard s is its s-th part, so that counts are at most one
    apart, and ``slot`` is the place inside the shard, gapless from 0. The order follows from the rows, the seed and
    ``bucket_bytes``, whatever the files or tasks the rows come in.

    Null texts count 16 bytes. Copies scatter, with different keys or, if they would crowd a bucket, equal in every column. Columns of ``docs`` called
    shard or slot give way to the new ones; any other names may occur. A very long text is a row like any other; a
    bucket holds one of any length. An empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    total, rows = docs.agg(F.sum(size_of(text)), F.count("*")).first()
    n_buckets = max(1, math.ceil((total or 0) / bucket_bytes))
    code = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in names])
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    hashed = _numbered(docs.select(code.alias("code"), size_of(text).alias("size"), row.alias("row")), n_buckets, seed, bucket_bytes)
    offsets = materialise(_offsets(hashed.groupBy("bucket").agg(F.count("*").alias("rows"))), "bucket-offsets")

    # Bucket b is partition b and nothing else is, so the random numbers that its rows get follow from seed and b alone.
    scattered = hashed.repartitionById(n_buckets, F.col("bucket")).groupBy("bucket")
    filled = scattered.agg(F.sort_array(F.collect_list(F.struct("code", "copy", "row"))).alias("rows"))
    shuffled = look_up(filled.select("bucket", F.shuffle("rows", seed).alias("rows")), offsets, ["bucket"])
    placed = shuffled.select("offset", F.posexplode("rows").alias("pos", "item"))
    place = F.col("offset") + F.col("pos")
    # Whole-number division: shard s begins at place ceil(s * rows / n_shards).
    number = F.expr("(offset + pos) * {n} div {rows}".format(n=n_shards, rows=max(1, rows)))
    begin = F.ceil(number.cast("decimal(38,0)") * rows / F.lit(n_shards).cast("decimal(38,0)")).cast("long")
    at = F.struct(number.cast("int").alias("shard"), (place - begin).cast("long").alias("slot"))
    out = placed.select("item", at.alias("at")).select("item.row.*", "at.*")
    out.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path).select(*names, "shard", "slot")


def _numbered(rows: DataFrame, n_buckets: int, seed: int, bucket_bytes: int) -> DataFrame:
    """(code, copy, row, bucket): rows equal in every column that would fill a good part of a bucket are numbered, and
    their numbers scatter them like other rows. Fewer copies share a bucket.

    Which of them has which number does not matter, so they are counted, with partial counts before the shuffle, and
    written out again COPIES at a time; a row that repeats for a third of the table passes no task as a whole.
    """
    together = rows.groupBy("code").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    often = materialise(together.filter((F.col("n") > 1) & (F.col("bytes") > bucket_bytes / CROWDED)).select("code"), "repeated-codes")
    known = look_up(rows, often.withColumn("again", F.lit(True)), ["code"])
    once = known.filter("again is null").select("code", F.lit(0).cast("long").alias("copy"), "row")
    # Different rows can have one code; the rows themselves are compared here.
    counted = known.filter("again").groupBy("code", "row").agg(F.count("*").alias("n"))
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))))
    least, most = F.col("part") * COPIES, F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1
    copies = parts.repartition("code", "part").select("code", F.explode(F.sequence(least, most)).alias("copy"), "row")
    bucket = F.pmod(F.when(F.col("copy") == 0, F.col("code")).otherwise(F.xxhash64(F.lit(seed), "code", "copy")), F.lit(n_buckets))
    return once.unionByName(copies).withColumn("bucket", bucket.cast("int"))
