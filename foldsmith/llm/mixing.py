"""Mixing sources to target weights by nested hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldsmith.llm.quality import word_array
from foldsmith.scratch import materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
# 52 bits of a digest of key and text, then 8 bits that part equal rows; read 12 bits at a time.
HASH_BITS, LEVEL_BITS = 60, 12


def _hash(key: str, text: str) -> Column:
    name = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text).cast("string"), F.lit("")))
    digest = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(256))
    return F.shiftleft(digest, 8).bitwiseOR(salt)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from a stored (source, source_size); a row per source.

    Sources in order of code points, null last, get the weights in turn. They share ``share`` times all sizes;
    a target stops at ``cap`` times its source's size and the excess goes to the others by weight. Only the sums
    of a round reach the driver.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turns = F.array(*[F.lit(w) for w in weights])
    weighted = materialise(
        sizes.withColumn("weight", F.get(turns, F.pmod(place - 1, F.lit(len(weights))))), "source-weights"
    )
    budget = share * (weighted.agg(F.sum("source_size")).first()[0] or 0)
    limit = cap * F.col("source_size")
    left, free, capped = budget, None, 0
    while True:
        # A source is capped once its share of what is left would pass its limit.
        full = F.lit(False) if free is None else limit * free <= F.lit(left) * F.col("weight")
        row = weighted.agg(
            F.sum(F.when(full, 1).otherwise(0)).alias("n"),
            F.sum(F.when(full, limit).otherwise(0)).alias("taken"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("free"),
        ).first()
        n = row["n"] or 0
        if free is not None and n == capped:
            break
        capped, left, free = n, budget - (row["taken"] or 0), row["free"] or 0
    target = F.when(full, limit.cast("double")).otherwise(F.lit(float(left)) * F.col("weight") / F.lit(free or 1))
    return weighted.select("source", "source_size", target.alias("target"))


def _thresholds(slim: DataFrame, plans: DataFrame) -> DataFrame:
    """(source, threshold): rows below it sum to the source's ``need`` as nearly as whole rows can.

    Each level is a histogram of sizes by source and the next 12 hash bits, over the rows of the bucket that
    the budget's boundary fell into; it ends when such a bucket holds one row or no bits are left.
    """
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    state = plans.select("source", "need", F.lit(0).cast("long").alias("prefix"), F.lit(-1).cast("long").alias("rows"))
    done = None
    for bits in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        rest = HASH_BITS - bits
        inside = F.shiftright("d.hash", rest + LEVEL_BITS) == F.col("p.prefix")
        # One row per source: small unless there are very many sources, so it is counted.
        few = state.count() * 4 <= 1_000_000
        open_rows = slim.alias("d").join((F.broadcast(state) if few else state).alias("p"), same("d", "p") & inside)
        histogram = open_rows.groupBy("d.source", "p.need", F.shiftright("d.hash", rest).alias("bucket")).agg(
            F.sum("size").alias("size"), F.count("*").alias("rows")
        )
        through = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        first = Window.partitionBy("source").orderBy("bucket")
        crossed = histogram.withColumn("through", through).filter("through > need")
        crossed = crossed.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
        level = materialise(
            crossed.select("source", (F.col("need") - F.col("through") + F.col("size")).alias("need"), F.col("bucket").alias("prefix"), "rows", "size"),
            "boundary",
        )
        ended = F.lit(True) if rest == 0 else F.col("rows") == 1
        upper = F.when(2 * F.col("need") >= F.col("size"), F.col("prefix") + 1).otherwise(F.col("prefix"))
        here = level.filter(ended).select("source", F.shiftleft(upper, rest).alias("threshold"))
        done = here if done is None else done.union(here)
        state = level.filter(~ended).drop("size")
        if rest == 0 or not state.limit(1).count():
            return materialise(done, "thresholds")


def plan_mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP,
) -> DataFrame:
    """One row per row of ``docs``: key, source, size (words), source_size, target, copies.

    ``copies`` (0 to ``cap``) is how often the mix takes the document: the whole passes that the source's target
    needs, and one more below the source's hash threshold. Thresholds grow with the budget, so a larger mix holds
    every smaller one. The hash depends on key and text alone; rows equal in both are parted by their place.

    A null source is a source of its own; null and empty texts have size 0; a source without words gets no copies.
    Other columns of ``docs`` are not read.
    """
    slim = materialise(
        docs.select(
            F.col(key).alias("key"),
            F.col(source).cast("string").alias("source"),
            F.size(word_array(F.coalesce(F.col(text).cast("string"), F.lit("")))).cast("long").alias("size"),
            _hash(key, text).alias("hash"),
        ),
        "sizes",
    )
    return _copies(slim, weights, share, cap).withColumnRenamed("key", key).withColumnRenamed("source", source)


def _copies(slim: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    sizes = materialise(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plans = targets(sizes, weights, share, cap).withColumn("whole", whole)
    plans = materialise(plans.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "plans")
    limits = _thresholds(slim, plans)
    a, b = plans.alias("a"), limits.alias("b")
    full = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.*", F.coalesce("threshold", F.lit(0)).alias("threshold"))
    full = materialise(full, "mix").withColumnRenamed("source", "_source")
    few = full.count() * len(full.columns) <= 1_000_000
    out = slim.join(F.broadcast(full) if few else full, F.col("source").eqNullSafe(F.col("_source")))
    copies = F.least(F.lit(cap), F.col("whole") + (F.col("hash") < F.col("threshold")).cast("int")).cast("long")
    return out.select(
        *[c for c in slim.columns if c != "hash"], "source_size", "target", copies.alias("copies")
    )


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP,
) -> DataFrame:
    """The mixed documents, in the columns of ``docs``: each as many times as ``plan_mix`` takes it."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).cast("string").alias("source"))
    size = F.size(word_array(F.coalesce(F.col(f"row.{text}").cast("string"), F.lit("")))).cast("long")
    rows = rows.select("row", "source", size.alias("size"), _hash(f"row.{key}", f"row.{text}").alias("hash"))
    slim = materialise(rows, "mix-rows")
    taken = _copies(slim, weights, share, cap)
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return taken.select("row", copies).select("row.*")
