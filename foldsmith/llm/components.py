"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsmith.scratch import attach, materialise


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the least of u and its neighbours. A hot u is salted or broadcast by ``attach``."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return attach(edges, materialise(least, "least"), ["u"], salt_on=["v"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return materialise(out.filter("u <> v").distinct(), "large-star")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _with_least(down)
    out = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        starred.select("u", F.col("m").alias("v"))
    )
    return materialise(out.filter("u <> v").distinct(), "small-star")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v), the component being its least node.

    Rounds grow with the logarithm of the longest path; every round is a stored table, so a lost executor
    repeats one round at most. Null ends and loops are ignored; an empty table gives an empty table.
    """
    now = materialise(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    mark = _mark(now)
    while True:
        now = _small_star(_large_star(now))
        new = _mark(now)
        if new == mark:
            break
        mark = new
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(roots)
