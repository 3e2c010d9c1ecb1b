"""Near-duplicate groups of embeddings: E8 lattice cells, balls of certain duplicates, exact cosines.

A ball is a centre with rows at half the limit's angle or nearer: by the triangle inequality of angles all its
members are duplicates of each other, so a group of copies of any size is one ball and its pairs are never formed.
Two balls are decided by the angle of their centres and their radii where that is enough; only what stays open is
compared member by member, in blocks, and counted in the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsmith.llm.components import connected_components
from foldsmith.llm.lattice import LatticeHash, meeting_chance
from foldsmith.llm.vectors import lists, matrix, usable, width
from foldsmith.scratch import attach, materialise, short_lived

COSINE = 0.9
CELL, PROBES = 2.0, 8
# A pair just at the limit is missed with this probability at most; nearer pairs far less often.
MISS = 0.005
# One lattice point more per key for each factor 2 ** 9 of rows, so cells stay small.
BITS_PER_BLOCK = 9
SKETCH_BITS = 128
SIGMAS = 6.0
# Angles that differ by less are decided by the members' cosines.
SLACK = 1e-6
BLOCK_ROWS = 2048
HASH_ROWS = 512
SKETCH = ["k0", "k1"]


def plan(n: int, d: int, cosine: float = COSINE) -> LatticeHash:
    """Lattice points per key by the number of rows, tables by the chance that a pair at the limit meets in one."""
    blocks = max(2, math.ceil(math.log2(max(2, n)) / BITS_PER_BLOCK))
    chance = min(max(meeting_chance(d, blocks, CELL, PROBES, cosine), 1e-3), 0.9)
    return LatticeHash(d, blocks, math.ceil(math.log(MISS) / math.log(1 - chance)), CELL, PROBES)


def _describe(batches: Iterator[pa.RecordBatch], hashing: LatticeHash) -> Iterator[pa.RecordBatch]:
    """Own and probed cells and a sketch of signs; every vector as a unit vector."""
    directions = hashing.projections()
    signs = np.random.default_rng(31).standard_normal((hashing.width, SKETCH_BITS))
    for batch in batches:
        for at in range(0, batch.num_rows, HASH_ROWS):
            part = batch.slice(at, HASH_ROWS)
            x = matrix(part.column(part.schema.get_field_index("vector")), hashing.width)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            home, probed = hashing.keys(unit, directions)
            bits = np.packbits(unit @ signs > 0, axis=1).reshape(len(unit), -1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(part.schema.get_field_index("row")),
                    lists(unit),
                    _longs(home),
                    _longs(probed.reshape(len(unit), -1)),
                    *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(SKETCH))],
                ],
                names=["row", "unit", "home", "probed", *SKETCH],
            )


def _longs(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def _apart(a: str, b: str) -> Column:
    """Sketch bits in which two rows differ."""
    first, second = (F.bit_count(F.col(f"{a}_{k}").bitwiseXOR(F.col(f"{b}_{k}"))) for k in SKETCH)
    return first + second


def _limit(angle: Column) -> Column:
    """Bits in which two rows at this angle differ at most, to SIGMAS standard deviations."""
    share = F.least(angle / math.pi, F.lit(1.0))
    return SKETCH_BITS * share + SIGMAS * F.sqrt(SKETCH_BITS * share * (1 - share)) + 1


def _cosines(pairs: DataFrame, units: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``cosine``; vectors are looked up for the rows that occur only, the hot ones salted."""
    out, names = pairs, list(pairs.columns)
    for side, name in ((a, "_ua"), (b, "_ub")):
        wanted = materialise(pairs.select(F.col(side).alias("row")).distinct(), "wanted")
        known = materialise(attach(units, wanted, ["row"], "left_semi"), "wanted-units")
        known = known.select(F.col("row").alias(side), F.col("unit").alias(name))
        out = attach(out, known, [side], "inner", [a, b])

    def multiply(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (batch.column(batch.schema.get_field_index(n)) for n in ("_ua", "_ub"))
            d = len(left[0])
            dot = np.einsum("ij,ij->i", matrix(left, d), matrix(right, d))
            rest = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.minimum(dot, 1.0))], names=[*names, "cosine"])

    kinds = ", ".join(f"{c} {t}" for c, t in pairs.dtypes)
    return materialise(out.mapInArrow(multiply, f"{kinds}, cosine double"), "cosines")


def _balls(index: DataFrame, homes: DataFrame, visits: DataFrame, cosine: float) -> DataFrame:
    """Stored (row, centre, cosine): every row in one ball, a row alone being its own centre.

    The first row of each cell leads it; a row goes to the first of the leaders it meets that is near enough and
    not itself in another's ball.
    """
    half = math.acos(cosine) / 2
    first = homes.groupBy("key").agg(F.min("row").alias("leader"))
    sketched = index.select(F.col("row").alias("leader"), *[F.col(k).alias(f"l_{k}") for k in SKETCH])
    # A leader leads as many cells as there are tables at most, and a cell has one leader.
    leaders = materialise(first.join(sketched, "leader"), "leaders")
    met = visits.join(leaders, "key").filter((F.col("leader") < F.col("row")) & (_apart("v", "l") <= _limit(F.lit(half))))
    met = materialise(met.select("row", "leader").distinct(), "met-leaders")
    near = _cosines(met, index.select("row", "unit"), "row", "leader").filter(F.col("cosine") >= math.cos(half) + 1e-12)
    led = materialise(near.select("row").distinct(), "led")
    taken = attach(near, led.select(F.col("row").alias("leader")), ["leader"], "left_anti", ["row"])
    own = taken.groupBy("row").agg(F.min(F.struct(F.col("leader"), "cosine")).alias("own"))
    own = materialise(own.select("row", "own.leader", "own.cosine"), "members")
    out = attach(index.select("row"), own, ["row"])
    return materialise(
        out.select("row", F.coalesce("leader", "row").alias("centre"), F.coalesce("cosine", F.lit(1.0)).alias("cosine")), "balls"
    )


def _count_open(pairs: DataFrame, balls: DataFrame, sizes: DataFrame, units: DataFrame, cosine: float) -> DataFrame:
    """Stored (row, n, u, v): links of each member of an open pair (u, v) of balls to the members of the other one.

    Blocks of BLOCK_ROWS members of the one are compared with blocks of the other, each pair of blocks in one go.
    """
    for side in ("u", "v"):
        named = sizes.select(F.col("centre").alias(side), F.ceil(F.col("size") / BLOCK_ROWS).cast("int").alias(f"n{side}"))
        pairs = attach(pairs, named, [side], "inner", ["u", "v"])
    pairs = materialise(pairs.select("u", "v", "nu", "nv"), "open-pairs")
    ends = [pairs.withColumn("centre", F.col(side)).withColumn("side", F.lit(at)) for at, side in enumerate(("u", "v"))]
    partners = ends[0].unionByName(ends[1]).groupBy("centre")
    partners = materialise(partners.agg(F.collect_list(F.struct("u", "v", "nu", "nv", "side")).alias("pair")), "partners")
    members = attach(balls.select("row", "centre"), partners, ["centre"], "inner", ["row"])
    members = members.select("row", F.explode("pair").alias("p")).select("row", "p.*")
    own = F.pmod(F.xxhash64("row"), F.when(F.col("side") == 0, F.col("nu")).otherwise(F.col("nv"))).cast("int")
    across = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("nv")).otherwise(F.col("nu")) - 1))
    placed = members.withColumn("own", own).withColumn("other", across)
    left = F.col("side") == 0
    placed = placed.select(
        "row", "u", "v", "side",
        F.when(left, F.col("own")).otherwise(F.col("other")).alias("i"),
        F.when(left, F.col("other")).otherwise(F.col("own")).alias("j"),
    )
    wanted = materialise(placed.select("row").distinct(), "open-rows")
    known = materialise(attach(units, wanted, ["row"], "left_semi"), "open-units")
    full = attach(placed, known, ["row"], "inner", ["u", "v", "i", "j"])
    group = ["u", "v", "i", "j"]

    def count(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            marks = np.stack([table.column(c).to_numpy() for c in group], axis=1)
            last = int(np.flatnonzero((marks != marks[-1]).any(axis=1)).max(initial=-1)) + 1
            if last:
                yield from _links(table.slice(0, last), marks[:last], cosine)
            held = table.slice(last).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from _links(table, np.stack([table.column(c).to_numpy() for c in group], axis=1), cosine)

    dealt = full.repartition(*group).sortWithinPartitions(*group, "side")
    return materialise(dealt.mapInArrow(count, "row long, n long, u long, v long"), "open-links")


def _links(table: pa.Table, marks: np.ndarray, cosine: float) -> Iterator[pa.RecordBatch]:
    cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
    rows, side = table.column("row").to_numpy(), table.column("side").to_numpy()
    units = table.column("unit").combine_chunks()
    for a, b in zip(cuts, cuts[1:]):
        middle = a + int((side[a:b] == 0).sum())
        if not a < middle < b:
            continue
        x, y = (matrix(units.slice(s, e - s), len(units[a])) for s, e in ((a, middle), (middle, b)))
        near = x @ y.T >= cosine
        n = np.concatenate([near.sum(axis=1), near.sum(axis=0)])
        hit = np.flatnonzero(n)
        if len(hit):
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[a:b][hit]), pa.array(n[hit].astype(np.int64)), *[pa.array(np.repeat(marks[a, c], len(hit))) for c in (0, 1)]],
                names=["row", "n", "u", "v"],
            )


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per row of ``table``: key, n_links, component_id, kept.

    Rows whose vectors have a cosine of ``cosine`` (above 0) or more, in double precision, are linked: ``n_links``
    counts the other rows linked with one, ``component_id`` is the least key reachable over links, ``kept`` marks the
    row that has it. Pairs below the limit are never linked; a pair just at it is missed with a probability of at
    most 0.005 (by simulation for the dimension at hand), nearer ones far less.

    Null vectors, zero vectors and vectors with null or non-finite components link with nothing and stay, with their
    own key as component. Shorter vectors are filled with zeros. Repeated rows and rows that share a key count as
    rows of their own; all that have the least key are kept. A row with a null key links like any other; its
    component is the least key among its links, null if there is none, and it is kept if it links with nothing.
    Very long vectors cost time in proportion. An empty table gives no rows. Other columns are not read.
    """
    spark = table.sparkSession
    with short_lived(spark):
        slim = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
        every = materialise(slim.withColumn("row", F.monotonically_increasing_id()), "vectors")
        live = every.filter(usable("vector") & F.exists("vector", lambda x: x != 0))
        links = _grouped(live, every, cosine)
        out = attach(every.select("row", "id"), links, ["row"])
        lone = F.col("n_links").isNull()
        out = out.select(
            F.col("id").alias(key),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(lone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
            F.when(lone, F.lit(True)).otherwise(F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))).alias("kept"),
        )
        return materialise(out, "vector-groups", keep=True)


def _grouped(live: DataFrame, every: DataFrame, cosine: float) -> DataFrame:
    """Stored (row, n_links, component_id) of the rows that link with something."""
    hashing = plan(live.count(), max(1, width(live, "vector")), cosine)
    kinds = "row long, unit array<double>, home array<long>, probed array<long>, k0 long, k1 long"
    index = materialise(live.select("row", "vector").mapInArrow(lambda it: _describe(it, hashing), kinds), "lattice")
    units = index.select("row", "unit")
    homes = index.select("row", F.explode("home").alias("key"))
    visits = index.select("row", *[F.col(k).alias(f"v_{k}") for k in SKETCH], F.explode(F.concat("home", "probed")).alias("key"))
    balls = _balls(index, homes, visits, cosine)

    sizes = balls.groupBy("centre").agg(F.count("*").alias("size"), F.min("cosine").alias("least"))
    radius = F.when(F.col("size") > 1, F.acos(F.least("least", F.lit(1.0)))).otherwise(0.0)
    sizes = materialise(sizes.select("centre", "size", radius.alias("r")), "ball-sizes")
    described = sizes.join(index.select(F.col("row").alias("centre"), *SKETCH), "centre")
    described = materialise(described, "centres")

    # Cells by centre: however many members of a ball stand in a cell, it is there once.
    place = balls.select("row", "centre")
    side = lambda cells, p: (
        attach(cells.select("row", "key"), place, ["row"], "inner", ["key"]).select("key", "centre").distinct()
        .join(described.select("centre", F.col("r").alias(f"{p}_r"), *[F.col(k).alias(f"{p}_{k}") for k in SKETCH]), "centre")
        .withColumnRenamed("centre", p)
    )
    at_home, visiting = materialise(side(homes, "a"), "home-centres"), materialise(side(visits, "b"), "visiting-centres")
    angle = F.lit(math.acos(cosine)) + F.col("a_r") + F.col("b_r")
    met = at_home.join(visiting, "key").filter((F.col("a") != F.col("b")) & (_apart("a", "b") <= _limit(angle)))
    met = materialise(met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "met-centres")

    judged = _cosines(met, units, "u", "v")
    for p in ("u", "v"):
        named = sizes.select(F.col("centre").alias(p), F.col("size").alias(f"{p}_size"), F.col("r").alias(f"{p}_r"))
        judged = attach(judged, named, [p], "inner", ["u", "v"])
    single = (F.col("u_size") == 1) & (F.col("v_size") == 1)
    between, reach, limit = F.acos("cosine"), F.col("u_r") + F.col("v_r"), math.acos(cosine)
    sure = F.when(single, F.col("cosine") >= cosine).otherwise(between + reach <= limit - SLACK)
    none = F.when(single, F.col("cosine") < cosine).otherwise(between - reach > limit + SLACK)
    judged = materialise(judged.withColumns({"sure": sure, "open": ~sure & ~none}).filter("sure or open"), "judged-centres")
    counted = _count_open(judged.filter("open").select("u", "v"), balls, sizes, units, cosine)

    certain = judged.filter("sure")
    more = certain.select(F.col("u").alias("centre"), F.col("v_size").alias("n"))
    more = more.union(certain.select(F.col("v").alias("centre"), F.col("u_size").alias("n")))
    more = more.groupBy("centre").agg(F.sum("n").alias("sure_links"))
    edges = certain.select("u", "v").union(counted.select("u", "v").distinct())
    groups = connected_components(edges).select(F.col("node").alias("centre"), "component")
    facts = sizes.filter("size > 1").select("centre", "size").join(materialise(more, "sure-links"), "centre", "full")
    facts = materialise(facts.join(materialise(groups, "groups"), "centre", "full"), "centre-facts")
    found = counted.groupBy("row").agg(F.sum("n").alias("open_links"))

    out = attach(balls.select("row", "centre"), facts, ["centre"], "left", ["row"])
    out = attach(out, materialise(found, "open-counts"), ["row"])
    n = sum((F.coalesce(c, F.lit(0)) for c in ("sure_links", "open_links")), F.coalesce("size", F.lit(1)) - 1)
    out = out.select("row", n.alias("n_links"), F.coalesce("component", "centre").alias("component")).filter("n_links > 0")
    out = materialise(attach(out, every.select("row", "id"), ["row"], "inner"), "linked-rows")
    least = materialise(out.groupBy("component").agg(F.min("id").alias("component_id")), "least-keys")
    out = attach(out, least, ["component"], "left", ["row"])
    return materialise(out.select("row", "n_links", "component_id"), "linked")
