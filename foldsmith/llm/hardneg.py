"""Hard negatives: rows of another label whose inner product with an anchor lies in a window below a positive's."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsmith.llm import gnat
from foldsmith.llm.gnat import SAMPLE_ROWS, Tree, plant
from foldsmith.llm.vectors import lists, matrix, usable, width
from foldsmith.scratch import materialise, short_lived

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
# A negative's score lies between these hundredths of the positive's.
LOWEST, HIGHEST = 50, 95
ANCHOR_ROWS = 256
# Inner products up to this size are exact in doubles, a hundredfold of them too.
EXACT = float(1 << 46)
VISIT = "anchor long, slot int, id long, score long"


def _integers(vector: Column) -> Column:
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * SCALE).cast("double"))


def _sample(rows: DataFrame, d: int) -> np.ndarray:
    """SAMPLE_ROWS rows at most, by a hash of the id."""
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vector").toArrow()
    return matrix(picked.column("vector").combine_chunks(), d)


def _filed(rows: DataFrame, tree: Tree, d: int) -> DataFrame:
    """Stored rows with their leaf, and a number by which a large leaf is cut into parts."""

    def file(batches):
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index("vector")), d)
            names = ["id", "label"]
            rest = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*rest, lists(x), pa.array(tree.leaf_of(x))], names=[*names, "vector", "leaf"])

    return materialise(rows.mapInArrow(file, "id long, label long, vector array<double>, leaf int"), "leaves")


def _measure(filed: DataFrame, tree: Tree, d: int) -> None:
    """Fill in the ranges over all rows; the driver gets one row per pair of siblings."""

    def ranges(batches):
        low = [np.full((len(n.points),) * 2, np.inf) for n in tree.nodes]
        high = [np.full((len(n.points),) * 2, -np.inf) for n in tree.nodes]
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index("vector")), d)
            for at, _, apart, nearest in tree.walk(tree.lift(x)):
                for j in np.unique(nearest):
                    of = apart[nearest == j]
                    low[at][:, j] = np.minimum(low[at][:, j], of.min(axis=0))
                    high[at][:, j] = np.maximum(high[at][:, j], of.max(axis=0))
        for at, (a, b) in enumerate(zip(low, high)):
            i, j = np.nonzero(np.isfinite(a))
            if len(i):
                yield pa.RecordBatch.from_pydict(
                    {"node": np.full(len(i), at, dtype="int32"), "i": i.astype("int32"), "j": j.astype("int32"), "low": a[i, j], "high": b[i, j]}
                )

    per_task = filed.select("vector").mapInArrow(ranges, "node int, i int, j int, low double, high double")
    for node in tree.nodes:
        node.low = np.full((len(node.points),) * 2, np.inf)
        node.high = np.full((len(node.points),) * 2, -np.inf)
    for r in per_task.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        tree.nodes[r["node"]].low[r["i"], r["j"]] = r["low"]
        tree.nodes[r["node"]].high[r["i"], r["j"]] = r["high"]


def _parts(filed: DataFrame, tree: Tree) -> tuple[DataFrame, np.ndarray]:
    """Rows with ``part``, and the first part of every leaf: a leaf of any size is cut by a hash into even parts."""
    sizes = {r["leaf"]: r["n"] for r in filed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one per leaf
    most = gnat.leaf_rows(sum(sizes.values()))
    pieces = np.array([math.ceil(sizes.get(i, 0) / most) for i in range(tree.leaves)])
    first = np.concatenate([[0], np.cumsum(pieces)]).astype(int)
    table = filed.sparkSession.createDataFrame(
        [(i, int(first[i]), int(pieces[i])) for i in range(tree.leaves) if pieces[i]], "leaf int, first int, pieces int"
    )
    placed = filed.join(F.broadcast(table), "leaf")
    part = F.col("first") + F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    return materialise(placed.select(part.alias("part"), "id", "label", "vector"), "parts"), first


def _route(asked: DataFrame, tree: Tree, first: np.ndarray, d: int) -> DataFrame:
    """One row per anchor and part that may hold what it asks for.

    ``asked`` has id, label, vector and the windows as arrays ``low`` and ``high`` of scores; null means no bound.
    """
    per_leaf = [np.arange(first[i], first[i + 1], dtype=np.int32) for i in range(len(first) - 1)]

    def route(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ANCHOR_ROWS):
                part = batch.slice(at, ANCHOR_ROWS)
                q = matrix(part.column(part.schema.get_field_index("vector")), d)
                around = (q * q).sum(axis=1) + tree.longest
                # The annulus of a window of scores; that of an anchor spans all its windows.
                low, high = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("low", "high"))
                least = np.array([min(-np.inf if v is None else v for v in x) for x in low])
                most = np.array([max(np.inf if v is None else v for v in x) for x in high])
                far = np.sqrt(np.maximum(0.0, around - 2 * np.maximum(least, -around)))
                near = np.sqrt(np.maximum(0.0, around - 2 * np.minimum(most, around)))
                alive = tree.reachable(q, near, far)
                rows, leaves = np.nonzero(alive)
                to = [per_leaf[x] for x in leaves]
                take = np.repeat(rows, [len(t) for t in to])
                if len(take):
                    out = part.take(pa.array(take))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to)), *out.columns], names=["part", *out.schema.names])

    kinds = "part int, id long, label long, vector array<double>, low array<long>, high array<long>, bar array<long>"
    return asked.select("id", "label", "vector", "low", "high", "bar").mapInArrow(route, kinds)


def _best(scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest fitting scores of each row, ties by smaller id; columns are in id order."""
    masked = np.where(fits, scores, -np.inf)
    if masked.shape[1] > k:
        bar = -np.partition(-masked, k - 1, axis=1)[:, k - 1]
        fits = fits & (masked >= bar[:, None])
    row, col = np.nonzero(fits)
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    return row[place < k], col[place < k]


def _visit(parts: DataFrame, routed: DataFrame, same: bool, k: int, d: int) -> DataFrame:
    """Stored (anchor, slot, id, score): in every part an anchor is sent to, its ``k`` best rows of each window.

    A part's rows come first and are held, ``gnat.leaf_rows`` or so; the anchors sent there pass by in batches.
    """
    none = F.lit(None).cast("array<long>")
    held = parts.select("part", F.lit(0).alias("tag"), "id", "label", "vector", none.alias("low"), none.alias("high"), none.alias("bar"))
    sent = routed.select("part", F.lit(1).alias("tag"), "id", "label", "vector", "low", "high", "bar")
    dealt = held.unionByName(sent).repartition("part").sortWithinPartitions("part", "tag", "id")

    def visit(batches):
        here, rows = -1, []
        block = None
        for batch in batches:
            part = batch.column(0).to_numpy()
            tag = batch.column(1).to_numpy()
            mark = part.astype(np.int64) * 2 + tag
            cuts = [0, *(np.flatnonzero(mark[1:] != mark[:-1]) + 1).tolist(), len(mark)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                run = batch.slice(a, b - a)
                if part[a] != here:
                    here, rows, block = part[a], [], None
                if tag[a] == 0:
                    rows.append(run)
                    continue
                if not rows and block is None:
                    continue
                if block is None:
                    block = tuple(np.concatenate(x) for x in zip(*[(r.column(2).to_numpy(), r.column(3).to_numpy(), matrix(r.column(4), d)) for r in rows]))
                    rows = []
                for at in range(0, run.num_rows, ANCHOR_ROWS):
                    yield from _compare(run.slice(at, ANCHOR_ROWS), *block, same, k, d)

    return materialise(dealt.mapInArrow(visit, VISIT), "visits")


def _compare(
    anchors: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, same: bool, k: int, d: int
) -> Iterator[pa.RecordBatch]:
    own, label = anchors.column(2).to_numpy(), anchors.column(3).to_numpy()
    scores = matrix(anchors.column(4), d) @ vectors.T
    open_ = (label[:, None] == labels[None, :]) == same
    open_ &= own[:, None] != ids[None, :]
    low, high, bar = (anchors.column(i).to_pylist() for i in (5, 6, 7))
    for slot in range(max(len(x) for x in low)):
        def bound(of, missing):
            return np.array([missing if slot >= len(x) or x[slot] is None else x[slot] for x in of], dtype=float)[:, None]

        has = np.array([slot < len(x) for x in low])[:, None]
        fits = open_ & has & (scores >= bound(low, -np.inf)) & (scores >= bound(bar, -np.inf)) & (scores <= bound(high, np.inf))
        row, col = _best(scores, fits, ids, k)
        if len(row):
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[row]), pa.array(np.full(len(row), slot, dtype=np.int32)), pa.array(ids[col]), pa.array(scores[row, col].astype(np.int64))],
                names=["anchor", "slot", "id", "score"],
            )


def _first(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each anchor and slot with ``rank``; ranks are cut before the shuffle too."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(asked: DataFrame, parts: DataFrame, tree: Tree, first: np.ndarray, same: bool, k: int, d: int) -> DataFrame:
    """Stored best ``k`` rows (anchor, slot, id, score, rank) of every window.

    Each anchor looks into the part it stands in first; the k-th score found there is a bar that raises the low end
    of the window, so the second look goes only where something better may be.
    """
    home = parts.select("part", "id").join(asked, "id")
    kinds = ["part", "id", "label", "vector", "low", "high", "bar"]
    seen = _visit(parts, home.select(*kinds), same, k, d)
    bars = _first(seen, k).filter(F.col("rank") == k).groupBy("anchor")
    bars = bars.agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("bars"))
    known = asked.join(bars.select(F.col("anchor").alias("id"), "bars"), "id", "left")
    raised = F.transform(F.sequence(F.lit(0), F.size("low") - 1), lambda i: F.try_element_at(F.col("bars"), i))
    low = F.zip_with("low", raised, lambda a, b: F.greatest(a, b))
    asked = materialise(known.withColumn("bar", raised).withColumn("low", low).drop("bars"), "asked")
    found = _visit(parts, _route(asked, tree, first, d), same, k, d)
    return materialise(_first(found, k), "found")


def hard_negatives(
    table: DataFrame,
    anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ranks from 1.

    Components become integers floor(256 c); a score is the integer inner product with the anchor, higher first, ties
    by smaller key. For each anchor (rows of the table for which ``anchor`` holds) and each of its first ``positives``
    other rows of the same label, the first ``negatives`` rows of another label with
    50 positive_score <= 100 negative_score <= 95 positive_score are returned, all if fewer. The search is exact.

    Rows with a null key or label, a null vector or null or non-finite components take no part. Shorter vectors are
    filled with zeros. Rows that share a key count as one, that of the least label, then the least vector. Anchors
    without another row of their label, and empty tables, give no rows. Vectors of a squared length above 2 ** 46
    after scaling are an error, since their scores are not exact. Other columns are not read.
    """
    spark = table.sparkSession
    with short_lived(spark):
        of = F.col(label) if isinstance(label, str) else label
        rows = table.filter(usable(vector)).select(
            F.col(key).cast("long").alias("id"), of.cast("long").alias("label"), _integers(F.col(vector)).alias("vector"),
            F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
        )
        rows = rows.filter("id is not null and label is not null")
        rows = rows.groupBy("id").agg(F.min(F.struct("label", "vector", "is_anchor")).alias("r")).select("id", "r.*")
        rows = materialise(rows, "integers")
        return materialise(_mine(rows, positives, negatives), "hard-negatives", keep=True)


def _mine(rows: DataFrame, positives: int, negatives: int) -> DataFrame:
    spark = rows.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    d = width(rows, "vector")
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    n, longest = rows.agg(F.count("*"), F.max(squares)).first()
    if not n:
        return spark.createDataFrame([], out)
    if longest >= EXACT:
        raise ValueError(f"a vector's squared length is {longest:.3g} after scaling; scores are exact up to {EXACT:.3g}")
    tree = plant(_sample(rows, d), n, float(longest))
    filed = _filed(rows, tree, d)
    _measure(filed, tree, d)
    parts, first = _parts(filed, tree)

    none = F.array(F.lit(None).cast("long"))
    anchors = rows.filter("is_anchor").select("id", "label", "vector")
    asked = materialise(anchors.withColumns({"low": none, "high": none, "bar": none}), "anchors")
    near = _search(asked, parts, tree, first, True, positives, d)

    # A window per positive, in the order of their ranks; a negative score has none.
    ahead = near.filter("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    ahead = materialise(ahead.withColumnRenamed("anchor", "id"), "windows")
    low = F.transform("p", lambda p: F.ceil(p["score"] * LOWEST / 100).cast("long"))
    high = F.transform("p", lambda p: F.floor(p["score"] * HIGHEST / 100).cast("long"))
    windows = anchors.join(ahead, "id").select("id", "label", "vector", low.alias("low"), high.alias("high"))
    windows = windows.withColumn("bar", F.transform("low", lambda _: F.lit(None).cast("long")))
    far = _search(materialise(windows, "negative-windows"), parts, tree, first, False, negatives, d)

    slots = ahead.select(F.col("id").alias("anchor"), F.posexplode("p").alias("slot", "p"))
    both = far.withColumnRenamed("id", "negative_id").join(slots, ["anchor", "slot"])
    return both.select(
        F.col("anchor").alias("anchor_id"),
        F.col("p.id").alias("positive_id"),
        "rank",
        "negative_id",
        F.col("p.score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
