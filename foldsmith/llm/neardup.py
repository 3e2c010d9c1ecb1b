"""Near-duplicate groups of documents: circulant MinHash, banding, exact Jaccard, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsmith.llm.circulant import band_keys, signature
from foldsmith.llm.components import connected_components
from foldsmith.llm.tables import deal_join, look_up, spread_join
from foldsmith.llm.words import Words, long_lists, mix, shingle_sets, text_blocks
from foldsmith.scratch import attach, materialise, short_lived

SHINGLE_WORDS = 5
SIMILARITY = 75
# 1 - (1 - 0.75 ** 4) ** 32 = 0.999995 of the pairs just at the limit share a band, nearer ones more.
BANDS, BAND_ROWS = 32, 4
COORDINATES = 256
# Pairs at the limit differ in 32 of 256 sketch bits, with a deviation of 5.3; six deviations are allowed.
SKETCH_LIMIT = 64
SEED = 1729
SKETCH = [f"k{i}" for i in range(COORDINATES // 64)]


def _sketch_bits(signatures: np.ndarray) -> np.ndarray:
    """The lowest bit of every coordinate, 64 to a word."""
    bits = (signatures & 1).astype(np.uint8)
    return np.packbits(bits, axis=1).reshape(len(bits), -1).view(np.uint64)


def _describe(batches: Iterator[pa.RecordBatch], key: str, text: str) -> Iterator[pa.RecordBatch]:
    for part, column in text_blocks(batches, text):
        sets = list(shingle_sets(Words(column, fold_case=True), SHINGLE_WORDS))
        full = [i for i, s in enumerate(sets) if len(s)]
        sums = np.zeros((len(sets), 2), dtype=np.uint64)
        bands: list = [None] * len(sets)
        sketch = np.zeros((len(sets), len(SKETCH)), dtype=np.uint64)
        if full:
            signatures = np.stack([signature(sets[i], COORDINATES, SEED) for i in full])
            keys = band_keys(signatures[:, : BANDS * BAND_ROWS], BANDS, BAND_ROWS).view(np.int64)
            sketch[full] = _sketch_bits(signatures)
            for row, i in enumerate(full):
                sums[i] = sets[i].sum(dtype=np.uint64), mix(sets[i]).sum(dtype=np.uint64)
                bands[i] = keys[row]
        columns = [
            part.column(part.schema.get_field_index(key)),
            pa.array(np.array([len(s) for s in sets], dtype=np.int64)),
            pa.array(sums[:, 0].view(np.int64)),
            pa.array(sums[:, 1].view(np.int64)),
            pa.array(bands, type=pa.list_(pa.int64())),
            *[pa.array(np.ascontiguousarray(sketch[:, i]).view(np.int64)) for i in range(len(SKETCH))],
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "s1", "s2", "bands", *SKETCH])


def _sets(batches: Iterator[pa.RecordBatch], key: str, text: str) -> Iterator[pa.RecordBatch]:
    for part, column in text_blocks(batches, text):
        sets = list(shingle_sets(Words(column, fold_case=True), SHINGLE_WORDS))
        yield pa.RecordBatch.from_arrays(
            [part.column(part.schema.get_field_index(key)), long_lists(sets)], names=["node", "shingles"]
        )


def _near(a: str, b: str) -> Column:
    """Sizes and sketches allow the two sides to reach the limit; decides without their texts."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = reduce(
        lambda x, y: x + y, (F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))) for k in SKETCH)
    )
    return (100 * F.least(n, m) >= SIMILARITY * F.greatest(n, m)) & (apart <= SKETCH_LIMIT)


def _sets_of(docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """Stored (node, shingles) of the given nodes."""
    wanted = attach(docs, materialise(nodes.distinct(), "nodes"), [key], how="left_semi")
    sets = wanted.distinct().mapInArrow(lambda it: _sets(it, key, text), "node long, shingles array<long>")
    return materialise(sets, "sets")


def _verified(pairs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (u, v) whose full shingle sets reach the limit."""
    pairs = materialise(pairs.filter("u <> v").distinct(), "pairs")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node")))
    sets = _sets_of(docs, nodes, key, text)
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    # A leader or a document may stand in very many pairs; those are dealt over tasks.
    both = deal_join(deal_join(pairs, right, ["v"], ["u"]).select("u", "v", "sv"), left, ["u"], ["v"])
    common = F.size(F.array_intersect("su", "sv"))
    enough = 100 * common >= SIMILARITY * (F.size("su") + F.size("sv") - common)
    return materialise(both.filter(enough).select("u", "v").distinct(), "links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept.

    Documents are linked if their sets of five-word shingles have a Jaccard similarity of 0.75 or more;
    ``component_id`` is the least key reachable over links and ``kept`` marks the row that has it.

    Equal sets form one class, whatever their number, and only classes go on. In every band bucket each
    class is compared with the least one. Classes of a bucket that are still in different components after
    that are compared with each other where they share a rare shingle, as all pairs at the limit do; the
    largest component is only one of the sides. Sizes and a 256-bit sketch rule pairs out in the join, full
    sets confirm the others.

    Null and empty texts have no shingles and link with nothing. Repeated rows come back as often as given.
    Rows that share a key count as one linked document. A row with a null key cannot be named: it has a null
    component and stays. Other columns of ``docs`` are not read.
    """
    slim = docs.select(F.col(key).cast("long").alias("node"), F.col(text).cast("string").alias("text"))
    kinds = ", ".join(f"{c} long" for c in SKETCH)
    meta = materialise(
        slim.mapInArrow(
            lambda it: _describe(it, "node", "text"),
            f"node long, n long, s1 long, s2 long, bands array<long>, {kinds}",
        ),
        "signatures",
    )
    named = meta.filter("n > 0 and node is not null")
    classes = named.groupBy("s1", "s2", "n").agg(F.min("node").alias("class"), F.count("*").alias("rows"))
    classes = materialise(classes.filter("rows > 1").drop("rows"), "classes")
    members = attach(meta.select("node", "n", "s1", "s2"), classes, ["s1", "s2", "n"], salt_on=["node"])
    first = attach(named, classes, ["s1", "s2", "n"], salt_on=["node"])
    first = first.filter("class is null or class = node").drop("class")

    banded = first.select("node", "n", *SKETCH, F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n"))
    shared = materialise(shared.filter("least < most").drop("most"), "shared-bands")
    buckets = materialise(spread_join(banded, shared, ["band"], ["node"], "inner"), "buckets")

    leaders = buckets.filter("node = least").distinct().select("band", F.struct("node", "n", *SKETCH).alias("a"))
    members_of = buckets.select("band", "node", F.struct("node", "n", *SKETCH).alias("b"))
    star = deal_join(members_of, leaders, ["band"], ["node"]).filter((F.col("a.node") < F.col("b.node")) & _near("a", "b"))
    links = _verified(star.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")), slim, "node", "text")
    groups = materialise(connected_components(links), "groups")

    rest = _open_buckets(buckets, groups).select("node", "n", *SKETCH).distinct()
    rare = _rare_buckets(materialise(rest, "open-nodes"), slim, "node", "text")
    more = _verified(_open_pairs(_open_buckets(rare, groups)), slim, "node", "text")
    if more.limit(1).count():
        groups = materialise(connected_components(links.union(more)), "groups")

    out = members.select(F.col("node").alias("doc"), "n", F.coalesce("class", "node").alias("node"))
    out = attach(out, groups, ["node"], salt_on=["doc"])
    component = F.when(F.col("doc").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc"))
    component = component.otherwise(F.coalesce("component", "node"))
    return out.select(
        F.col("doc").alias(key),
        F.col("n").alias("n_shingles"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"),
    )


def _open_buckets(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with ``component`` and the bucket's largest, ``top``."""
    placed = attach(buckets, groups, ["node"], salt_on=["band"])
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("band", "component").agg(F.count("*").alias("size"))
    # The larger size wins, then the larger component.
    most = sizes.groupBy("band").agg(F.max("size").alias("size"), F.count("*").alias("parts")).filter("parts > 1")
    largest = sizes.join(most, ["band", "size"]).groupBy("band").agg(F.max("component").alias("top"))
    return placed.join(materialise(largest, "largest"), "band").distinct()


def _rare_buckets(nodes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Buckets of the nodes that share one of their rarest shingles.

    Two sets of similarity 0.75 overlap so much that, in any common order, they share a member among the first
    n - ceil(0.75 n) + 1 of each. With the rarest first, what very many documents share brings none together.
    """
    sets = _sets_of(docs, nodes.select("node"), key, text)
    listed = materialise(sets.select("node", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("band")), "listed")
    common = listed.groupBy("band").agg(F.count("*").alias("df"), F.count("*").alias("n")).filter("df > 1")
    counted = spread_join(listed, materialise(common, "shingle-counts"), ["band"], ["node"])
    ordered = counted.groupBy("node", "n").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "band"))).alias("order")
    )
    n = F.size("order")
    first = F.slice("order", F.lit(1), n - F.ceil(n * F.lit(SIMILARITY) / 100).cast("int") + 1)
    placed = F.transform(first, lambda x, i: F.struct(x["df"].alias("df"), x["band"].alias("band"), i.cast("long").alias("pos")))
    rare = ordered.select("node", "n", F.explode(F.filter(placed, lambda x: x["df"] > 1)).alias("x"))
    rare = rare.select("node", "n", "x.band", "x.pos")
    return materialise(rare.join(nodes, ["node", "n"]), "rare-shingles")


def _open_pairs(placed: DataFrame) -> DataFrame:
    """Pairs of a rare-shingle bucket in different components; one side is outside the bucket's largest one."""
    placed = materialise(placed, "open-buckets")
    # Sizes within the limit fall into the same or neighbouring classes of a factor 4/3.
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / SIMILARITY)) + 1e-9).cast("int")
    small = placed.filter("component <> top").withColumn("step", F.explode(F.array(step - 1, step, step + 1)))
    large = placed.withColumn("step", step)
    a, b = small.alias("a"), large.alias("b")
    # What can be common from the first shared shingle on must reach the overlap that the limit asks for.
    left = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    on = (
        (F.col("a.band") == F.col("b.band"))
        & (F.col("a.step") == F.col("b.step"))
        & (F.col("a.component") != F.col("b.component"))
        & ((F.col("b.component") == F.col("b.top")) | (F.col("a.node") < F.col("b.node")))
        & ((100 + SIMILARITY) * left >= SIMILARITY * (F.col("a.n") + F.col("b.n")))
        & _near("a", "b")
    )
    return a.join(b, on).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the least key.

    Rows with a null key, and rows without words, stay. Of rows that repeat a key one stays, that of the least text.
    """
    with short_lived(docs.sparkSession):
        found = near_duplicates(docs, key, text).withColumnRenamed(key, "key")
        named = found.filter("key is not null and n_shingles > 0").groupBy("key")
        marks = named.agg(F.min("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1")
        marks = marks.select("key", F.when(F.col("kept"), 2).otherwise(1).alias("mark"))
        marks = materialise(marks, "near-duplicate-marks", keep=True)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    worded = F.col("key").isNotNull() & F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    marked = look_up(rows, marks, ["key"]).withColumn("mark", F.when(worded, F.col("mark")))
    out = marked.filter("mark is null").select("row")
    if marks.filter("mark = 2").limit(1).count():
        repeated = marked.filter("mark = 2").groupBy("key").agg(F.min_by("row", "text").alias("row"))
        out = out.union(repeated.select("row"))
    return out.select("row.*")
