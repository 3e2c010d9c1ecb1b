"""Operators on embeddings against brute force: awkward rows, ties, copies, groups around the limits, empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foldsmith.llm import contour, gnat, hardneg, lattice, vecdedup, whitening

SF = "/root/testdata/sf0.1"
QUERIES = entry.queries()
SCHEMA = "vec_id long, embedding array<double>, label int, row long, id long, unit int, centre string, part int, n long, vector string"
EXTRA = (7, 8, 9, "c", 1, 2, "v")


def unit(rng, n, d):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tilted(rng, v, cosine):
    w = rng.normal(size=len(v))
    w -= (w @ v) * v
    return cosine * v + math.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def awkward(d=16):
    """Groups of copies, tight and loose groups, a chain, scaled copies, unusable rows, repeated rows and keys."""
    rng = np.random.default_rng(4)
    base = unit(rng, 60, d)
    vectors = list(base)
    vectors += [base[0]] * 5 + [base[1] * s for s in (0.01, 3.0, 250.0)]
    vectors += [tilted(rng, base[2], c) for c in rng.uniform(0.86, 0.999, 60)]
    chain = [base[3]]
    for _ in range(8):
        chain.append(tilted(rng, chain[-1], 0.93))
    vectors += chain[1:]
    rows = [(i, [float(x) for x in v], int(i % 4)) for i, v in enumerate(vectors)]
    bad = [None, [0.0] * d, [], [float("nan")] * d, [1.0, None] * (d // 2), [float("inf")] + [0.5] * (d - 1)]
    rows += [(1000 + i, v, 1) for i, v in enumerate(bad)]
    rows += [(2000, [1.0, 2.0], 2), (2001, [1.0, 2.0] + [0.0] * (d - 2), None), (None, rows[0][1], 1), (None, None, None)]
    rows += [rows[0], rows[0], rows[70], (5, rows[6][1], 3)]
    return [(*r, *EXTRA) for r in rows]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


def is_usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def padded(vectors, d=16):
    return np.array([list(v) + [0.0] * (d - len(v)) for v in vectors]).reshape(-1, d)


def grouped(rows, cosine=0.9):
    """(key, links, component, kept) of every row."""
    live = [i for i, r in enumerate(rows) if is_usable(r[1]) and any(r[1])]
    u = padded([rows[i][1] for i in live])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    group = list(range(len(live)))
    for _ in live:
        group = [min([group[i], *(group[j] for j in np.flatnonzero(near[i]))]) for i in range(len(live))]
    out = {i: (r[0], 0, r[0], True) for i, r in enumerate(rows)}
    for i, at in enumerate(live):
        if near[i].any():
            ids = [rows[live[j]][0] for j in range(len(live)) if group[j] == group[i] and rows[live[j]][0] is not None]
            least = min(ids, default=None)
            out[at] = (rows[at][0], int(near[i].sum()), least, rows[at][0] is not None and rows[at][0] == least)
    return sorted(out.values(), key=repr)


def test_vector_groups(spark, table):
    got = vecdedup.near_duplicates(table)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == grouped(awkward())


def test_vector_groups_in_small_blocks(spark, table, monkeypatch):
    monkeypatch.setattr(vecdedup, "BLOCK_ROWS", 5)
    got = vecdedup.near_duplicates(table.filter("vec_id < 1000"))
    assert sorted(map(tuple, got.collect()), key=repr) == grouped([r for r in awkward() if r[0] is not None and r[0] < 1000])


def test_vector_groups_find_pairs_at_the_limit(spark):
    """Recall over pairs of cosine 0.9 to 0.92, each alone, against brute force."""
    rng = np.random.default_rng(8)
    first = unit(rng, 600, 64)
    second = np.array([tilted(rng, v, c) for v, c in zip(first, rng.uniform(0.9002, 0.92, 600))])
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([first, second]))]
    got = vecdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = {r["vec_id"]: r["n_links"] for r in got.collect()}
    assert sum(found[i] == 1 for i in range(600)) >= 0.97 * 600 and max(found.values()) == 1


def test_vector_groups_of_copies_form_no_pairs(spark):
    """A group of 3,000 near copies is linked in full; its pairs are counted by balls and blocks."""
    rng = np.random.default_rng(9)
    centre = unit(rng, 1, 32)[0]
    x = np.vstack([unit(rng, 300, 32), [tilted(rng, centre, c) for c in rng.uniform(0.985, 1, 3000)]])
    rows = [(i, v.tolist(), 0, *EXTRA) for i, v in enumerate(x)]
    got = vecdedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    near = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.9
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate((near.sum(axis=1) - 1).tolist()))
    assert sum(r["kept"] for r in got if r["vec_id"] >= 300) == 1


def test_vector_query_matches_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    u = np.array([v for _, v in rows])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in QUERIES["op12_vector_near_dedup"](spark, SF).collect()}
    assert got == {i: int(n) for (i, _), n in zip(rows, links)}


def test_empty_vector_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vecdedup.near_duplicates(empty).collect() == []
    assert hardneg.hard_negatives(empty, F.col("vec_id") % 2 == 0).collect() == []
    assert whitening.whiten(empty).collect() == []
    nothing = spark.createDataFrame([(1, None, 1, *EXTRA), (2, [], 1, *EXTRA)], SCHEMA)
    assert {tuple(r) for r in vecdedup.near_duplicates(nothing).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}
    assert whitening.whiten(nothing).collect() == [] and hardneg.hard_negatives(nothing, F.lit(True)).collect() == []


def test_decoding_finds_the_nearest_lattice_point():
    near = lattice.neighbours()
    assert len(near) == 240 and np.allclose((near**2).sum(axis=1), 2)
    z = np.random.default_rng(1).normal(size=(500, 8)) * 3
    own = lattice.decode(z)
    # No neighbour of the decoded point is nearer, and the points are in the lattice.
    away = ((z[:, None] - own[:, None] - near[None]) ** 2).sum(axis=2).min(axis=1)
    assert (((z - own) ** 2).sum(axis=1) <= away + 1e-12).all()
    assert ((own * 2) % 2 == (own[:, :1] * 2) % 2).all() and (own.sum(axis=1) % 2 == 0).all()


def mined(rows, anchors, positives=5, negatives=3):
    live = {}
    for r in rows:
        if r[0] is not None and r[2] is not None and is_usable(r[1]):
            one = (r[2], [float(math.floor(256 * x)) for x in r[1]])
            live[r[0]] = min(live.get(r[0], one), one)
    ids = sorted(live)
    x = padded([live[i][1] for i in ids])
    scores = (x @ x.T).astype(int)
    out = []
    for a, i in enumerate(ids):
        if not anchors(i):
            continue
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-scores[a, b], ids[b]))
        for p in [b for b in order if live[ids[b]][0] == live[i][0]][:positives]:
            s = scores[a, p]
            fit = [b for b in order if live[ids[b]][0] != live[i][0] and 50 * s <= 100 * scores[a, b] <= 95 * s]
            out += [(i, ids[p], k, ids[b], int(s), int(scores[a, b])) for k, b in enumerate(fit[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("rows", [4096, 8])
def test_hard_negatives(spark, table, monkeypatch, rows):
    monkeypatch.setattr(gnat, "leaf_rows", lambda n: rows)
    got = hardneg.hard_negatives(table, F.col("vec_id") % 3 == 0)
    want = mined(awkward(), lambda i: i % 3 == 0)
    assert want and sorted(map(tuple, got.collect())) == want


def test_hard_negatives_with_ties_and_one_hot_vector(spark, monkeypatch):
    """A third of the rows is one vector, all scores whole ties; parts stay small and the smaller keys win."""
    monkeypatch.setattr(gnat, "leaf_rows", lambda n: 16)
    rng = np.random.default_rng(2)
    few = rng.integers(-2, 3, size=(6, 4)) / 2.0
    rows = [(i, few[0 if i % 3 == 0 else i % 6].tolist(), i % 5, *EXTRA) for i in range(300)]
    got = hardneg.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    want = mined([(r[0], r[1], r[2]) for r in rows], lambda i: i % 10 == 0)
    assert want == sorted(map(tuple, got.collect()))


def test_ranges_rule_out_far_subtrees():
    """Clustered rows: an anchor's annulus leaves more than half of the leaves out, but never one that holds an answer."""
    rng = np.random.default_rng(6)
    centres = unit(rng, 40, 24) * 256
    x = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 24)) * 4)
    longest = float((x * x).sum(axis=1).max())
    tree = gnat.plant(x[::2], 2000 * 40, longest)
    for node in tree.nodes:
        node.low = np.full((len(node.points),) * 2, np.inf)
        node.high = -node.low
    for at, _, apart, nearest in tree.walk(tree.lift(x)):
        node = tree.nodes[at]
        for j in np.unique(nearest):
            node.low[:, j] = np.minimum(node.low[:, j], apart[nearest == j].min(axis=0))
            node.high[:, j] = np.maximum(node.high[:, j], apart[nearest == j].max(axis=0))
    leaf = tree.leaf_of(x)
    queries = x[::50]
    scores = queries @ x.T
    bar = np.sort(scores, axis=1)[:, -20]
    around = (queries**2).sum(axis=1) + longest
    alive = tree.reachable(queries, np.zeros(len(queries)), np.sqrt(np.maximum(0, around - 2 * bar)))
    hit = np.zeros_like(alive)
    for i in range(len(queries)):
        hit[i, leaf[scores[i] >= bar[i]]] = True
    used = len(np.unique(leaf))
    assert (alive >= hit).all() and alive.sum() < 0.5 * used * len(queries)


def whitened(rows, k=8):
    live = [(r[0], r[1]) for r in rows if is_usable(r[1])]
    x = np.floor(1024 * padded([v for _, v in live])) + 100000
    n, c = len(x), x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    s = [int(v) for v in x.sum(axis=0)]
    deviation = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x]
    return [i for i, _ in live], c @ vectors / np.sqrt(values), values / np.trace(c.T @ c / n), deviation


def test_whitening(spark, table):
    got = whitening.whiten(table).collect()
    ids, want, explained, deviation = whitened(awkward())
    assert len(got) == len(ids) * 8 and {r["n"] for r in got} == {len(ids)}
    assert all(r["identity_error"] < 1e-9 for r in got)
    for c in range(8):
        mine = [r for r in got if r["component"] == c + 1]
        assert all(abs(r["explained"] - explained[c]) < 1e-9 * explained[c] for r in mine)
        assert sorted((repr(r["vec_id"]), r["deviation"]) for r in mine) == sorted((repr(i), d) for i, d in zip(ids, deviation))
        a = sorted((repr(r["vec_id"]), r["deviation"], r["whitened"]) for r in mine)
        b = sorted((repr(i), d, w) for i, d, w in zip(ids, deviation, want[:, c]))
        x, y = np.array([v[2] for v in a]), np.array([v[2] for v in b])
        assert min(np.abs(x - y).max(), np.abs(x + y).max()) < 1e-8


def test_whitening_without_variance_and_with_large_entries(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, None, None), (2, 0, None, None)]
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)]
    flat = whitening.whiten(spark.createDataFrame(line, "vec_id long, embedding array<double>")).collect()
    first = [r for r in flat if r["component"] == 1]
    assert all(r["whitened"] is None and r["explained"] == 0 for r in flat if r["component"] > 1)
    assert abs(first[0]["explained"] - 1) < 1e-12 and abs(np.var([r["whitened"] for r in first]) - 1) < 1e-9
    big = [(i, [float(i * 10**6), float(i % 3) * 10**9]) for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()
    ids, _, explained, deviation = whitened2(big)
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: d if d < 2**63 else None for i, d in zip(ids, deviation)}
    assert {round(r["explained"], 9) for r in got} == {round(float(e), 9) for e in explained}


def whitened2(rows):
    x = [[math.floor(1024 * v) + 100000 for v in r[1]] for r in rows]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    c = np.array([[n * a - b for a, b in zip(row, s)] for row in x], dtype=float) / n
    values = np.linalg.eigvalsh(c.T @ c / n)[::-1]
    return [r[0] for r in rows], None, values / values.sum(), deviation


def test_whitening_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    x = np.floor(1024 * np.array([v for _, v in rows])) + 100000
    c = x - x.mean(axis=0)
    values = np.linalg.eigvalsh(c.T @ c / len(x))[::-1][:8]
    got = QUERIES["op13_whitening"](spark, SF)
    stats = got.groupBy("component").agg(F.avg("whitened").alias("m"), F.var_pop("whitened").alias("v"), F.first("explained").alias("e"))
    for r in stats.collect():
        assert abs(r["m"]) < 1e-9 and abs(r["v"] - 1) < 1e-9
        assert abs(r["e"] * np.trace(c.T @ c / len(x)) - values[r["component"] - 1]) < 1e-8 * values[0]


@pytest.mark.parametrize("spectrum", [[9, 8, 7, 6, 5, 4, 3, 2, 2, 2, 2, 1, 1], [1] * 12, [5, 4, 0, 0, 0], [3], list(range(1, 65))])
def test_contour_finds_all_leading_pairs(spectrum):
    rng = np.random.default_rng(len(spectrum))
    turn = np.linalg.qr(rng.normal(size=(len(spectrum),) * 2))[0]
    a = turn @ np.diag(np.array(spectrum, dtype=float)) @ turn.T
    values, vectors = contour.leading_eigenpairs((a + a.T) / 2, 8)
    want = sorted(spectrum, reverse=True)[:8]
    assert np.allclose(values, want, atol=1e-12 * max(spectrum)) and np.allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-12)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * max(spectrum)
    diagonal, squares = contour.tridiagonal((a + a.T) / 2)
    assert contour.count_above(diagonal, squares, 0.5) == sum(s > 0.5 for s in spectrum)
