"""The ways taken beyond the size checks give the same results as the short ways."""

import re
import statistics

import pytest
from pyspark.sql import functions as F

from foldsmith.operators import groupstats, medians
from foldsmith.scratch import attach, materialise, salted_join


def skewed(spark, n=6000):
    """Half of the rows share one key; values are skewed and tied."""
    key = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 13).cast("string")))
    value = F.when(F.col("id") % 5 == 0, 7.0).otherwise(F.exp((F.col("id") * 7919 % 1000) / 90.0))
    return spark.range(n).select("id", key.alias("c"), value.alias("x"), (F.col("id") % 3).cast("string").alias("d"))


def want_medians(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["c"], []).append(r["x"])
    return {k: statistics.median(v) for k, v in groups.items()}


@pytest.mark.parametrize("bracket", [1_000_000, 3])
def test_bracketed_medians_are_exact(spark, bracket):
    df = skewed(spark)
    long = df.select("c", F.col("x").alias("value"))
    got = {r["c"]: r["med"] for r in medians.grouped_medians(long, ["c"], 10, bracket).collect()}
    want = want_medians(df.collect())
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, rel=1e-12) for k, v in want.items())


def test_statistics_same_on_both_ways(spark):
    df = skewed(spark, 1500)
    sets, nums = [("c",), ("c", "d")], ["x"]

    def table(rows):
        return {(r["set"], tuple(r["keys"]), r["num"]): tuple(r)[3:] for r in rows.collect()}

    short, far = (table(groupstats.fit_group_stats(df, sets, nums, limit)) for limit in (10**6, 10))
    assert short.keys() == far.keys()
    for k in short:
        assert far[k] == pytest.approx(short[k], rel=1e-9)
    bounds = groupstats.fit_bounds(df, [("c",)], nums)
    short, far = (table(groupstats.fit_normalised_stats(df, bounds, [("c",)], nums, 1.5, n)) for n in (10**6, 10))
    for k in short:
        assert far[k] == pytest.approx(short[k], rel=1e-9)


def test_statistics_list_no_row_per_set_and_number(spark, monkeypatch):
    """Counts by cells bring the middle of many numbers and sets; only cells with several values are read again."""
    from foldsmith.operators import histograms

    monkeypatch.setattr(histograms, "CELLS_PER_NUMBER", 8)
    monkeypatch.setattr(histograms, "BLOCK_NUMBERS", 500)
    monkeypatch.setattr(histograms, "HELD_ROWS", 40)
    nan = F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).when(F.col("id") % 4 > 0, F.col("x"))
    zero = F.when(F.col("id") % 2 == 0, 0.0).otherwise(-0.0)
    df = skewed(spark, 1500).withColumns({"few": (F.col("id") % 3).cast("double"), "odd": nan, "z": zero})
    df = df.withColumns({"none": F.lit(None).cast("double"), "d": F.when(F.col("id") % 9 > 0, F.col("d"))})
    nums, sets = ["x", "few", "odd", "none"], [("c",), ("d",), ("c", "d"), ("id",)]
    rows = groupstats.explode_sets(df, sets, nums)
    each = [F.median(n).alias(n) for n in nums]
    want = {tuple(r)[:3]: tuple(r)[3:] for r in rows.groupBy("set_id", "k1", "k2").agg(*each).collect()}
    for source, own in ((df, sets), (rows, None)):
        got = medians.wide_medians(source, own, nums).collect()
        assert len(got) == len({tuple(r)[:4] for r in got}) == sum(v is not None for each in want.values() for v in each)
        for r in got:
            assert r["med"] == pytest.approx(want[tuple(r)[:3]][r["num_id"]], rel=1e-12, nan_ok=True)
    plan = groupstats.fit_group_stats(df, sets[:3], ["few"], 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan
    counted = histograms.cell_counts(df, [("z",)], ["few"], [[0.5, 1.5]]).filter("set_id >= 0")
    assert {tuple(r) for r in counted.groupBy("k1", "cell").agg(F.sum("n")).collect()} == {("0.0", c, 500) for c in (1, 2, 3)}


def test_statistics_of_counted_groups_are_those_of_all_rows(spark):
    """Numbers made of flags are read from the distinct flags of each group: nulls, a constant, both median routes."""
    df = skewed(spark, 1500).withColumns({
        "c": F.when(F.col("id") % 11 > 0, F.col("c")),
        "f": F.when(F.col("id") % 4 > 0, (F.col("id") % 3).cast("double")),
        "g": (F.col("id") % 7 == 0).cast("double"),
    })

    def numbers(rows):
        return rows.withColumns({"s": F.col("f") + F.col("g"), "far": F.col("f") + 1e6, "same": F.lit(0.3), "none": F.lit(None).cast("double")})

    sets, nums = [("c",), ("d",), ("c", "d")], ["s", "far", "same", "none"]
    counted = groupstats.counted_groups(df, sets, ["f", "g"])
    assert counted.count() < 500 and counted.filter("set_id = 1").agg(F.sum(groupstats.ROWS)).first()[0] == 1500
    rows, few = materialise(numbers(df), "rows"), numbers(counted)
    alone = few.filter("set_id < 2")

    def same(a, b):
        a, b = ({(r["set"], tuple(r["keys"]), r["num"]): tuple(r)[3:] for r in t.collect()} for t in (a, b))
        assert a.keys() == b.keys()
        for k in a:
            assert [v is None for v in a[k]] == [v is None for v in b[k]]
            assert all(x == pytest.approx(y, rel=1e-9, abs=1e-9) for x, y in zip(a[k], b[k]) if y is not None)

    bounds = groupstats.fit_bounds(rows, sets[:2], nums)
    same(groupstats.fit_bounds(alone, sets[:2], nums, groupstats.ROWS), bounds)
    for limit in (10**6, 10):
        same(groupstats.fit_group_stats(few, sets, nums, limit, groupstats.ROWS), groupstats.fit_group_stats(rows, sets, nums, limit))
        want = groupstats.fit_normalised_stats(rows, bounds, sets[:2], nums, 0.9, limit)
        same(groupstats.fit_normalised_stats(alone, bounds, sets[:2], nums, 0.9, limit, groupstats.ROWS), want)


def test_salted_join_equals_broadcast(spark):
    df = skewed(spark, 500).withColumn("c", F.when(F.col("id") % 7 != 0, F.col("c")))
    lookup = df.filter("c is not null").groupBy("c").agg(F.count("*").alias("n"))
    for how in ("left", "inner"):
        small = attach(df, lookup, ["c"], how, ["id"])
        large = salted_join(df, lookup, ["c"], how, ["id"])
        assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()
        assert sorted(map(tuple, small.select("id", "n").collect())) == sorted(
            map(tuple, large.select("id", "n").collect())
        )
    beyond = attach(df, lookup, ["c"], "left", ["id"], max_cells=1)
    assert "_salt" in beyond._jdf.queryExecution().logical().toString()


def test_category_of_five_thousand_values_is_used(spark):
    """A category far beyond any histogram's bins drives the label, and the model finds it."""
    from foldsmith.functions import expressions as E
    from foldsmith.operators import encode, models

    value = (F.col("id") % 5000).cast("string")
    hit = (E.uniform(3, 1, value) > 0.5).cast("double")
    rows = spark.range(40000).select("id", value.alias("c"), hit.alias("y"), E.uniform(4, 2, F.col("id")).alias("noise"))
    rates = encode.fit_rates(rows, ["c"], [F.col("y")], "id")
    coded = encode.with_rates(rows, rates, ["c"], 1, "id", F.lit(True))
    ready = coded.select((F.col("y")).alias(models.TARGET), F.lit(1.0).alias(models.WEIGHT), "c_idx_0", F.array("noise").alias("x"))
    ready = models.assemble(ready, "x", [0], ["c_idx_0"])
    fit = models.classifier(models.ModelSpec(kind="forest", rounds=3, feature_share=1.0), 2).fit(ready)
    assert fit.featureImportances.toArray()[0] > 0.9


def test_codes_leave_out_the_own_label(spark):
    """A value of its own for every row gets the overall share, not the row's label."""
    from foldsmith.operators import encode

    rows = spark.range(400).select("id", F.col("id").cast("string").alias("c"), (F.col("id") % 2).cast("double").alias("y"))
    rates = encode.fit_rates(rows, ["c"], [F.col("y")], "id")
    codes = encode.with_rates(rows, rates, ["c"], 1, "id", F.lit(True)).select("c_idx_0").distinct().collect()
    assert [r[0] for r in codes] == [pytest.approx(0.5)]
    seen = encode.with_rates(rows, rates, ["c"], 1, "id", F.lit(False)).agg(F.countDistinct("c_idx_0")).first()[0]
    assert seen == 2


def test_reversed_sets_and_equal_names_are_refused(spark):
    from foldsmith.operators.keysets import grouping_sets_agg
    from foldsmith.plans.factory import FactorySpec, layout
    from foldsmith.plans.selector import SelectorSpec
    from foldsmith.roles import Roles

    with pytest.raises(ValueError):
        grouping_sets_agg(skewed(spark, 10), [("c", "d"), ("d", "c")], [F.count("*").alias("n")])
    roles = Roles(key="id", numeric=("x", "b_x"), categorical=("a", "b", "a_b"), labels=("p", "q"))
    whole = spark.createDataFrame([(c, 0) for c in roles.inputs], "column string, nulls bigint")
    with pytest.raises(ValueError):
        layout(roles, FactorySpec(), ("N", "Y"), whole)
    with pytest.raises(ValueError):
        SelectorSpec(scorer="boosted")


def test_three_classes_boosted(spark):
    from foldsmith.functions import expressions as E
    from foldsmith.operators import models

    x = E.uniform(5, 1, F.col("id"))
    label = F.when(x < 0.3, "H").when(x < 0.6, "HS").otherwise("S")
    rows = models.assemble(spark.range(900).select("id", label.alias("k"), F.array(x).alias("x")), "x", [0], [])
    spec = models.ModelSpec(kind="gbt", rounds=3, depth=2, min_rows=5, row_share=1.0, feature_share=1.0)
    model = models.fit_classifier(rows, "k", ("H", "HS", "S"), spec)
    p = models.class_probabilities(model.transform(rows), ("H", "HS", "S"))
    out = model.transform(rows).select("k", *[v.alias(c) for c, v in p.items()]).collect()
    assert all(abs(r["H"] + r["HS"] + r["S"] - 1) < 1e-9 for r in out)
    assert sum(max(("H", "HS", "S"), key=lambda c: r[c]) == r["k"] for r in out) > 0.95 * len(out)


def test_stale_stages_run_again(spark):
    from foldsmith.scratch import fresh_path
    from foldsmith.sources.stages import StageStore

    root = fresh_path(spark, "stale")
    steps = [("one", lambda t: {"one": spark.range(3)})]
    assert StageStore(spark, root, "a").run(steps)[1] == ["one"]
    assert StageStore(spark, root, "a").run(steps)[1] == []
    assert StageStore(spark, root, "b").run(steps)[1] == ["one"]


def correlated_rows(spark, n, width):
    """Columns in groups that share a signal, some with nulls, a constant and twins of either sign."""
    from foldsmith.functions import expressions as E

    def column(k):
        base = E.uniform(6, k % 7, F.col("id"))
        value = base + E.uniform(8, k, F.col("id")) * (0.02 if k % 3 else 2.0)
        if k % 11 == 5:
            return F.when(F.col("id") % (k + 2) > 0, value)
        return F.lit(3.0) if k % 13 == 12 else value * (-1 if k % 2 else 1)

    return spark.range(n).select(F.array(*[column(k) for k in range(width)]).alias("x"))


def test_correlation_blocks_scan_once_each(spark, monkeypatch):
    """Ten blocks give the drops of brute force with at most one scan each, which reads the blocks it needs; angles and
    earlier drops leave fewer pairs to compare."""
    import numpy as np

    from foldsmith.operators import correlation

    width, limit = 60, 0.9
    rows = materialise(correlated_rows(spark, 400, width), "rows")
    order = list(range(width - 1, -1, -1))
    x = np.array([[np.nan if v is None else v for v in r["x"]] for r in rows.collect()])[:, order]
    want = set()
    for j in range(width):
        for i in range(j):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            if a.std() > 1e-9 and b.std() > 1e-9 and abs(np.corrcoef(a, b)[0, 1]) > limit:
                want.add(order[j])
    assert 10 < len(want) < width - 10
    assert correlation.drop_positions(rows, "x", order, limit) == want

    scans = []
    kept = correlation.array_correlation

    def counted(df, column, order, rows=None, cols=None, means=None, wanted=None):
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans.append((int(wanted.sum()), sorted(set(re.findall(r"b\d+(?=:array)", plan)))))
        return kept(df, column, order, rows, cols, means, wanted)

    monkeypatch.setattr(correlation, "array_correlation", counted)
    assert correlation.drop_positions(rows, "x", order, limit, block=6) == want
    pivots, blocks = scans[0], scans[1:]
    assert pivots[0] <= correlation.PIVOTS * width and len(blocks) <= 10
    assert sum(n for n, _ in blocks) < width * (width - 1) / 4
    assert any("b0" not in read and read for _, read in blocks)


def two_ends(spark):
    """A group of two far clusters with the middle ranks apart, one with a heavy tail, one small."""
    low = F.when(F.col("id") % 2 == 0, 1.0 + F.col("id") * 1e-6).otherwise(1e9 + F.col("id"))
    tail = F.exp(F.col("id") * 0.2)
    return spark.range(3000).select(F.lit("ends").alias("c"), low.alias("x")).union(
        spark.range(3001).select(F.lit("tail"), tail)
    ).union(spark.range(5).select(F.lit("few"), F.col("id").cast("double")))


def test_no_sort_of_medians_exceeds_the_limit(spark, monkeypatch):
    """Two clusters, a heavy tail and a small group: exact, and no group sorts more distinct values than allowed."""
    df = two_ends(spark)
    sorts = []
    kept = medians._ranked

    def counted(inner, state, keys):
        held = inner.join(state, keys).groupBy(*keys).agg(F.count("*").alias("n"))
        sorts.extend(r["n"] for r in held.collect())
        return kept(inner, state, keys)

    monkeypatch.setattr(medians, "_ranked", counted)
    long = df.select("c", F.col("x").alias("value"))
    # Brackets of half the ranks, so that narrowing has work to do.
    got, missed = medians._one_bracket(long, ["c"], 0.4, 20)
    assert missed.isEmpty()
    assert {r["c"]: r["med"] for r in got.collect()} == {k: pytest.approx(v, rel=1e-12) for k, v in want_medians(df.collect()).items()}
    assert sorts and max(sorts) <= 20


def test_short_lived_tables_go(spark):
    import os

    from foldsmith.scratch import short_lived

    with short_lived(spark):
        gone = materialise(spark.range(3), "gone")
        kept = materialise(gone.filter("id > 0"), "kept", keep=True)
    assert kept.count() == 2
    assert not os.path.exists(gone.inputFiles()[0].removeprefix("file://"))


def test_category_ranks_need_no_window_over_all_values(spark):
    """5,000 values in several ranges get the codes of one sorted list; every window over values has a range in its key."""
    from foldsmith.operators import encode

    rows = spark.range(20000).select(
        F.concat(F.lit("v"), (F.col("id") * 7919 % 5000).cast("string")).alias("c"), F.when(F.col("id") % 3 > 0, "x").alias("d")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seen = []
    kept = encode.materialise
    try:
        encode.materialise = lambda df, name: (seen.append((df, kept(df, name))), seen[-1][1])[1]
        index = encode.fit_index(rows, ["c", "d"])
    finally:
        encode.materialise = kept
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {(r["category"], r["value"]): r["code"] for r in index.collect()}
    want = sorted({f"v{i}" for i in range(5000)})
    assert got == {("d", "x"): 0.0, **{("c", v): float(i) for i, v in enumerate(want)}}
    plan = seen[-1][0]._jdf.queryExecution().optimizedPlan().toString()
    numbered = [x for x in re.findall(r"Window \[(.*)", plan) if "row_number" in x]
    assert len(numbered) == 1 and re.search(r"\], \[category#\d+, range#\d+\]", numbered[0])
    assert seen[0][1].select("range").distinct().count() > 1
