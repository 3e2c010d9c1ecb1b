"""Null, NaN and constant-column rules."""

import math

import pytest
from pyspark.sql import functions as F

from foldsmith.functions import expressions as E
from foldsmith.operators import auc, correlation, groupstats, odds, selection, splits
from foldsmith.operators.combine import add_combinations, combination_array, combination_names


def one(df):
    return df.first()[0]


def test_scalar_null_rules(spark):
    df = spark.createDataFrame(
        [(None, None), (2.0, "a"), (0.5, "z"), (float("nan"), "b")], "x double, c string"
    )
    got = [r[0] for r in df.select(E.clip_to_one(E.finite(F.col("x")))).collect()]
    assert got == [None, 1.0, 0.5, None]
    assert [r[0] for r in df.select(E.ordinal_code(F.col("c"), ("a", "b"))).collect()] == [-1.0, 1.0, -1.0, 2.0]
    assert [r[0] for r in df.select(E.is_outlier(F.col("x"), F.lit(None).cast("double"), F.lit(1.0))).collect()] == [
        False
    ] * 4


def test_label_class_with_null_is_none(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (None, 1), (1, None)], "a int, b int")
    assert [r[0] for r in df.select(E.label_class(F.col("a"), F.col("b"))).collect()] == ["HS", "H", "S", "N", "N", "N"]


@pytest.mark.parametrize("mode", ["all", "legacy"])
def test_array_layout_equals_columns(spark, mode):
    flags = ("a", "b", "c", "d", "e")
    rows = [(i, *[None if (i + k) % 7 == 0 else float((i >> k) & 1) for k in range(5)]) for i in range(32)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, e double")
    names = [n for n, _ in combination_names(flags, mode)]
    wide = add_combinations(df, flags, mode).orderBy("id").select(*names).collect()
    arrays = df.orderBy("id").select(combination_array(flags, mode)).collect()
    assert [list(r) for r in wide] == [r[0] for r in arrays]


def test_groups_with_null_key_and_single_row(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 9.0), ("a", None)]
    df = spark.createDataFrame(rows, "c string, x double")
    stats = {tuple(r["keys"]): r for r in groupstats.fit_group_stats(df, [("c",)], ["x"]).collect()}
    assert set(stats) == {("a",), ("b",)}
    assert (stats[("a",)]["n"], stats[("a",)]["mean"], stats[("a",)]["med"]) == (2, 2.0, 2.0)
    bounds = groupstats.fit_bounds(df, [("c",)], ["x"])
    assert {tuple(r["keys"]): r["sd"] for r in bounds.collect()}[("b",)] is None
    scaled = {tuple(r["keys"]): r for r in groupstats.fit_normalised_stats(df, bounds, [("c",)], ["x"]).collect()}
    assert scaled[("b",)]["mean"] is None and scaled[("a",)]["mean"] == 0.5
    attached = groupstats.attach_group_stats(df, groupstats.fit_group_stats(df, [("c",)], ["x"]), [("c",)], ["x"])
    assert attached.filter("c is null").first()["c_x_mean"] is None


def test_odds_without_negatives_is_null(spark):
    df = spark.createDataFrame([("a", "Y"), ("a", "Y"), ("b", "N"), (None, "Y")], "c string, y string")
    got = {(r["keys"][0], r["class"]): r["odds"] for r in odds.fit_odds(df, "y", ("N", "Y"), [("c",)]).collect()}
    assert got == {("a", "N"): 0.0, ("a", "Y"): None, ("b", "N"): None, ("b", "Y"): 0.0}
    with pytest.raises(ValueError):
        odds.attach_odds(df.drop("c"), odds.fit_odds(df, "y", ("N", "Y"), [("c",)]), [("c",)], ("N", "Y"))


def test_correlation_constant_null_and_blocks(spark):
    rows = [(float(i), 2.0 * i + 1, 1.0, None if i % 3 else float(-i), math.sin(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, one double, gap double, s double")
    cols = df.columns
    got = {(r["i"], r["j"]): r for r in correlation.correlation_matrix(df, cols).collect()}
    assert got[(0, 1)]["r"] == pytest.approx(1.0)
    assert got[(0, 2)]["r"] is None
    assert got[(0, 3)]["n"] == 17 and got[(0, 3)]["r"] == pytest.approx(-1.0)
    x = df.select(F.array(*cols).alias("x"))
    for block in (1, 2, 100):
        assert correlation.drop_positions(x, "x", [0, 1, 2, 3, 4], 0.9, block) == {1, 3}
        assert correlation.drop_positions(x, "x", [3, 1, 0], 0.9, block) == {1, 0}
    assert correlation.drop_correlated(df, ["b", "a", "s"], 0.9) == ["a"]


def test_auc_ties_missing_class_and_many_ranges(spark):
    rows = [(i, int((i * 37) % 101 < 40), float((i * 53) % 97)) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, y int, s double").repartition(7)
    pos = [s for _, y, s in rows if y]
    neg = [s for _, y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["metric"]: r["auc"] for r in auc.auc(df, {
            "y": (F.col("y"), F.col("s")), "none": (F.lit(0), F.col("s")), "flat": (F.col("y"), F.lit(1.0))
        }).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got["y"] == pytest.approx(want)
    assert got["none"] is None and got["flat"] == 0.5


def test_probe_rules(spark):
    imp = spark.createDataFrame(
        [(0, 0, "f", 0.5, False), (0, 0, "g", 0.2, False), (0, 0, "rand1", 0.4, True), (0, 0, "rand2", 0.2, True),
         (0, 1, "f", 0.1, False), (0, 1, "g", 0.3, False), (0, 1, "rand1", -1.0, True), (0, 1, "rand2", -2.0, True)],
        "repeat int, fold int, feature string, importance double, is_probe boolean",
    )
    lax = {r["feature"]: r["votes"] for r in selection.votes(imp, 2).collect()}
    assert lax == {"f": 2, "g": 1}
    assert {r["fold"]: r["cutoff"] for r in selection.probe_cutoff(imp, 1).collect()} == {0: 0.4, 1: 0.0}
    assert [r["feature"] for r in selection.top_k(selection.votes(imp, 2), 10).collect()] == ["f", "g"]


def test_split_is_stable(spark):
    df = spark.range(2000)
    a = {r[0]: r[1] for r in splits.holdout(df, "id").collect()}
    b = {r[0]: r[1] for r in splits.holdout(df.filter("id % 3 = 0").repartition(5), "id").collect()}
    assert all(a[k] == v for k, v in b.items())
    assert 0.15 < sum(v == "holdout" for v in a.values()) / 2000 < 0.25


def test_combinations_by_blocks_are_those_of_rows(spark, monkeypatch):
    """Nulls, NaN and numbers above 1 go the way of the expressions; other columns stay as they are."""
    from foldsmith.operators import combine

    monkeypatch.setattr(combine, "BLOCK_NUMBERS", 300)
    values = [None, 0.0, 1.0, 0.3, 2.0, float("nan")]
    rows = [(i, "x" if i % 3 else None, *(values[i // 6**k % 6] for k in range(4))) for i in range(6**4)]
    df = spark.createDataFrame(rows, "id long, s string, a double, b double, c double, d double")
    for flags in (("a", "b", "c", "d"), ("a", "b"), ("a",)):
        for mode in ("all", "legacy"):
            own = combine.with_combinations(df, flags, "got", mode)
            assert own.columns == [*df.columns, "got"]
            both = own.withColumn("want", combine.combination_array(flags, mode))
            assert both.filter(F.col("got").eqNullSafe(F.col("want"))).count() == len(rows)
    some = combine.with_combinations(df, ("a", "b", "c"), "got", "all", [1, 7, 12])
    want = E.pick("want", [1, 7, 12])
    some = some.withColumn("want", combine.combination_array(("a", "b", "c"), "all"))
    assert some.filter(F.col("got").eqNullSafe(want)).count() == len(rows)
