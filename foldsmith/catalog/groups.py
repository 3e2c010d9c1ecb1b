"""Queries on groups: odds, statistics, correlation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.catalog.registry import query
from foldsmith.catalog.rows import SQL_CLASS, SQL_ORDER_CLASS, sql_hash32
from foldsmith.catalog.views import DOC_ROLES, ORDER_ROLES, sql_with, table, v_docs, v_orders
from foldsmith.operators import columns, correlation, groupstats, labels, odds
from foldsmith.roles import LABEL_ANY, LABEL_CLASS
from foldsmith.scratch import materialise

KEY = ORDER_ROLES.key
CATS = ORDER_ROLES.categorical
NUMS = list(ORDER_ROLES.numeric)
LINE_CATS = ("l_returnflag", "l_linestatus", "l_shipyear")
LINE_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STATS = ("mean", "med", "min", "max")


# Money columns keep three decimals (the median of two cents amounts has three), the rest six.
MONEY = ("o_totalprice", "c_acctbal", "l_extendedprice")


def _digits(num: str) -> int:
    return 3 if num in MONEY else 6


def _flat(artifact: DataFrame, *values: str) -> DataFrame:
    """(set, k1, k2, ...) with rounded numbers: plain scalars to compare."""
    kinds = dict(artifact.dtypes)
    money = F.col("num").isin(*MONEY) if "num" in kinds else F.lit(False)

    def shown(v):
        if kinds[v] != "double":
            return F.col(v)
        return F.when(money, F.round(v, 3)).otherwise(F.round(v, 6)).alias(v)

    return artifact.select(
        "set", F.get("keys", F.lit(0)).alias("k1"), F.get("keys", F.lit(1)).alias("k2"), *[shown(v) for v in values]
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", F.year("l_shipdate").cast("string").alias("l_shipyear"), *LINE_NUMS
    )


SQL_LINES = (
    "WITH lines AS (SELECT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS VARCHAR) AS l_shipyear, "
    "l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) "
)


def _sql_keys(s: tuple[str, ...]) -> tuple[str, str]:
    second = f"CAST({s[1]} AS VARCHAR)" if len(s) > 1 else "CAST(NULL AS VARCHAR)"
    select = f"'{'_'.join(s)}' AS set, CAST({s[0]} AS VARCHAR) AS k1, {second} AS k2"
    return select, " AND ".join(f"{c} IS NOT NULL" for c in s)


def _sql_stats(source: str, sets, nums) -> str:
    parts = []
    for s in sets:
        select, known = _sql_keys(s)
        for x in nums:
            parts.append(
                f"""SELECT {select}, '{x}' AS num, count({x}) AS n, round(avg({x}), {_digits(x)}) AS mean,
                    round(median({x}), {_digits(x)}) AS med, round(min({x}), {_digits(x)}) AS min,
                    round(max({x}), {_digits(x)}) AS max FROM {source} WHERE {known} GROUP BY {', '.join(s)}"""
            )
    return " UNION ALL ".join(parts)


# --- odds ----------------------------------------------------------------------------------


def _sql_odds(source: str, sets, classes, label: str) -> str:
    parts = []
    for s in sets:
        select, known = _sql_keys(s)
        for c in classes:
            pos, neg = (f"count(*) FILTER (WHERE {label} {op} '{c}')" for op in ("=", "<>"))
            parts.append(
                f"""SELECT {select}, '{c}' AS class, count(*) AS n, {pos} AS pos, {neg} AS neg,
                    round({pos}::DOUBLE / nullif({neg}, 0), 6) AS odds FROM {source} WHERE {known} GROUP BY {', '.join(s)}"""
            )
    return " UNION ALL ".join(parts)


DOC_SETS = [("lang",), ("source",)]
DOC_CLASSES = ("H", "HS", "N", "S")
ANY_CLASSES = ("N", "Y")


def _classed_docs(spark: SparkSession, sf: str) -> DataFrame:
    return labels.with_classes(v_docs(spark, sf), DOC_ROLES)


@query(
    "odds_single",
    sql_with("v_docs")
    + f", d AS (SELECT *, {SQL_CLASS} AS label_class FROM v_docs) "
    + _sql_odds("d", DOC_SETS, DOC_CLASSES, "label_class"),
)
def odds_single(spark: SparkSession, sf: str) -> DataFrame:
    fitted = odds.fit_odds(_classed_docs(spark, sf), LABEL_CLASS, DOC_CLASSES, DOC_SETS)
    return _flat(fitted, "class", "n", "pos", "neg", "odds")


# segment_known and every flag hold nulls, so pairs with them are left out.
ODDS_PAIRS = list(combinations([c for c in CATS if c != "segment_known"], 2))


@query(
    "odds_pair",
    sql_with("v_orders")
    + f", d AS (SELECT *, CASE WHEN {SQL_ORDER_CLASS} = 'N' THEN 'N' ELSE 'Y' END AS label_any FROM v_orders) "
    + _sql_odds("d", [(c,) for c in CATS] + ODDS_PAIRS, ANY_CLASSES, "label_any"),
)
def odds_pair(spark: SparkSession, sf: str) -> DataFrame:
    df = labels.with_classes(v_orders(spark, sf), ORDER_ROLES)
    complete = columns.complete_columns(df, [*CATS, *ORDER_ROLES.binary])
    sets = odds.odds_sets(CATS, ORDER_ROLES.binary, complete)
    return _flat(odds.fit_odds(df, LABEL_ANY, ANY_CLASSES, sets), "class", "n", "pos", "neg", "odds")


# All sets that the roles have: categories, and their pairs with one another and with the flags.
FLAG_SETS = odds.odds_sets(DOC_ROLES.categorical, DOC_ROLES.binary, [*DOC_ROLES.categorical, *DOC_ROLES.binary])


def _sql_odds_attach() -> str:
    cols, joins = [], []
    for i, s in enumerate(FLAG_SETS):
        for c in DOC_CLASSES:
            cols.append(f'round(t{i}."{c}", 6) AS "{"_".join(s)}_{c}_ratios"')
        each = ", ".join(
            f"count(*) FILTER (WHERE label_class = '{c}')::DOUBLE / nullif(count(*) FILTER (WHERE label_class <> '{c}'), 0) AS \"{c}\""
            for c in DOC_CLASSES
        )
        on = " AND ".join(f"f.{c} = t{i}.{c}" for c in s)
        joins.append(f"LEFT JOIN (SELECT {', '.join(s)}, {each} FROM d GROUP BY {', '.join(s)}) t{i} ON {on}")
    return f"SELECT f.doc_id, {', '.join(cols)} FROM doc_features f {' '.join(joins)}"


@query(
    "odds_attach",
    sql_with("doc_features", "v_docs")
    + f", d AS (SELECT *, {SQL_CLASS} AS label_class FROM v_docs) "
    + _sql_odds_attach(),
)
def odds_attach(spark: SparkSession, sf: str) -> DataFrame:
    """Odds fitted on labelled documents, attached to every document."""
    from foldsmith.catalog.views import doc_features

    fitted = odds.fit_odds(_classed_docs(spark, sf), LABEL_CLASS, DOC_CLASSES, FLAG_SETS)
    out = odds.attach_odds(doc_features(spark, sf), fitted, FLAG_SETS, DOC_CLASSES)
    names = [odds.odds_name(s, c) for s in FLAG_SETS for c in DOC_CLASSES]
    return out.select("doc_id", *[F.round(n, 6).alias(n) for n in names])


def _sql_out_of_fold() -> str:
    cols = []
    for s in FLAG_SETS:
        for c in DOC_CLASSES:
            hit = f"count(*) FILTER (WHERE label_class = '{c}')"
            whole, own = f"OVER (PARTITION BY {', '.join(s)})", f"OVER (PARTITION BY {', '.join(s)}, fold)"
            pos, n = f"({hit} {whole} - {hit} {own})", f"(count(*) {whole} - count(*) {own})"
            cols.append(f'round({pos}::DOUBLE / nullif({n} - {pos}, 0), 6) AS "{odds.odds_name(s, c)}"')
    return f"SELECT doc_id, fold, {', '.join(cols)} FROM d"


@query(
    "odds_out_of_fold",
    sql_with("v_docs")
    + f""", d AS (SELECT *, {SQL_CLASS} AS label_class,
                  CAST({sql_hash32(f"'{odds.FOLD_SEED}'", "doc_id::VARCHAR")} % {odds.FOLDS} AS INT) AS fold FROM v_docs) """
    + _sql_out_of_fold(),
)
def odds_out_of_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Odds of the labelled documents themselves, each from the rows of the other folds."""
    rows = materialise(_classed_docs(spark, sf), "labelled-docs")
    fitted = odds.fit_odds(rows, LABEL_CLASS, DOC_CLASSES, FLAG_SETS, DOC_ROLES.key)
    fold = odds.fold_of(DOC_ROLES.key)
    out = odds.attach_odds(rows.withColumn("fold", fold), fitted, FLAG_SETS, DOC_CLASSES, fold)
    names = [odds.odds_name(s, c) for s in FLAG_SETS for c in DOC_CLASSES]
    return out.select("doc_id", "fold", *[F.round(n, 6).alias(n) for n in names])


# --- statistics ----------------------------------------------------------------------------

LINE_SINGLE = [(c,) for c in LINE_CATS]
ORDER_PAIRS = list(combinations(CATS, 2))


@query("stats_single", SQL_LINES + _sql_stats("lines", LINE_SINGLE, LINE_NUMS))
def stats_single(spark: SparkSession, sf: str) -> DataFrame:
    fitted = groupstats.fit_group_stats(lines(spark, sf), groupstats.single_sets(LINE_CATS), LINE_NUMS)
    return _flat(fitted, "num", "n", *STATS)


@query("stats_pair", sql_with("v_orders") + _sql_stats("v_orders", ORDER_PAIRS, NUMS))
def stats_pair(spark: SparkSession, sf: str) -> DataFrame:
    df = materialise(v_orders(spark, sf).select(*CATS, *NUMS), "orders")
    fitted = groupstats.fit_group_stats(df, groupstats.pair_sets(CATS), NUMS)
    return _flat(fitted, "num", "n", *STATS)


ATTACHED_SETS = [*groupstats.single_sets(CATS), *groupstats.pair_sets(CATS)]
ATTACHED_NUMS = NUMS


def _sql_stats_attach() -> str:
    cols, joins = [], []
    for i, s in enumerate(ATTACHED_SETS):
        for x in ATTACHED_NUMS:
            cols += [f'round(t{i}.{x}_{f}, {_digits(x)}) AS "{"_".join(s)}_{x}_{f}"' for f in STATS]
        each = ", ".join(
            f"avg({x}) AS {x}_mean, median({x}) AS {x}_med, min({x}) AS {x}_min, max({x}) AS {x}_max" for x in ATTACHED_NUMS
        )
        on = " AND ".join(f"v.{c} = t{i}.{c}" for c in s)
        joins.append(f"LEFT JOIN (SELECT {', '.join(s)}, {each} FROM v_orders GROUP BY {', '.join(s)}) t{i} ON {on}")
    return f"SELECT v.o_orderkey, {', '.join(cols)} FROM v_orders v {' '.join(joins)}"


@query("stats_attach", sql_with("v_orders") + _sql_stats_attach())
def stats_attach(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics joined back to the rows; rows with a null category keep nulls."""
    df = materialise(v_orders(spark, sf).select(KEY, *CATS, *ATTACHED_NUMS), "orders")
    fitted = groupstats.fit_group_stats(df, ATTACHED_SETS, ATTACHED_NUMS)
    out = groupstats.attach_group_stats(df, fitted, ATTACHED_SETS, ATTACHED_NUMS)
    shown = [
        F.round(groupstats.stat_name(s, x, f), _digits(x)).alias(groupstats.stat_name(s, x, f))
        for s in ATTACHED_SETS
        for x in ATTACHED_NUMS
        for f in STATS
    ]
    return out.select(KEY, *shown)


def _sql_meansd(source: str, sets, nums) -> str:
    parts = []
    for s in sets:
        select, known = _sql_keys(s)
        for x in nums:
            parts.append(
                f"""SELECT {select}, '{x}' AS num, round(avg({x}), {_digits(x)}) AS mean, round(stddev_samp({x}), {_digits(x)}) AS sd
                    FROM {source} WHERE {known} GROUP BY {', '.join(s)}"""
            )
    return " UNION ALL ".join(parts)


@query("stats_meansd", SQL_LINES + _sql_meansd("lines", LINE_SINGLE, LINE_NUMS))
def stats_meansd(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(groupstats.fit_bounds(lines(spark, sf), LINE_SINGLE, LINE_NUMS), "num", "mean", "sd")


def _sql_outlier(x: str, m: str, sd: str) -> str:
    return f"coalesce({x} < {m} - 1.5 * {sd} OR {x} > {m} + 1.5 * {sd}, FALSE)"


def _sql_bounds(source: str, c: str, nums) -> str:
    each = ", ".join(f"avg({x}) AS m_{x}, stddev_samp({x}) AS s_{x}" for x in nums)
    return f"(SELECT {c}, {each} FROM {source} GROUP BY {c})"


@query(
    "outlier_flag",
    sql_with("v_orders")
    + "SELECT v.o_orderkey, "
    + ", ".join(
        f"CAST({_sql_outlier(f'v.{x}', f'b{i}.m_{x}', f'b{i}.s_{x}')} AS INT) AS {c}_{x}_outlier" for i, c in enumerate(CATS) for x in NUMS
    )
    + " FROM v_orders v "
    + " ".join(f"LEFT JOIN {_sql_bounds('v_orders', c, NUMS)} b{i} ON v.{c} = b{i}.{c}" for i, c in enumerate(CATS)),
)
def outlier_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Flags of every number against the bounds of every category."""
    df = materialise(v_orders(spark, sf).select(KEY, *CATS, *NUMS), "orders")
    bounds = materialise(groupstats.fit_bounds(df, [(c,) for c in CATS], NUMS), "bounds")
    out = df
    for c in CATS:
        flagged = groupstats.outlier_flags(out, bounds, c, NUMS)
        out = flagged.withColumnsRenamed({f"{n}_outlier": f"{c}_{n}_outlier" for n in NUMS})
    return out.select(KEY, *[f"{c}_{n}_outlier" for c in CATS for n in NUMS])


@query(
    "outlier_filter",
    SQL_LINES
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS set, l.{c} AS k1, '{x}' AS num, count(*) AS kept, round(sum(l.{x}), 2) AS total
            FROM lines l JOIN {_sql_bounds('lines', c, LINE_NUMS)} b ON l.{c} = b.{c}
            WHERE NOT {_sql_outlier(f'l.{x}', f'b.m_{x}', f'b.s_{x}')} GROUP BY l.{c}"""
        for c in LINE_CATS
        for x in LINE_NUMS
    ),
)
def outlier_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Rows left, and their sum, once each category's outliers are out."""
    df = lines(spark, sf)
    bounds = materialise(groupstats.fit_bounds(df, LINE_SINGLE, LINE_NUMS), "bounds")
    kept = groupstats.kept_rows(df, bounds, LINE_SINGLE, LINE_NUMS)
    per = kept.groupBy("set", "keys", "num").agg(F.count("*").alias("kept"), F.round(F.sum("value"), 2).alias("total"))
    return per.select("set", F.get("keys", F.lit(0)).alias("k1"), "num", "kept", "total")


def _sql_minmax() -> str:
    parts = []
    for c in CATS:
        for x in NUMS:
            parts.append(
                f"""SELECT o_orderkey, '{c}' AS set, CAST({c} AS VARCHAR) AS k1, '{x}' AS num,
                    round((x - min(x) OVER w) / nullif(max(x) OVER w - min(x) OVER w, 0), 6) AS value
                    FROM (SELECT v.o_orderkey, v.{c}, v.{x} AS x FROM v_orders v JOIN {_sql_bounds('v_orders', c, [x])} b ON v.{c} = b.{c}
                          WHERE v.{x} IS NOT NULL AND NOT {_sql_outlier(f'v.{x}', f'b.m_{x}', f'b.s_{x}')})
                    WINDOW w AS (PARTITION BY {c})"""
            )
    return " UNION ALL ".join(parts)


@query("normalize_minmax", sql_with("v_orders") + _sql_minmax())
def normalize_minmax(spark: SparkSession, sf: str) -> DataFrame:
    """Every non-outlier of every number, scaled within each of the row's categories."""
    df = materialise(v_orders(spark, sf).select(KEY, *CATS, *NUMS), "orders")
    sets = [(c,) for c in CATS]
    bounds = materialise(groupstats.fit_bounds(df, sets, NUMS), "bounds")
    out = groupstats.normalised_values(df, bounds, sets, NUMS, KEY)
    return out.select(KEY, "set", F.get("keys", F.lit(0)).alias("k1"), "num", F.round("value", 6).alias("value"))


def _sql_normalised(source: str, cats, nums) -> str:
    parts = []
    for c in cats:
        for x in nums:
            parts.append(
                f"""SELECT '{c}' AS set, CAST({c} AS VARCHAR) AS k1, CAST(NULL AS VARCHAR) AS k2, '{x}' AS num,
                    round(avg(z), {_digits(x)}) AS mean, round(median(z), {_digits(x)}) AS med, round(min(z), {_digits(x)}) AS min,
                    round(max(z), {_digits(x)}) AS max
                    FROM (SELECT {c}, (x - min(x) OVER w) / nullif(max(x) OVER w - min(x) OVER w, 0) AS z
                          FROM (SELECT l.{c}, l.{x} AS x FROM {source} l JOIN {_sql_bounds(source, c, nums)} b ON l.{c} = b.{c}
                                WHERE NOT {_sql_outlier(f'l.{x}', f'b.m_{x}', f'b.s_{x}')})
                          WINDOW w AS (PARTITION BY {c})) GROUP BY {c}"""
            )
    return " UNION ALL ".join(parts)


@query("stats_normalized", SQL_LINES + _sql_normalised("lines", LINE_CATS, LINE_NUMS))
def stats_normalized(spark: SparkSession, sf: str) -> DataFrame:
    df = lines(spark, sf)
    bounds = groupstats.fit_bounds(df, LINE_SINGLE, LINE_NUMS)
    fitted = groupstats.fit_normalised_stats(df, bounds, LINE_SINGLE, LINE_NUMS)
    return _flat(fitted, "num", *STATS)


# --- correlation ---------------------------------------------------------------------------

SQL_VECTORS = """WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS p, unnest(embedding)::DOUBLE AS v FROM embeddings),
  m AS (SELECT CAST(a.p AS INT) AS i, CAST(b.p AS INT) AS j, count(*) AS n, round(corr(a.v, b.v), 6) AS r
        FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.p < b.p GROUP BY 1, 2) """
DIMENSIONS = 64


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"))


@query("corr_matrix", SQL_VECTORS + "SELECT i, j, n, r FROM m")
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    out = correlation.array_correlation(_vectors(spark, sf), "x", list(range(DIMENSIONS)))
    return out.select("i", "j", "n", F.round("r", 6).alias("r"))


CORR_COLUMNS = [*ORDER_ROLES.numeric, *ORDER_ROLES.binary, "price_twin", "one"]


def _sql_corr_columns() -> str:
    parts = []
    for (i, a), (j, b) in combinations(enumerate(CORR_COLUMNS), 2):
        both = f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        r = "NULL::DOUBLE" if "one" in (a, b) else f"corr({a}, {b})"
        parts.append(f"SELECT {i} AS i, {j} AS j, '{b}' AS dropped, count(*) AS n, {r} AS r FROM d {both}")
    return " UNION ALL ".join(parts)


SQL_CORR = (
    sql_with("v_orders")
    + ", d AS (SELECT *, o_totalprice * 2 + 1 AS price_twin, 1.0::DOUBLE AS one FROM v_orders), m AS ("
    + _sql_corr_columns()
    + ") "
)


def _corr_input(spark: SparkSession, sf: str) -> DataFrame:
    twin = {"price_twin": F.col("o_totalprice") * 2 + 1, "one": F.lit(1.0)}
    return v_orders(spark, sf).withColumns(twin).select(*CORR_COLUMNS)


@query("corr_columns", SQL_CORR + "SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, n, round(r, 6) AS r FROM m")
def corr_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Null flags, a twin column and a constant: pairwise-complete, constant gives null."""
    out = correlation.correlation_matrix(_corr_input(spark, sf), CORR_COLUMNS)
    return out.select("i", "j", "n", F.round("r", 6).alias("r"))


@query("corr_drop", SQL_CORR + "SELECT DISTINCT dropped FROM m WHERE abs(r) > 0.5")
def corr_drop(spark: SparkSession, sf: str) -> DataFrame:
    gone = correlation.drop_correlated(_corr_input(spark, sf), CORR_COLUMNS, 0.5)  # column names
    return spark.createDataFrame([(c,) for c in gone], "dropped string")
