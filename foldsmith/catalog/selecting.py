"""Queries on selection and scoring."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.catalog.registry import query
from foldsmith.catalog.rows import SQL_CLASS, sql_hash32
from foldsmith.catalog.views import DOC_ROLES, ORDER_ROLES, sql_with, v_docs, v_orders
from foldsmith.functions.names import pair_column, penalty
from foldsmith.operators import auc, combine, labels, selection, splits
from foldsmith.plans import selector
from foldsmith.plans.selector import SelectorSpec
from foldsmith.roles import LABEL_CLASS
from foldsmith.scratch import materialise

KEY = ORDER_ROLES.key
FOLDS, REPEATS, PROBES = 5, 5, 10
PRIORITIES, SEGMENTS = ("1-URGENT", "5-LOW"), ("BUILDING", "MACHINERY")
PAIR_CLIPPED = [f"{pair_column(a, b)}_comb" for a, b in combinations(ORDER_ROLES.binary, 2)]
DUMMIES = {
    **{f"o_orderpriority_is_{v[0]}": ("o_orderpriority", v) for v in PRIORITIES},
    **{f"c_mktsegment_is_{v.lower()}": ("c_mktsegment", v) for v in SEGMENTS},
}
CROSSED = {
    f"o_orderpriority_c_mktsegment_{p[0]}_{s.lower()}": (p, s) for p in PRIORITIES for s in SEGMENTS
}
FEATURES = [*ORDER_ROLES.numeric, *ORDER_ROLES.binary, *PAIR_CLIPPED, *DUMMIES, *CROSSED]
TOP_K = 12

# --- the long importance table and everything after it -------------------------------------


def _features_sql() -> str:
    cols = [f"{c}::DOUBLE AS {c}" for c in (*ORDER_ROLES.numeric, *ORDER_ROLES.binary)]
    for a, b in combinations(ORDER_ROLES.binary, 2):
        cols.append(f"CASE WHEN {a} + {b} > 1 THEN 1.0::DOUBLE ELSE {a} + {b} END AS {a}_or_{b}_comb")
    for n, (c, v) in DUMMIES.items():
        cols.append(f"""CAST({c} = '{v}' AS INT)::DOUBLE AS "{n}" """)
    for n, (p, s) in CROSSED.items():
        cols.append(f"""CAST(o_orderpriority = '{p}' AND c_mktsegment = '{s}' AS INT)::DOUBLE AS "{n}" """)
    for i in range(1, PROBES + 1):
        cols.append(f"""({sql_hash32("'1'", f"'{i}'", "o_orderkey::VARCHAR")} + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS rand{i}""")
    for r in range(REPEATS):
        cols.append(f"""CAST({sql_hash32("'100'", f"'{r}'", "o_orderkey::VARCHAR")} % {FOLDS} AS INT) AS fold_{r}""")
    return f"""SELECT o_orderkey, returned::DOUBLE AS y, {', '.join(cols)} FROM v_orders
               WHERE returned IS NOT NULL AND {sql_hash32("'100'", "o_orderkey::VARCHAR")} % 1000000 >= 200000"""


ALL_FEATURES = [*FEATURES, *splits.probe_names(PROBES)]


def _sql_importances() -> str:
    parts = []
    for r in range(REPEATS):
        each = ", ".join(f"corr(x.\"{f}\", x.y) AS \"{f}\"" for f in ALL_FEATURES)
        wide = f"""SELECT {r} AS repeat, g.fold, {each} FROM x JOIN (SELECT DISTINCT fold_{r} AS fold FROM x) g
                   ON x.fold_{r} <> g.fold GROUP BY g.fold"""
        weights = "CASE feature " + " ".join(
            f"WHEN '{f}' THEN {penalty(f, ORDER_ROLES.penalties)}::DOUBLE" for f in ALL_FEATURES
        ) + " END"
        parts.append(
            f"""SELECT repeat, fold, feature, coalesce(abs(r), 0) * ({weights}) AS importance, feature LIKE 'rand%' AS is_probe
                FROM (UNPIVOT ({wide}) ON {', '.join(chr(34) + f + chr(34) for f in ALL_FEATURES)} INTO NAME feature VALUE r)"""
        )
    return " UNION ALL ".join(parts)


SQL_IMP = sql_with("v_orders") + f", x AS MATERIALIZED ({_features_sql()}), imp AS MATERIALIZED ({_sql_importances()})"
SQL_CUT = (
    SQL_IMP
    + """, cut AS (SELECT repeat, fold, list_sort(list(greatest(importance, 0)), 'DESC')[2] AS cutoff
                   FROM imp WHERE is_probe GROUP BY repeat, fold),
         votes AS (SELECT feature, count(*) AS votes FROM imp JOIN cut USING (repeat, fold)
                   WHERE NOT is_probe AND importance > cutoff GROUP BY feature)"""
)


def _selection_rows(spark: SparkSession, sf: str) -> DataFrame:
    df = v_orders(spark, sf).filter(F.col("returned").isNotNull())
    df = splits.holdout(df, KEY).filter(F.col(splits.SPLIT) == "train")
    pairs = combine.pair_columns(ORDER_ROLES.binary)
    cols = {n: pairs[n] for n in PAIR_CLIPPED}
    for n, (c, v) in DUMMIES.items():
        cols[n] = (F.col(c) == v).cast("double")
    for n, (p, s) in CROSSED.items():
        cols[n] = ((F.col("o_orderpriority") == p) & (F.col("c_mktsegment") == s)).cast("double")
    df = splits.probes(df.withColumns(cols), KEY, PROBES)
    values = F.array(*[F.col(f).cast("double") for f in ALL_FEATURES]).alias("features")
    folded = splits.folds(df, KEY, FOLDS, REPEATS)
    rows = folded.select("returned", values, *[splits.fold_column(r) for r in range(REPEATS)])
    return materialise(rows, "selection-rows")


def importances(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    raw = selection.abs_corr_importances(
        _selection_rows(spark, sf) if rows is None else rows, "features", ALL_FEATURES, F.col("returned"), FOLDS, REPEATS,
        set(splits.probe_names(PROBES)),
    )
    return selection.penalise(raw, selection.penalties(spark, ALL_FEATURES, ORDER_ROLES.penalties))


@query(
    "importance_abs_corr",
    SQL_IMP + "SELECT CAST(repeat AS INT) AS repeat, CAST(fold AS INT) AS fold, feature, round(importance, 6) AS importance, is_probe FROM imp",
)
def importance_abs_corr(spark: SparkSession, sf: str) -> DataFrame:
    return importances(spark, sf).withColumn("importance", F.round("importance", 6))


@query("probe_cutoff", SQL_CUT + "SELECT CAST(repeat AS INT) AS repeat, CAST(fold AS INT) AS fold, round(cutoff, 6) AS cutoff FROM cut")
def probe_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return selection.probe_cutoff(importances(spark, sf)).withColumn("cutoff", F.round("cutoff", 6))


@query("select_votes", SQL_CUT + "SELECT feature, votes FROM votes ORDER BY votes DESC, feature")
def select_votes(spark: SparkSession, sf: str) -> DataFrame:
    return selection.vote_report(selection.votes(importances(spark, sf)))


@query("select_topk", SQL_CUT + f"SELECT feature, votes FROM votes ORDER BY votes DESC, feature LIMIT {TOP_K}")
def select_topk(spark: SparkSession, sf: str) -> DataFrame:
    return selection.top_k(selection.votes(importances(spark, sf)), TOP_K)


DROP_CORR, CANDIDATES = 0.9, 20


def _sql_selected() -> str:
    """The most voted features less those that correlate with an earlier one, in the order of their votes."""
    pairs = list(combinations(FEATURES, 2))
    wide = ", ".join(f'corr(x."{a}", x."{b}") AS "{a}|{b}"' for a, b in pairs)
    names = ", ".join(f'"{a}|{b}"' for a, b in pairs)
    return f""", r AS (SELECT split_part(p, '|', 1) AS a, split_part(p, '|', 2) AS b, abs(r) AS r
                       FROM (UNPIVOT (SELECT {wide} FROM x) ON {names} INTO NAME p VALUE r)),
        best AS (SELECT feature, votes, row_number() OVER (ORDER BY votes DESC, feature) AS place FROM votes),
        top AS (SELECT * FROM best WHERE place <= {CANDIDATES}),
        gone AS (SELECT DISTINCT later.feature FROM top later JOIN top early ON early.place < later.place
                 JOIN r ON r.r > {DROP_CORR} AND ((r.a = early.feature AND r.b = later.feature) OR (r.b = early.feature AND r.a = later.feature)))
        SELECT CAST(row_number() OVER (ORDER BY place) AS INT) AS rank, feature, votes
        FROM top WHERE feature NOT IN (SELECT feature FROM gone)"""


@query("select_features", SQL_CUT + _sql_selected())
def select_features(spark: SparkSession, sf: str) -> DataFrame:
    """The selector's own votes, top-k and correlation drop over the order features."""
    rows = _selection_rows(spark, sf)
    spec = SelectorSpec(scorer="abs_corr", top_k=CANDIDATES, drop_corr=DROP_CORR)
    _, selected = selector.select(rows, importances(spark, sf, rows), list(enumerate(FEATURES)), spec)
    return selected.select("rank", "feature", "votes")


@query(
    "importance_topn",
    SQL_IMP
    + """SELECT feature, round(importance, 6) AS importance FROM (
           SELECT feature, avg(importance) AS importance FROM imp WHERE NOT is_probe GROUP BY feature)
         ORDER BY round(importance, 6) DESC, feature LIMIT 20""",
)
def importance_topn(spark: SparkSession, sf: str) -> DataFrame:
    mean = importances(spark, sf).filter(~F.col("is_probe")).groupBy("feature").agg(
        F.round(F.avg("importance"), 6).alias("importance")
    )
    return selection.top_importances(mean, 20)


@query(
    "features_used",
    SQL_IMP + "SELECT CAST(repeat AS INT) AS repeat, CAST(fold AS INT) AS fold, count(*) FILTER (WHERE importance > 0) AS n_used FROM imp GROUP BY repeat, fold",
)
def features_used(spark: SparkSession, sf: str) -> DataFrame:
    per_fold = importances(spark, sf).groupBy("repeat", "fold")
    return per_fold.agg(F.count_if(F.col("importance") > 0).alias("n_used"))


# --- AUC -----------------------------------------------------------------------------------


def _sql_auc(source: str, label: str, score: str) -> str:
    """Share of (positive, negative) pairs won, ties half, from average ranks."""
    return f"""(SELECT (sum(CASE WHEN y > 0 THEN rk END) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0)
                FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS rk
                      FROM (SELECT {label}::DOUBLE AS y, {score} AS s FROM {source}) WHERE y IS NOT NULL AND s IS NOT NULL))"""


ORDER_SCORE_A = "o_totalprice * 0.001 + sum_qty"
ORDER_SCORE_B = "n_lines * 0.1 + max_discount"


@query(
    "auc_binary",
    sql_with("v_orders") + f"SELECT 'returned' AS metric, round({_sql_auc('v_orders', 'returned', ORDER_SCORE_A)}, 6) AS auc",
)
def auc_binary(spark: SparkSession, sf: str) -> DataFrame:
    pairs = {"returned": (F.col("returned"), F.expr(ORDER_SCORE_A))}
    return auc.auc(v_orders(spark, sf), pairs).withColumn("auc", F.round("auc", 6))


DOC_SCORES = {"H": "n_chars", "HS": "n_chars * (1 + has_digit)", "S": "n_chars % 97 + has_at", "N": "0 - n_chars"}


@query(
    "auc_ovr",
    sql_with("v_docs")
    + f", d AS (SELECT *, {SQL_CLASS} AS label_class FROM v_docs) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, round({_sql_auc('d', f"CAST(label_class = '{c}' AS INT)", s)}, 6) AS auc"""
        for c, s in DOC_SCORES.items()
    ),
)
def auc_ovr(spark: SparkSession, sf: str) -> DataFrame:
    df = labels.with_classes(v_docs(spark, sf), DOC_ROLES)
    pairs = auc.one_vs_rest(F.col(LABEL_CLASS), {c: F.expr(s) for c, s in DOC_SCORES.items()})
    return auc.auc(df, pairs).withColumn("auc", F.round("auc", 6))


@query(
    "auc_mean",
    sql_with("v_orders")
    + f"""SELECT round(({_sql_auc('v_orders', 'returned', ORDER_SCORE_A)} + {_sql_auc('v_orders', 'open', ORDER_SCORE_B)}) / 2, 6) AS mean_auc""",
)
def auc_mean(spark: SparkSession, sf: str) -> DataFrame:
    pairs = {
        "returned": (F.col("returned"), F.expr(ORDER_SCORE_A)),
        "open": (F.col("open"), F.expr(ORDER_SCORE_B)),
    }
    return auc.mean_auc(auc.auc(v_orders(spark, sf), pairs)).select(F.round("mean_auc", 6).alias("mean_auc"))
