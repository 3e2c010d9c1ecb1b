"""Queries on rows: sources, labels, splits, combinations, encodings, columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.catalog.registry import query
from foldsmith.catalog.views import (
    DOC_ROLES,
    ORDER_ROLES,
    doc_features,
    doc_labels,
    sql_with,
    table,
    v_docs,
    v_orders,
)
from foldsmith.functions.names import TRIPLE_FORMS
from foldsmith.operators import columns, combine, encode, labels, splits
from foldsmith.roles import LABEL_ANY, LABEL_CLASS
from foldsmith.scratch import fresh_path
from foldsmith.sources import tables

KEY = ORDER_ROLES.key
FLAGS = ORDER_ROLES.binary

SQL_CLASS = """CASE WHEN quality = 1 AND toxic = 1 THEN 'HS' WHEN quality = 1 AND toxic = 0 THEN 'H'
               WHEN quality = 0 AND toxic = 1 THEN 'S' ELSE 'N' END"""
SQL_ORDER_CLASS = SQL_CLASS.replace("quality", "returned").replace("toxic", "open")


def sql_hash32(*parts: str) -> str:
    text = " || '|' || ".join(parts)
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


# --- sources -------------------------------------------------------------------------------


@query(
    "join_features_labels",
    """SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
       FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def join_features_labels(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return tables.join_labels(docs, doc_labels(spark, sf), "doc_id")


@query(
    "rows_to_score",
    sql_with("doc_features")
    + "SELECT f.* FROM doc_features f WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id)",
)
def rows_to_score(spark: SparkSession, sf: str) -> DataFrame:
    return tables.rows_without_label(doc_features(spark, sf), doc_labels(spark, sf), "doc_id")


@query("csv_sink_roundtrip", sql_with("v_docs") + "SELECT doc_id, has_at AS score_a, is_long AS score_b FROM v_docs")
def csv_sink_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "scores")
    scored = v_docs(spark, sf).withColumns({"score_a": F.col("has_at"), "score_b": F.col("is_long")})
    tables.write_scores(scored, path, "doc_id", ["score_a", "score_b"])
    return spark.read.schema("doc_id bigint, score_a double, score_b double").option("header", True).csv(path)


@query(
    "csv_source",
    sql_with("v_docs")
    + """SELECT doc_id, has_at, has_digit, is_long, n_chars, lang, source, quality, toxic FROM v_docs""",
)
def csv_source(spark: SparkSession, sf: str) -> DataFrame:
    """Features and labels written as CSV files, read back under their role schemas and joined."""
    features, marks = fresh_path(spark, "features"), fresh_path(spark, "labels")
    roles = DOC_ROLES
    doc_features(spark, sf).select(roles.key, *roles.inputs).write.option("header", True).csv(features)
    doc_labels(spark, sf).select(roles.key, *roles.labels).write.option("header", True).csv(marks)
    return tables.join_labels(
        tables.read_features(spark, features, roles), tables.read_labels(spark, marks, roles), roles.key
    )


@query(
    "label_ratio",
    """SELECT CAST(count(*) AS BIGINT) AS n_rows, round(sum(quality)::DOUBLE / nullif(count(*), 0), 6) AS quality_ratio,
              round(sum(toxic)::DOUBLE / nullif(count(*), 0), 6) AS toxic_ratio, CAST(6 AS BIGINT) AS n_features
       FROM labels""",
)
def label_ratio(spark: SparkSession, sf: str) -> DataFrame:
    out = labels.label_summary(doc_labels(spark, sf), DOC_ROLES, len(DOC_ROLES.inputs))
    return out.withColumns({c: F.round(c, 6) for c in ("quality_ratio", "toxic_ratio")})


# --- labels --------------------------------------------------------------------------------


@query("label_powerset", sql_with("v_docs") + f"SELECT doc_id, quality, toxic, {SQL_CLASS} AS label_class FROM v_docs")
def label_powerset(spark: SparkSession, sf: str) -> DataFrame:
    return labels.with_classes(v_docs(spark, sf), DOC_ROLES).select("doc_id", "quality", "toxic", LABEL_CLASS)


@query(
    "label_any",
    sql_with("v_orders")
    + f"SELECT o_orderkey, CASE WHEN {SQL_ORDER_CLASS} = 'N' THEN 'N' ELSE 'Y' END AS label_any FROM v_orders",
)
def label_any(spark: SparkSession, sf: str) -> DataFrame:
    """On orders, whose labels may be null: those count as neither."""
    out = labels.with_classes(v_orders(spark, sf), ORDER_ROLES, keep_labels=False)
    return out.select(KEY, LABEL_ANY)


@query("positive_cohort", sql_with("v_docs") + "SELECT doc_id, lang, quality, toxic FROM v_docs WHERE quality > 0 OR toxic > 0")
def positive_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return labels.positive_cohort(v_docs(spark, sf), DOC_ROLES).select("doc_id", "lang", "quality", "toxic")


@query(
    "class_onehot",
    sql_with("v_docs")
    + "SELECT doc_id, "
    + ", ".join(
        f"CAST({SQL_CLASS} = '{c}' AS INT) AS \"{c}\", 1 - CAST({SQL_CLASS} = '{c}' AS INT) AS \"no_{c}\""
        for c in ("H", "HS", "N", "S")
    )
    + " FROM v_docs",
)
def class_onehot(spark: SparkSession, sf: str) -> DataFrame:
    df = labels.with_classes(v_docs(spark, sf), DOC_ROLES).select("doc_id", LABEL_CLASS)
    return labels.class_onehot(df, LABEL_CLASS, ("H", "HS", "N", "S")).drop(LABEL_CLASS)


@query(
    "class_weights",
    sql_with("v_docs")
    + f"""SELECT label_class, n, round(sum(n) OVER ()::DOUBLE / (count(*) OVER () * n), 6) AS weight
          FROM (SELECT {SQL_CLASS} AS label_class, count(*) AS n FROM v_docs GROUP BY 1)""",
)
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    df = labels.with_classes(v_docs(spark, sf), DOC_ROLES)
    return labels.class_weights(df, LABEL_CLASS).withColumn("weight", F.round("weight", 6))


# --- splits --------------------------------------------------------------------------------


@query(
    "sample_debug",
    f"SELECT o_orderkey, o_totalprice FROM orders WHERE {sql_hash32(chr(39) + '1' + chr(39), 'o_orderkey::VARCHAR')} % 1000000 < 100000",
)
def sample_debug(spark: SparkSession, sf: str) -> DataFrame:
    return splits.sample(table(spark, sf, "orders"), KEY).select(KEY, "o_totalprice")


@query(
    "split_holdout",
    f"""SELECT o_orderkey, CASE WHEN {sql_hash32("'100'", "o_orderkey::VARCHAR")} % 1000000 < 200000
               THEN 'holdout' ELSE 'train' END AS split FROM orders""",
)
def split_holdout(spark: SparkSession, sf: str) -> DataFrame:
    return splits.holdout(table(spark, sf, "orders").select(KEY), KEY)


@query(
    "folds_repeated",
    "SELECT o_orderkey, "
    + ", ".join(f"""CAST({sql_hash32("'100'", f"'{r}'", "o_orderkey::VARCHAR")} % 5 AS INT) AS fold_{r}""" for r in range(5))
    + " FROM orders",
)
def folds_repeated(spark: SparkSession, sf: str) -> DataFrame:
    return splits.folds(table(spark, sf, "orders").select(KEY), KEY)


@query(
    "probe_columns",
    "SELECT o_orderkey, "
    + ", ".join(
        f"""round(({sql_hash32("'1'", f"'{i}'", "o_orderkey::VARCHAR")} + 0.5::DOUBLE) / 4294967296.0::DOUBLE, 6) AS rand{i}"""
        for i in range(1, 11)
    )
    + " FROM orders",
)
def probe_columns(spark: SparkSession, sf: str) -> DataFrame:
    df = splits.probes(table(spark, sf, "orders").select(KEY), KEY)
    return df.withColumns({p: F.round(p, 6) for p in splits.probe_names()})


# --- combinations --------------------------------------------------------------------------


def _sql_combo(columns_sql: list[tuple[str, str]]) -> str:
    parts = []
    for name, e in columns_sql:
        parts.append(f'{e} AS "{name}"')
        parts.append(f'CASE WHEN {e} > 1 THEN 1.0::DOUBLE ELSE {e} END AS "{name}_comb"')
    return sql_with("v_orders") + "SELECT o_orderkey, " + ", ".join(parts) + " FROM v_orders"


SQL_TRIPLES = {
    "or": ("{a}_or_{b}_or_{c}", "({a} + {b} + {c})"),
    "and_or": ("{a}_and_{b}_or_{c}", "({a} * {b} + {c})"),
    "ornot": ("{a}_or_not{b}_or_{c}", "({a} + (1 - {b}) + {c})"),
    "ornot_ornot": ("{a}_or_not{b}_or_not{c}", "({a} + (1 - {b}) + (1 - {c}))"),
    "andnot_or": ("{a}_and_not{b}_or_{c}", "({a} * (1 - {b}) + {c})"),
    "and_ornot": ("{a}_and_{b}_or_not{c}", "({a} * {b} + (1 - {c}))"),
}


def sql_pair_columns() -> list[tuple[str, str]]:
    return [(f"{a}_or_{b}", f"({a} + {b})") for a, b in combinations(FLAGS, 2)]


def sql_triple_columns(form: str) -> list[tuple[str, str]]:
    name, e = SQL_TRIPLES[form]
    return [(name.format(a=a, b=b, c=c), e.format(a=a, b=b, c=c)) for a, b, c in combinations(FLAGS, 3)]


def sql_all_combinations() -> list[tuple[str, str]]:
    return sql_pair_columns() + [x for f in SQL_TRIPLES for x in sql_triple_columns(f)]


@query("combine_pairs", _sql_combo(sql_pair_columns()))
def combine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    cols = combine.pair_columns(FLAGS)
    return v_orders(spark, sf).withColumns(cols).select(KEY, *cols)


def _register_triples(form) -> None:
    @query(f"combine_{form.name}", _sql_combo(sql_triple_columns(form.name)))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        cols = combine.triple_columns(FLAGS, form)
        return v_orders(spark, sf).withColumns(cols).select(KEY, *cols)


for _form in TRIPLE_FORMS:
    _register_triples(_form)


def _sql_summary(cols: list[tuple[str, str]], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS name, count({e}) AS n, round(sum({e}), 3) AS total FROM {source}" for n, e in cols
    )


@query(
    "combine_array",
    sql_with("v_orders")
    + _sql_summary(
        [
            x
            for n, e in sql_all_combinations()
            for x in ((n, e), (f"{n}_comb", f"(CASE WHEN {e} > 1 THEN 1.0::DOUBLE ELSE {e} END)"))
        ],
        "v_orders",
    ),
)
def combine_array(spark: SparkSession, sf: str) -> DataFrame:
    """Every combination through the array layout: how often it is known, and its sum."""
    names = [n for n, _ in combine.combination_names(FLAGS)]
    long = v_orders(spark, sf).select(F.posexplode(combine.combination_array(FLAGS)).alias("pos", "value"))
    per = long.groupBy("pos").agg(F.count("value").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return per.select(F.get(F.array(*[F.lit(n) for n in names]), "pos").alias("name"), "n", "total")


# --- encodings -----------------------------------------------------------------------------


@query(
    "encode_ordinal",
    sql_with("v_orders")
    + """SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0::DOUBLE WHEN '2-HIGH' THEN 2.0::DOUBLE
                WHEN '3-MEDIUM' THEN 3.0::DOUBLE WHEN '4-NOT SPECIFIED' THEN 4.0::DOUBLE WHEN '5-LOW' THEN 5.0::DOUBLE
                ELSE -1.0::DOUBLE END AS o_orderpriority_t,
                CASE segment_known WHEN 'BUILDING' THEN 1.0::DOUBLE WHEN 'FURNITURE' THEN 2.0::DOUBLE ELSE -1.0::DOUBLE END AS segment_known_t
         FROM v_orders""",
)
def encode_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    roles = ORDER_ROLES.with_(
        ordinal_levels={**ORDER_ROLES.ordinal_levels, "segment_known": ("BUILDING", "FURNITURE")}
    )
    cols = encode.ordinal_columns(roles)
    return v_orders(spark, sf).withColumns(cols).select(KEY, "o_orderpriority", *cols)


LOGGED = ("o_totalprice", "sum_qty", "n_lines", "max_discount", "avg_tax")


@query(
    "log_shift",
    sql_with("v_orders")
    + "SELECT o_orderkey, "
    + ", ".join(f"round(ln({c} + 2), 6) AS {c}_log_t" for c in LOGGED)
    + " FROM v_orders",
)
def log_shift(spark: SparkSession, sf: str) -> DataFrame:
    cols = {n: F.round(e, 6) for n, e in encode.log_columns(list(LOGGED)).items()}
    return v_orders(spark, sf).withColumns(cols).select(KEY, *cols)


INDEXED = ORDER_ROLES.categorical


def _sql_index(c: str) -> str:
    return f"""(SELECT {c}, dense_rank() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS k
                FROM (SELECT DISTINCT {c} FROM v_orders WHERE {c} IS NOT NULL))"""


@query(
    "index_categories",
    sql_with("v_orders")
    + "SELECT v.o_orderkey, "
    + ", ".join(
        f"CAST(coalesce(t{i}.i, (SELECT count(DISTINCT {c}) FROM v_orders)) AS DOUBLE) AS {c}_idx"
        for i, c in enumerate(INDEXED)
    )
    + " FROM v_orders v "
    + " ".join(f"LEFT JOIN {_sql_index(c)} t{i} ON v.{c} = t{i}.{c}" for i, c in enumerate(INDEXED)),
)
def index_categories(spark: SparkSession, sf: str) -> DataFrame:
    df = v_orders(spark, sf).select(KEY, *INDEXED)
    index = encode.fit_index(df, list(INDEXED))
    return encode.with_index(df, index, list(INDEXED), [KEY]).select(KEY, *[encode.index_name(c) for c in INDEXED])


# --- columns -------------------------------------------------------------------------------

COUNTED = (*ORDER_ROLES.binary, *ORDER_ROLES.numeric, *ORDER_ROLES.categorical)


@query(
    "null_counts",
    sql_with("v_orders")
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM v_orders" for c in COUNTED
    ),
)
def null_counts(spark: SparkSession, sf: str) -> DataFrame:
    return columns.null_counts(v_orders(spark, sf), list(COUNTED))


@query(
    "complete_pairs",
    sql_with("v_orders")
    + "SELECT a.c AS first, b.c AS second FROM ("
    + " UNION ALL ".join(
        f"SELECT {i} AS p, '{c}' AS c, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM v_orders"
        for i, c in enumerate(ORDER_ROLES.categorical)
    )
    + ") a, ("
    + " UNION ALL ".join(
        f"SELECT {i} AS p, '{c}' AS c, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM v_orders"
        for i, c in enumerate(ORDER_ROLES.categorical)
    )
    + ") b WHERE a.p < b.p AND a.nulls = 0 AND b.nulls = 0",
)
def complete_pairs(spark: SparkSession, sf: str) -> DataFrame:
    counted = columns.null_counts(v_orders(spark, sf), list(ORDER_ROLES.categorical))
    # One row per column: the pairs come out of a single short array.
    at = F.array_position(F.array(*[F.lit(c) for c in ORDER_ROLES.categorical]), F.col("column"))
    whole = counted.filter("nulls = 0").select(F.struct(at.alias("p"), F.col("column").alias("c")).alias("s"))
    names = whole.agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["c"]).alias("names"))
    first = names.select(F.posexplode("names").alias("p", "first"), "names")
    rest = F.slice("names", F.col("p") + 2, F.size("names"))
    return first.select("first", F.explode(rest).alias("second"))


@query(
    "align_columns",
    sql_with("doc_features", "v_docs")
    + """SELECT 'labelled' AS part, doc_id, has_at, has_digit, is_long, lang, n_chars, source FROM v_docs
         UNION ALL
         SELECT 'score', doc_id, has_at, has_digit, is_long, lang, n_chars, source FROM doc_features f
         WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id)""",
)
def align_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled and unlabelled rows on their common columns: the labels fall away."""
    known = labels.with_classes(v_docs(spark, sf), DOC_ROLES)
    fresh = tables.rows_without_label(doc_features(spark, sf), doc_labels(spark, sf), "doc_id")
    a, b = columns.align(known, fresh)
    return a.withColumn("part", F.lit("labelled")).unionByName(b.withColumn("part", F.lit("score")))


@query("drop_unused", sql_with("v_docs") + "SELECT doc_id, has_at, has_digit, is_long, n_chars, quality, toxic FROM v_docs")
def drop_unused(spark: SparkSession, sf: str) -> DataFrame:
    return columns.drop_unused(v_docs(spark, sf), ["lang", "source", "not_there"])


@query(
    "select_by_type",
    sql_with("v_docs")
    + """SELECT doc_id, has_at, has_digit, is_long, n_chars, quality, toxic FROM v_docs""",
)
def select_by_type(spark: SparkSession, sf: str) -> DataFrame:
    df = v_docs(spark, sf)
    return df.select(*columns.numeric_columns(df))


@query(
    "compose_scores",
    sql_with("v_orders")
    + """SELECT o_orderkey, round(q * (h + hs) / (h + hs + s), 6) AS score_a, round(q * (s + hs) / (h + hs + s), 6) AS score_b
         FROM (SELECT o_orderkey, max_discount * 5 + 0.1 AS q, avg_tax + 0.01 AS h, o_totalprice / 500000 AS hs, n_lines / 10 AS s
               FROM v_orders)""",
)
def compose_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Probabilities made of columns, composed into the two label scores by class name."""
    from foldsmith.operators.models import compose

    h, hs, s = F.col("avg_tax") + 0.01, F.col("o_totalprice") / 500000, F.col("n_lines") / 10
    total = h + hs + s
    a, b = compose(F.col("max_discount") * 5 + 0.1, {"H": h / total, "HS": hs / total, "S": s / total})
    return v_orders(spark, sf).select(KEY, F.round(a, 6).alias("score_a"), F.round(b, 6).alias("score_b"))
