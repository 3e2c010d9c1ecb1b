"""The two modelling tables the registered queries work on, built from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.roles import Roles
from foldsmith.scratch import attach

DOC_ROLES = Roles(
    key="doc_id",
    binary=("has_at", "has_digit", "is_long"),
    numeric=("n_chars",),
    categorical=("lang", "source"),
    labels=("quality", "toxic"),
)

ORDER_ROLES = Roles(
    key="o_orderkey",
    binary=("big_qty", "deep_discount", "high_tax", "first_line", "pricey"),
    numeric=("o_totalprice", "c_acctbal", "sum_qty", "n_lines", "max_discount", "avg_tax"),
    categorical=("o_orderstatus", "o_orderpriority", "c_mktsegment", "c_nation", "segment_known"),
    labels=("returned", "open"),
    ordinal_levels={"o_orderpriority": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")},
    penalties=(
        (("o_orderpriority", "c_mktsegment"), 0.80),
        (("c_mktsegment",), 0.90),
        (("o_orderpriority",), 0.90),
    ),
    discard=("o_orderpriority",),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def doc_features(spark: SparkSession, sf: str) -> DataFrame:
    def flag(c):
        return c.cast("double")

    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        flag(text.contains("@")).alias("has_at"),
        flag(text.rlike("[0-9]")).alias("has_digit"),
        flag(F.col("n_chars") > 1475).alias("is_long"),
        F.col("n_chars").cast("double").alias("n_chars"),
        "lang",
        "source",
    )


def doc_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels")


def v_docs(spark: SparkSession, sf: str) -> DataFrame:
    return doc_features(spark, sf).join(doc_labels(spark, sf), "doc_id")


def v_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customer and, where they have lines, facts about the lines.

    Lines aggregate per order before the join. The customer side is counted: small ones are
    broadcast, large ones joined on a salted key so a hot customer does not fill one task.
    """

    def any_of(cond):
        return F.max(F.when(cond, 1.0).otherwise(0.0))

    lines = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            any_of(F.col("l_quantity") > 45).alias("big_qty"),
            any_of(F.col("l_discount") > 0.08).alias("deep_discount"),
            any_of(F.col("l_tax") > 0.07).alias("high_tax"),
            any_of(F.col("l_linenumber") == 1).alias("first_line"),
            F.when(F.avg("l_extendedprice") > 53000, 1.0).otherwise(0.0).alias("pricey"),
            F.sum("l_quantity").alias("sum_qty"),
            F.count("*").cast("double").alias("n_lines"),
            F.max("l_discount").alias("max_discount"),
            F.avg("l_tax").alias("avg_tax"),
            any_of(F.col("l_returnflag") == "R").cast("int").alias("returned"),
            any_of(F.col("l_linestatus") == "O").cast("int").alias("open"),
        )
    )
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nation")
    )
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"
    )
    # Both sides of the lines join hold each order once, so its key cannot be hot.
    return (
        attach(orders.join(lines, "o_orderkey", "left"), customers, ["o_custkey"], "inner", ["o_orderkey"])
        .withColumn("segment_known", F.nullif("c_mktsegment", F.lit("MACHINERY")))
        .select(ORDER_ROLES.key, *ORDER_ROLES.inputs, *ORDER_ROLES.labels)
    )


SQL_DOC_FEATURES = """
  SELECT doc_id,
         CAST(contains(text, '@') AS DOUBLE) AS has_at,
         CAST(regexp_matches(text, '[0-9]') AS DOUBLE) AS has_digit,
         CAST(n_chars > 1475 AS DOUBLE) AS is_long,
         CAST(n_chars AS DOUBLE) AS n_chars, lang, source
  FROM documents
"""

SQL_V_DOCS = f"""
  SELECT f.*, l.quality, l.toxic FROM ({SQL_DOC_FEATURES}) f JOIN labels l ON f.doc_id = l.doc_id
"""

SQL_V_ORDERS = """
  SELECT o.o_orderkey, li.big_qty, li.deep_discount, li.high_tax, li.first_line, li.pricey,
         o.o_totalprice, c.c_acctbal, li.sum_qty, li.n_lines, li.max_discount, li.avg_tax,
         o.o_orderstatus, o.o_orderpriority, c.c_mktsegment,
         CAST(c.c_nationkey AS VARCHAR) AS c_nation,
         nullif(c.c_mktsegment, 'MACHINERY') AS segment_known,
         li.returned, li.open
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (
    SELECT l_orderkey,
           max(CASE WHEN l_quantity > 45 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS big_qty,
           max(CASE WHEN l_discount > 0.08 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS deep_discount,
           max(CASE WHEN l_tax > 0.07 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS high_tax,
           max(CASE WHEN l_linenumber = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS first_line,
           CASE WHEN avg(l_extendedprice) > 53000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pricey,
           sum(l_quantity) AS sum_qty,
           CAST(count(*) AS DOUBLE) AS n_lines,
           max(l_discount) AS max_discount,
           avg(l_tax) AS avg_tax,
           max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned,
           max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS open
    FROM lineitem GROUP BY l_orderkey
  ) li ON o.o_orderkey = li.l_orderkey
"""


def sql_with(*names: str) -> str:
    """``WITH`` clause defining the named views for an oracle query."""
    known = {"v_docs": SQL_V_DOCS, "v_orders": SQL_V_ORDERS, "doc_features": SQL_DOC_FEATURES}
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({known[n]})" for n in names) + " "
