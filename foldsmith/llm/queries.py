"""The operators as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.llm import (
    decontaminate,
    hardneg,
    lines,
    mixing,
    neardup,
    quality,
    secrets,
    sharding,
    substrings,
    toxicity,
    urls,
    vecdedup,
    whitening,
)
from foldsmith.llm.catalog import query, table
from foldsmith.scratch import fresh_path


@query("op1_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op8_quality_rules",
    r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM docs),
pos AS (SELECT r, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, i FROM (
  SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM pos) WHERE n > 1),
reps AS (SELECT r, count(*) AS n FROM (
  SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY r),
lines AS (
  SELECT r, x, len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n
  FROM (SELECT r, unnest(l) AS x FROM words)),
judged AS (
  SELECT r, n, len(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) > 0.3 * n
    OR NOT regexp_matches(x, '[.!?…。！？]')
    OR (len(regexp_replace(x, '[^|>»·•]', '', 'g')) >= 3 AND len(regexp_replace(x, '[^|>»·•]', '', 'g')) * 4 >= n)
    OR regexp_matches(lower(x), 'all rights reserved|licensed under|released under the|privacy policy|terms of service|terms of use|cookie policy|accept cookies|click here|sign up for|subscribe to our|enable javascript|skip to content') AS bad
  FROM lines),
lost AS (SELECT r, sum(CASE WHEN bad THEN n ELSE 0 END) AS n_lost FROM judged GROUP BY r),
counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(reps.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_lost, 0) AS BIGINT) AS n_lost
  FROM words LEFT JOIN reps USING (r) LEFT JOIN lost USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_lost <= 50 * n_words AS kept
FROM counted
""",
)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.measure(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost", "base_failed", "kept"]
    return found.select("row.doc_id", *[f"quality.{f}" for f in fields])


@query(
    "op5_substring_dedup",
    r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
starts AS (
  SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM starts) WHERE n > 1),
gone AS (SELECT r, list(DISTINCT j) AS js FROM (SELECT r, unnest(range(i, i + 35)) AS j FROM again) GROUP BY r),
words AS (SELECT r, i, w[i] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs)),
removed AS (SELECT DISTINCT r, unnest(js) AS i FROM gone),
kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n
  FROM words ANTI JOIN removed USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
""",
)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def _counter(order: int):
    return lambda n, s: n + (s["order"] == order).cast("long")


@query("op6_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["order"] < len(secrets.BASE))
    counts = [
        F.aggregate("found", F.lit(0).cast("long"), _counter(i)).alias(f"n_{rule.kind}")
        for i, rule in enumerate(secrets.BASE)
    ]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("found")).alias("spans")
    )


@query(
    "op2_source_mix",
    r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) AS h
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM docs GROUP BY source),
weighted AS (SELECT *, CASE place % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS w FROM sources),
ordered AS (SELECT *, row_number() OVER (ORDER BY 2.0 * s / w, place) AS o FROM weighted),
levels AS (
  SELECT o, (SELECT 1.5 * sum(s) FROM ordered) - coalesce(sum(2 * s) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
    sum(w) OVER (ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left, s, w
  FROM ordered),
cut AS (SELECT min(o) AS o FROM levels WHERE 2 * s * w_left > left_over * w),
level AS (SELECT levels.left_over, levels.w_left, o FROM levels JOIN cut USING (o)),
targets AS (
  SELECT a.source, a.s, CASE WHEN a.o < coalesce(l.o, 1e9) THEN 2.0 * a.s ELSE CAST(l.left_over AS DOUBLE) * a.w / l.w_left END AS target
  FROM ordered a LEFT JOIN level l ON true),
plans AS (
  SELECT source, s, target, CASE WHEN s = 0 THEN 0 ELSE CAST(floor(target / s) AS BIGINT) END AS whole FROM targets),
filled AS (
  SELECT d.*, p.s, p.target, p.whole, p.target - p.whole * p.s AS need,
    sum(size) OVER (PARTITION BY d.source ORDER BY h, r) AS through
  FROM docs d JOIN plans p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, s AS source_size, target,
  CAST(size * (whole + CASE WHEN through <= need OR (need >= through - size AND 2 * (need - (through - size)) >= size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM filled
""",
)
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op3_shards")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = sharding.shard(table(spark, sf_dir, "documents"), 40, fresh_path(spark, "shards"))
    return stored.select(
        "doc_id",
        sharding.size_of("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op4_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_line_chunk_dedup")
def line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_chunks", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op10_url_filter",
    r"""
WITH split AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT r, h || p AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY len(h || p) DESC) AS n
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN (SELECT * FROM fits WHERE n = 1) USING (r)
""",
)
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(urls.RULES), "verdict string, host string, path string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


@query("op7_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query(
    "op11_hard_negatives",
    r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT a, b, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (
  SELECT p.a, p.b AS p, p.score AS ps, s.b, s.score,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, p AS positive_id, CAST(rank AS INTEGER) AS rank, b AS negative_id, ps AS positive_score,
  score AS negative_score
FROM n WHERE rank <= 3
""",
)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


@query("op12_vector_near_dedup")
def vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op13_whitening")
def whitening_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
