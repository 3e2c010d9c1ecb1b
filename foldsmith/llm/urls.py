"""URL rules by hashed expressions: host suffixes with path prefixes, short hash prefixes first, then full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsmith.llm.tables import spread_join
from foldsmith.scratch import BROADCAST_CELLS, materialise

PREFIX_DIGITS = 8  # 32 bits of the SHA-256 digest in hex
OTHERWISE = "allow"
# Verdicts are broadcast up to this many bytes, a digest and a verdict taking PLACE_BYTES.
BROADCAST_BYTES, PLACE_BYTES = 2 << 20, 64
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _place() -> Column:
    """A 128-bit digest of host and path."""
    return F.md5(F.concat("host", F.lit("\n"), "path"))


def _expressions(host: Column, path: Column, lengths: list[tuple[int, int]]) -> Column:
    """The (host suffix, path prefix) pairs of the rules' lengths that a host and path have."""
    pairs = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p in lengths])
    fits = lambda x: (
        (F.length(host) >= x["h"])
        & (F.length(path) >= x["p"])
        & ((F.length(host) == x["h"]) | (F.substring(host, F.length(host) - x["h"], F.lit(1)) == "."))
    )
    cut = lambda x: F.struct(
        F.substring(host, F.length(host) - x["h"] + 1, x["h"]).alias("host"), F.substring(path, F.lit(1), x["p"]).alias("path")
    )
    return F.transform(F.filter(pairs, fits), cut)


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", otherwise: str = OTHERWISE) -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, verdict.

    ``rules`` has verdict, host and path; a rule fits its host and all subdomains if the path starts with the
    rule's. Of the fitting rules the longest (host and path together) wins, then the longer host, then block. Each
    distinct host and path is expanded into the suffixes and prefixes of the lengths that rules have; these meet the
    rules by the first 32 bits of their digests, and the full digest confirms. Without a rule, or without ``://``,
    ``rule`` is null and the verdict is ``otherwise``.

    Null urls have an empty host and path, very long ones are compared like any other; an empty table gives no rows. A
    host and path that very many rows share are dealt over several tasks. Repeated rows come back as often as given. Rules with a null in any column
    are ignored, repeated ones count once. Other columns of ``pages`` are not read. Only the distinct pairs of lengths
    reach the driver.
    """
    known = rules.select("verdict", F.lower("host").alias("host"), "path").dropna().distinct()
    digest = _digest(F.col("host"), F.col("path"))
    known = known.select(
        "verdict",
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_length"),
        F.length("path").alias("path_length"),
        digest.alias("digest"),
        F.substring(digest, 1, PREFIX_DIGITS).alias("prefix"),
    )
    known = materialise(known, "url-rules")
    lengths = [tuple(r) for r in known.select("host_length", "path_length").distinct().orderBy("host_length", "path_length").collect()]
    split = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not lengths:
        return split.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))

    # What was found for a host and path comes back by their digest, however long they are.
    distinct = split.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("place", _place())
    expanded = distinct.select("place", "n", F.explode(_expressions(F.col("host"), F.col("path"), lengths)).alias("x"))
    hashed = expanded.select("place", "n", _digest(F.col("x.host"), F.col("x.path")).alias("full"))
    hashed = hashed.withColumn("prefix", F.substring("full", 1, PREFIX_DIGITS))
    few = known.count() * len(known.columns) <= BROADCAST_CELLS
    met = hashed.join(F.broadcast(known) if few else known, "prefix").filter("full = digest")
    rank = F.struct(
        (F.col("host_length") + F.col("path_length")).alias("length"), "host_length", (F.col("verdict") == "block").alias("block"), "rule", "verdict"
    )
    best = met.groupBy("place", "n").agg(F.max(rank).alias("best"))
    best = materialise(best.select("place", "n", "best.rule", "best.verdict"), "url-verdicts")
    placed = split.withColumn("place", _place()).withColumn("turn", F.xxhash64(key))
    size = best.agg(F.coalesce(F.sum(F.octet_length("rule") + PLACE_BYTES), F.lit(0))).first()[0]
    out = placed.join(F.broadcast(best), "place", "left") if size <= BROADCAST_BYTES else spread_join(placed, best, ["place"], ["turn"])
    return out.select(key, "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
