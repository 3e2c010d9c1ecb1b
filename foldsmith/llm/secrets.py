"""Secret scans over a trigram inverted index. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsmith.llm.trigrams import clauses
from foldsmith.llm.tables import look_up
from foldsmith.scratch import materialise


@dataclass(frozen=True)
class Rule:
    """``pattern`` without look-around; a match counts if its ``group`` (0: all) has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The first three are the base rules. For the third, runs of 16 and more are what is left of all runs.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
RULES = (
    *BASE,
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay_key", r"sk_live_[0-9A-Za-z]{24,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)


def _queries(rules: tuple[Rule, ...]) -> list[tuple[int, int, int, str]]:
    """(rule, clause, alternative, trigram) rows of the Boolean queries."""
    return [
        (r, c, a, t)
        for r, rule in enumerate(rules)
        for c, clause in enumerate(clauses(rule.pattern))
        for a, grams in enumerate(clause)
        for t in sorted(grams)
    ]


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The inverted index (trigram, node) over the trigrams that some query asks for."""
    # One compiled test per trigram on a text that is lower-cased once.
    lowered = docs.select("node", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in vocabulary]))
    return lowered.select("node", F.explode(present).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(node, rules): a bit for each rule whose trigram query the document meets."""
    spark = docs.sparkSession
    rows = _queries(rules)
    asked = spark.createDataFrame(rows, "rule int, clause int, alternative int, trigram string")
    index = materialise(postings(docs, sorted({r[3] for r in rows})), "trigram-index")
    needed = asked.groupBy("rule", "clause", "alternative").agg(F.count("*").alias("needed"))
    # One row for each trigram of each rule: sized by the rules.
    hits = index.distinct().join(F.broadcast(asked), "trigram").groupBy("node", "rule", "clause", "alternative").agg(F.count("*").alias("n"))
    met = hits.join(F.broadcast(needed), ["rule", "clause", "alternative"]).filter("n = needed")
    parts = asked.groupBy("rule").agg(F.countDistinct("clause").alias("parts"))
    full = met.groupBy("node", "rule").agg(F.countDistinct("clause").alias("n")).join(F.broadcast(parts), "rule")
    full = full.filter("n = parts")
    return full.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of the leftmost, non-overlapping matches that count, in code points.

    Ends are running sums. n matches are summed in sqrt(n) runs of sqrt(n) matches, so that growing arrays stay short.
    """
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    matched = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    long_enough = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least
    step = lambda m, gap: F.struct(gap.alias("gap"), F.length(m).alias("length"), long_enough(m).alias("counts"))
    # The text after the last match follows no match and is left out.
    steps = F.filter(F.zip_with(matched, between, step), lambda x: x["length"].isNotNull())
    return _named(steps, lambda found: _in_runs(found, order))


def _in_runs(steps: Column, order: int) -> Column:
    width = F.greatest(F.ceil(F.sqrt(F.size(steps))), F.lit(1)).cast("int")
    runs = F.transform(
        F.filter(F.sequence(F.lit(0), width), lambda k: k * width < F.size(steps)),
        lambda k: F.slice(steps, k * width + 1, width),
    )
    return F.flatten(_named(runs, lambda r: F.zip_with(r, _run_starts(r), lambda run, at: _run_spans(run, at, order))))


def _run_starts(runs: Column) -> Column:
    """Place of each run in the text: the lengths of all earlier ones."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    total = lambda run: F.aggregate(run, F.lit(0), lambda s, x: s + x["gap"] + x["length"])
    step = lambda s, run: F.struct(
        (s["at"] + total(run)).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")
    )
    return F.aggregate(runs, empty, step, lambda s: s["starts"])


def _run_spans(run: Column, at: Column, order: int) -> Column:
    kind = "array<struct<start:int,order:int,end:int>>"
    span = lambda s, x: F.struct(
        (s["at"] + x["gap"]).alias("start"), F.lit(order).alias("order"), (s["at"] + x["gap"] + x["length"]).alias("end")
    )
    return F.aggregate(
        run,
        F.struct(at.alias("at"), F.array().cast(kind).alias("spans")),
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + x["length"]).alias("at"),
            F.when(x["counts"], F.concat(s["spans"], F.array(span(s, x)))).otherwise(s["spans"]).cast(kind).alias("spans"),
        ),
        lambda s: s["spans"],
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: key and ``found``, the array of (start, order, end) sorted by start, then rule.

    ``order`` is the rule's place in ``rules``; starts and ends count code points, ends are exclusive. Matches
    are leftmost and non-overlapping within a rule. A rule's trigram query picks documents from the index, and
    only they are searched with its pattern; a rule without mandatory trigrams searches every document.

    A null text is empty. Repeated rows come back as often as given, rows with one key share its postings, and
    rows with a null key, which postings cannot name, are searched with every rule. Other columns are not read. An empty table gives no rows; a
    very long text is searched as a whole.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.col(key).alias("node"), body.alias("text"))
    picked = materialise(candidates(texts.filter("node is not null"), rules), "candidates")
    known = look_up(texts, picked, ["node"])
    indexed = {r for r, *_ in _queries(rules)}
    none = F.array().cast("array<struct<start:int,order:int,end:int>>")
    found = []
    for i, rule in enumerate(rules):
        if i in indexed:
            wanted = F.col("node").isNull() | (F.coalesce("rules", F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0)
        else:
            wanted = F.lit(True)
        found.append(F.when(wanted & F.col("text").rlike(rule.pattern), _spans(F.col("text"), rule, i)).otherwise(none))
    return known.select(F.col("node").alias(key), F.array_sort(F.concat(*found)).alias("found"))


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
