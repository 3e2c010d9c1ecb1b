"""Line-first cleaning: rules per line, then a verdict on what is left. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words in repeated three-word windows
MAX_LOST = 50  # percent of the words on lines that failed
SYMBOLS_PER_WORD = 0.3
LINKS_PER_LINE, WORDS_PER_LINK = 3, 4
# Sentence marks, menu separators, and phrases of notices.
SENTENCE_MARK = r"[.!?…。！？]"
MENU_MARK = r"[|>»·•]"
NOTICES = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "privacy policy",
    "terms of service",
    "terms of use",
    "cookie policy",
    "accept cookies",
    "click here",
    "sign up for",
    "subscribe to our",
    "enable javascript",
    "skip to content",
)


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _count(text: Column, marks: str) -> Column:
    return F.size(F.split(text, marks, -1)) - 1


def line_failed(line: Column, words: Column) -> Column:
    """True for a line with ``words`` words (at least one) that fails a rule.

    Punctuation: symbols at more than 0.3 per word, or no sentence mark at all. Navigation: three or more
    menu separators, at least one per four words. Boilerplate: a phrase of a notice.
    """
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    menu = _count(line, MENU_MARK)
    return (
        (symbols > SYMBOLS_PER_WORD * words)
        | ~line.rlike(SENTENCE_MARK)
        | ((menu >= LINKS_PER_LINE) & (menu * WORDS_PER_LINK >= words))
        | F.lower(line).rlike("|".join(NOTICES))
    )


def _repeated(sorted_windows: Column) -> Column:
    """Sorted start positions of the windows that occur twice, from the sorted (hash, position) windows."""
    again = F.filter(
        sorted_windows,
        lambda w, i: (F.get(sorted_windows, i - 1)["h"] == w["h"]) | (F.get(sorted_windows, i + 1)["h"] == w["h"]),
    )
    return F.sort_array(F.transform(again, lambda w: w["i"]))


def _covered(at: Column) -> Column:
    """Words inside three-word windows that start at the sorted positions."""
    following = F.slice(at, 2, F.greatest(F.size(at), F.lit(1)))
    steps = F.zip_with(at, following, lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` with the columns of ``docs``, ``quality`` with counts and verdicts, ``cleaned`` with the text left.

    Fields of ``quality``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost (words on failed
    lines), kept. ``cleaned`` is the text without failed lines; blank lines stay. A null text counts as empty,
    has no words and fails; so does a table's every empty text, while an empty table gives no rows. Repeated rows come back
    as often as given. A column of ``docs`` may have any name, since all are kept inside ``row``. Everything of a row is
    worked out from that row, however long its text; nothing is shuffled.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.split("_body", "\n", -1)
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), body.alias("_body"))
    out = out.withColumn("_words", word_array(F.col("_body")))
    n = F.greatest(F.size("_words") - 2, F.lit(0))
    windows = F.transform(
        F.arrays_zip(*[F.slice("_words", F.lit(k), n) for k in (1, 2, 3)]),
        lambda w: F.xxhash64(w),
    )
    out = out.withColumn(
        "_windows", F.when(F.size("_words") < 4, F.array().cast("array<bigint>")).otherwise(windows)
    )
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn("_sorted", F.when(some, F.sort_array(placed)).otherwise(F.slice(placed, 1, 0)))
    line = F.transform(lines, lambda x: F.struct(x.alias("line"), F.size(word_array(x)).alias("words")))
    out = out.withColumn("_lines", line).withColumn("_at", _repeated(F.col("_sorted")))
    # Each line is judged once; blank lines, which have no words, never fail.
    bad = lambda x: (x["words"] > 0) & line_failed(x["line"], x["words"])
    judged = lambda x: F.struct(x["line"].alias("line"), x["words"].alias("words"), bad(x).alias("bad"))
    out = out.withColumn("_judged", F.transform("_lines", judged))
    out = out.withColumn("_plain", F.transform(F.filter("_lines", lambda x: x["words"] > 0), lambda x: x["line"]))
    lost = F.aggregate("_judged", F.lit(0), lambda s, x: s + F.when(x["bad"], x["words"]).otherwise(0))
    cleaned = F.array_join(F.transform(F.filter("_judged", lambda x: ~x["bad"]), lambda x: x["line"]), "\n")
    counts = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_body", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("_body") - F.length(F.translate("_body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_plain") - F.size(F.array_distinct("_plain"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_at")).cast("long").alias("n_repeat_words"),
        lost.cast("long").alias("n_lost"),
        # Not deterministic to the optimizer, so that no filter on a verdict is pushed into the expressions above,
        # where it would be worked out anew for every word.
        F.spark_partition_id().alias("part"),
    )
    out = out.select("row", counts.alias("_counts"), cleaned.alias("cleaned"))
    q = F.col("_counts")
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEATED * q["n_words"])
    kept = ~failed & (100 * q["n_lost"] <= MAX_LOST * q["n_words"])
    fields = [q[f].alias(f) for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost")]
    return out.select("row", F.struct(*fields, failed.alias("base_failed"), kept.alias("kept")).alias("quality"), "cleaned")


def clean(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """Documents that pass, without their failed lines, in the columns of ``docs``; ``n_chars`` follows the text."""
    found = measure(docs, text)
    new = {text: F.col("cleaned")}
    if n_chars in docs.columns:
        new[n_chars] = F.length("cleaned").cast(docs.schema[n_chars].dataType)
    columns = [new.get(c, F.col("row")[c]).alias(c) for c in docs.columns]
    return found.filter("quality.kept").select(columns)
