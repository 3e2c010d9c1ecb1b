"""Passages that repeat across documents: winnowed phrases and window look-ups, in place of a relative Lempel-Ziv parse.

The corpus is its own reference. It is cut into phrases at content-defined anchors: every window of
``window`` words picks the least of its word 10-grams, and consecutive windows with one pick form a phrase,
a reference block of ``window`` words or somewhat more. All phrases are indexed by hash with their counts.
Nothing is parsed greedily: a chain of phrases that the index has from elsewhere too, be it from different
texts, is called a factor. At a factor's ends a phrase differs from the reference in part; there its windows
are looked up one by one, against all phrases with the same anchor. Equal windows always pick the same anchor,
so no repeated window is missed, and a window counts as repeated only if its whole word sequence recurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldsmith.llm.words import WORD_BASE, Words, mix, prefix_sums, range_hashes, text_blocks
from foldsmith.scratch import materialise, short_lived

WINDOW = 35
GRAM = 10
# Span lists of documents are broadcast up to this many numbers, counted first; longer ones are joined by key.
LIST_CELLS = 1_000_000
KEY = ["node", "digest"]


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each start the leftmost place of the least value among ``width`` values."""
    best, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        take = right < left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[:-step])
        span += step
    return at


class _Phrases:
    """Phrases of a block of texts: document, first window, number of windows, anchor place, hashes."""

    def __init__(self, words: Words, window: int):
        self.words, self.window = words, window
        codes = words.hashes()
        self.sums = prefix_sums(codes, WORD_BASE)
        counts = np.diff(words.first)
        n = np.maximum(counts - window + 1, 0)
        self.starts = np.repeat(words.first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        doc = np.repeat(np.arange(len(n)), n)
        if not len(doc):
            self.doc = self.first = self.length = self.anchor = self.phrase = np.zeros(0, dtype=np.int64)
            return
        grams = np.arange(len(codes) - GRAM + 1)
        gram_codes = mix(range_hashes(self.sums, grams, grams + GRAM, WORD_BASE))
        pick = _least_places(gram_codes, window - GRAM + 1)[self.starts]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (pick[1:] != pick[:-1])
        head = np.flatnonzero(new)
        self.length = np.diff(np.append(head, len(doc)))
        self.doc, begin, place = doc[head], self.starts[head], pick[head]
        self.first = begin - words.first[self.doc]
        self.anchor = gram_codes[place]
        whole = range_hashes(self.sums, begin, begin + self.length + window - 1, WORD_BASE)
        self.phrase = mix(mix(whole + self.anchor) + (place - begin).astype(np.uint64) * np.uint64(64) + self.length.astype(np.uint64))

    def window_hashes(self, doc: int, starts: np.ndarray) -> np.ndarray:
        at = starts + self.words.first[doc]
        return mix(range_hashes(self.sums, at, at + self.window, WORD_BASE))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _phrase_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for part, texts in text_blocks(batches, "text"):
        p = _Phrases(Words(texts), window)
        doc = pa.array(p.doc)
        yield pa.RecordBatch.from_arrays(
            [
                _column(part, "node").take(doc),
                _column(part, "digest").take(doc),
                pa.array(p.first.astype(np.int64)),
                pa.array(p.length.astype(np.int64)),
                pa.array(p.anchor.view(np.int64)),
                pa.array(p.phrase.view(np.int64)),
            ],
            names=[*KEY, "first", "length", "anchor", "phrase"],
        )


def _expand(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All window starts of the ranges."""
    ends = np.cumsum(length)
    return np.repeat(first - np.concatenate([[0], ends[:-1]]), length) + np.arange(ends[-1] if len(ends) else 0)


def _ranges(value) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of a packed list."""
    packed = np.asarray(value if value is not None else [], dtype=np.int64)
    return packed >> 32, packed & 0xFFFFFFFF


def _window_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for part, texts in text_blocks(batches, "text"):
        p = _Phrases(Words(texts), window)
        docs, starts, codes = [], [], []
        for d, value in enumerate(_column(part, "ranges").to_numpy(zero_copy_only=False)):
            at = _expand(*_ranges(value))
            docs.append(np.full(len(at), d))
            starts.append(at)
            codes.append(p.window_hashes(d, at))
        doc = pa.array(np.concatenate(docs).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                _column(part, "node").take(doc),
                _column(part, "digest").take(doc),
                pa.array(np.concatenate(starts).astype(np.int64)),
                pa.array(np.concatenate(codes).view(np.int64)),
            ],
            names=[*KEY, "first", "code"],
        )


def _kept_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for part, texts in text_blocks(batches, "text"):
        words = Words(texts)
        raw = words.data.tobytes()
        first, begin, end = words.first.tolist(), words.start.tolist(), words.end.tolist()
        removed, texts_left, spans = [], [], []
        for d, value in enumerate(_column(part, "ranges").to_numpy(zero_copy_only=False)):
            a, n = first[d], first[d + 1] - first[d]
            at, length = _ranges(value)
            depth = np.zeros(n + 1, dtype=np.int64)
            np.add.at(depth, at, 1)
            np.add.at(depth, at + length + window - 1, -1)
            gone = np.cumsum(depth)[:n] > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
            keep = (np.flatnonzero(~gone) + a).tolist()
            removed.append(int(gone.sum()))
            spans.append(edge.tolist())
            texts_left.append(b" ".join([raw[begin[i] : end[i]] for i in keep]))
        yield pa.RecordBatch.from_arrays(
            [
                _column(part, "node"),
                pa.array(np.diff(words.first).astype(np.int64)),
                pa.array(removed, type=pa.int64()),
                pa.array(texts_left, type=pa.binary()).cast(pa.string()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts_left], type=pa.string()),
                pa.array(spans, type=pa.list_(pa.int64())),
            ],
            names=["node", "n_words", "n_removed", "kept_text", "kept_sha256", "spans"],
        )


def _with_ranges(texts: DataFrame, ranges: DataFrame, how: str) -> DataFrame:
    """``texts`` with the packed ranges (first, length) of each document.

    A document's list is no longer than its text. Lists are counted: broadcast while small, else joined.
    """
    packed = F.shiftleft(F.col("first"), 32).bitwiseOR(F.col("length"))
    lists = materialise(ranges.groupBy(*KEY).agg(F.collect_set(packed).alias("ranges")), "ranges")
    lists = lists.withColumnRenamed("node", "_node").withColumnRenamed("digest", "_digest")
    cells = lists.agg(F.coalesce(F.sum(F.size("ranges") + 2), F.lit(0))).first()[0]
    if cells <= LIST_CELLS:
        lists = F.broadcast(lists)
    same = F.col("node").eqNullSafe(F.col("_node")) & (F.col("digest") == F.col("_digest"))
    return texts.join(lists, same, how).select(*KEY, "text", "ranges")


def factors(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(node, digest, first, length): repeated windows of each document of (node, digest, text), as chains."""
    phrases = materialise(
        texts.mapInArrow(
            lambda it: _phrase_rows(it, window),
            "node long, digest long, first long, length long, anchor long, phrase long",
        ),
        "phrases",
    )
    index = materialise(phrases.groupBy("anchor", "phrase").agg(F.count("*").alias("n")), "phrase-index")
    anchors = index.groupBy("anchor").agg(F.sum("n").alias("uses"), F.count("*").alias("kinds"))
    anchors = materialise(anchors.filter("uses > 1").drop("uses"), "anchors")
    found = index.join(anchors, "anchor").select(
        "phrase", (F.col("n") > 1).alias("whole"), (F.col("kinds") > 1).alias("partly")
    )
    found = materialise(found, "found")
    placed = materialise(
        phrases.select(*KEY, "first", "length", "phrase").join(found, "phrase"), "placed"
    )
    # One occurrence of each phrase stands for all in the comparison of single windows.
    ends = placed.filter("partly").groupBy("phrase").agg(
        F.min_by(F.struct(*KEY, "first", "length"), F.struct("node", "digest", "first")).alias("at")
    )
    windows = materialise(
        _with_ranges(texts, ends.select("at.*"), "inner").mapInArrow(
            lambda it: _window_rows(it, window), "node long, digest long, first long, code long"
        ),
        "windows",
    ).distinct()
    again = windows.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    single = windows.join(materialise(again, "again"), "code").select(*KEY, "first", F.lit(1).cast("long").alias("length"))
    whole = placed.filter("whole").select(*KEY, "first", "length")
    return _chains(whole.union(single))


def _chains(ranges: DataFrame) -> DataFrame:
    """Joins ranges of a document that touch or overlap. Sorting stays inside one document."""
    order = Window.partitionBy(*KEY).orderBy("first")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("first") + F.col("length")).over(before)
    marked = ranges.distinct().withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("first")).cast("int"))
    chained = marked.withColumn("chain", F.sum("new").over(order))
    joined = chained.groupBy(*KEY, "chain").agg(
        F.min("first").alias("first"), F.max(F.col("first") + F.col("length")).alias("end")
    )
    return joined.select(*KEY, "first", (F.col("end") - F.col("first")).alias("length"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_removed, kept_text, kept_sha256, spans.

    Each word is removed that lies in a window of ``window`` words whose sequence also starts anywhere else in
    ``docs``, the same document included. Words are compared unchanged. ``spans`` holds the first and one past
    the last word of each removed passage, alternating; kept words are joined by one space.

    A null text has no words. Texts shorter than a window stay. Repeated rows are separate documents, so they
    remove each other's words; null keys are allowed. Other columns of ``docs`` are not read.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.col(key).cast("long").alias("node"), F.xxhash64(body).alias("digest"), body.alias("text"))
    with short_lived(docs.sparkSession):
        spans = materialise(factors(texts, window), "factors", keep=True)
    out = _with_ranges(texts, spans, "left").mapInArrow(
        lambda it: _kept_rows(it, window),
        "node long, n_words long, n_removed long, kept_text string, kept_sha256 string, spans array<long>",
    )
    return out.withColumnRenamed("node", key)
