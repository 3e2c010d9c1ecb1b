"""Line dedup: content-defined chunks of lines, and pairs of lines for what repeats across chunk bounds.

Chunks keep their bounds when lines are put in or taken out, but a passage shorter than a chunk, or at its edge, is in no
common chunk. So every two successive lines with text are looked up as well: a repeated passage of two such lines or more is
found wherever its chunk bounds lie. What goes is what the pairs say; every repeated chunk is made of repeated pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsmith.llm.substrings import KEY, LIST_CELLS
from foldsmith.llm.tables import spread_join
from foldsmith.llm.words import text_blocks
from foldsmith.scratch import materialise, short_lived

# A chunk ends after a line at which the rolling hash over the last ROLL lines is 0 modulo DIVISOR.
ROLL, DIVISOR = 2, 3
LEAST_LINES = 2


def chunk_bounds(lines: list[bytes]) -> list[tuple[int, int]]:
    """[start, end) of the chunks. A bound depends on the two lines before it, and on the last bound being two lines back.

    Two equal lines always end a chunk: a run of one line would else have one hash throughout, and often no bound at all.
    """
    codes = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        rolled = (codes[i] * 3 + (codes[i - 1] if i >= ROLL - 1 else 0)) & 0xFFFFFFFFFFFFFFFF
        cut = (rolled >> 7) % DIVISOR == 0 or (i > 0 and codes[i] == codes[i - 1])
        if cut and i + 1 - start >= LEAST_LINES:
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def pair_bounds(lines: list[bytes]) -> list[tuple[int, int]]:
    """[start, end) of every two successive lines with text; blank lines between them belong to the pair."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    return [(a, b + 1) for a, b in zip(full, full[1:])]


def worded_chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """The chunks from their first to their last line with text; those with fewer than LEAST_LINES such lines are left out."""
    out = []
    for a, b in chunk_bounds(lines):
        full = [i for i in range(a, b) if lines[i].strip()]
        if len(full) >= LEAST_LINES:
            out.append((full[0], full[-1] + 1))
    return out


def _units(lines: list[bytes], pairs: bool) -> list[tuple[int, int]]:
    chunks = worded_chunks(lines)
    return sorted({*chunks, *pair_bounds(lines)}) if pairs else chunks


def _lines(texts: pa.Array) -> Iterator[list[bytes]]:
    for t in texts.to_pylist():
        yield t.encode().split(b"\n") if t else []


def _unpacked(ranges: list[int] | None) -> list[tuple[int, int]]:
    return [(x >> 32, x & 0xFFFFFFFF) for x in ranges or ()]


def _code(chunk: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(chunk, digest_size=8).digest(), "little", signed=True)


def _unit_rows(batches: Iterator[pa.RecordBatch], pairs: bool) -> Iterator[pa.RecordBatch]:
    """(node, digest, start, stop, code) of every chunk of two and more lines, and of every pair if asked for."""
    for part, texts in text_blocks(batches, "text"):
        rows, starts, stops, codes = [], [], [], []
        for d, lines in enumerate(_lines(texts)):
            for a, b in _units(lines, pairs):
                rows.append(d)
                starts.append(a)
                stops.append(b)
                codes.append(_code(b"\n".join(lines[a:b])))
        doc = pa.array(rows, type=pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                *[part.column(part.schema.get_field_index(k)).take(doc) for k in KEY],
                pa.array(starts, type=pa.int64()),
                pa.array(stops, type=pa.int64()),
                pa.array(codes, type=pa.int64()),
            ],
            names=[*KEY, "start", "stop", "code"],
        )


def _unit_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, digest, start, stop, code, chunk) of the listed chunks and pairs, with their bytes."""
    for part, texts in text_blocks(batches, "text"):
        wanted = part.column(part.schema.get_field_index("ranges")).to_pylist()
        rows, starts, stops, codes, chunks = [], [], [], [], []
        for d, (lines, want) in enumerate(zip(_lines(texts), wanted)):
            for a, b in _unpacked(want):
                chunk = b"\n".join(lines[a:b])
                rows.append(d)
                starts.append(a)
                stops.append(b)
                codes.append(_code(chunk))
                chunks.append(chunk)
        doc = pa.array(rows, type=pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                *[part.column(part.schema.get_field_index(k)).take(doc) for k in KEY],
                pa.array(starts, type=pa.int64()),
                pa.array(stops, type=pa.int64()),
                pa.array(codes, type=pa.int64()),
                pa.array(chunks, type=pa.binary()),
            ],
            names=[*KEY, "start", "stop", "code", "chunk"],
        )


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_blocks(batches, "text"):
        gone = part.column(part.schema.get_field_index("ranges")).to_pylist()
        n_lines, n_removed, n_chunks, kept = [], [], [], []
        for lines, ranges in zip(_lines(texts), gone):
            drop = set(_unpacked(ranges))
            at = {i for a, b in drop for i in range(a, b)}
            left = [x for i, x in enumerate(lines) if i not in at]
            n_lines.append(len(lines))
            n_removed.append(len(lines) - len(left))
            n_chunks.append(sum(c in drop for c in worded_chunks(lines)) if drop else 0)
            kept.append(b"\n".join(left))
        yield pa.RecordBatch.from_arrays(
            [
                part.column(part.schema.get_field_index("node")),
                pa.array(n_lines, type=pa.int64()),
                pa.array(n_removed, type=pa.int64()),
                pa.array(n_chunks, type=pa.int64()),
                pa.array([k.decode() for k in kept], type=pa.string()),
            ],
            names=["node", "n_lines", "n_removed", "n_chunks", "kept_text"],
        )


def _with_ranges(texts: DataFrame, ranges: DataFrame, how: str) -> DataFrame:
    """``texts`` with the packed ranges (start, stop) listed for each; the lists are counted and broadcast only while small."""
    packed = F.shiftleft(F.col("start"), 32).bitwiseOR(F.col("stop"))
    lists = materialise(ranges.groupBy(*KEY).agg(F.collect_set(packed).alias("ranges")), "chunk-lists")
    lists = lists.withColumnRenamed("node", "_node").withColumnRenamed("digest", "_digest")
    cells = lists.agg(F.coalesce(F.sum(F.size("ranges") + 2), F.lit(0))).first()[0]
    same = F.col("node").eqNullSafe(F.col("_node")) & (F.col("digest") == F.col("_digest"))
    return texts.join(F.broadcast(lists) if cells <= LIST_CELLS else lists, same, how).select(*KEY, "text", "ranges")


def remove_repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_lines, n_removed (lines), n_chunks (removed whole), kept_text.

    What ``remove_repeated_chunks`` removes, and every two successive lines with text (blank lines between them included)
    whose bytes occurred before, in a lower key or earlier in the text without overlap. So of a passage of two such lines or
    more that occurred before no line stays, wherever chunks are cut; of a run of one line the first two stay. Every
    removed line has an equal one that stays; a line next to blank lines only never goes. Keys, nulls and equal rows are
    treated as there. Very long texts are worked off whole, one at a time. An empty table gives no rows.
    """
    return _without_repeats(docs, key, text, pairs=True)


def remove_repeated_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_lines, n_removed (lines), n_chunks (removed), kept_text.

    Lines are cut into chunks where a rolling hash over two line hashes says so. A chunk with two or more lines with text
    (blank lines at its ends put aside) whose bytes occurred before, in a lower key or earlier in the text, is removed; the first occurrence stays. Hashes find the
    candidates, and bytes are compared before anything is removed. Single lines are never removed.

    Null and empty texts have no lines. A null key counts as later than all others. Rows equal in key and text are one
    document: both keep its first occurrences, and are cleaned alike. Other columns of ``docs`` are not read.
    """
    return _without_repeats(docs, key, text, pairs=False)


def _without_repeats(docs: DataFrame, key: str, text: str, pairs: bool) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.col(key).cast("long").alias("node"), F.xxhash64(body).alias("digest"), body.alias("text"))
    with short_lived(docs.sparkSession):
        gone = materialise(_repeats(texts, pairs), "repeated", keep=True)
    out = _with_ranges(texts, gone, "left").mapInArrow(
        _cleaned, "node long, n_lines long, n_removed long, n_chunks long, kept_text string"
    )
    return out.withColumnRenamed("node", key)


def _repeats(texts: DataFrame, pairs: bool) -> DataFrame:
    """(node, digest, start, stop) of the chunks and pairs to remove."""
    place = "node long, digest long, start long, stop long, code long"
    units = materialise(texts.mapInArrow(lambda it: _unit_rows(it, pairs), place), "chunks").distinct()
    often = units.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1")
    # A passage that stands in a third of all rows is one code: its rows are dealt over many tasks.
    placed = spread_join(units, materialise(often, "repeated-chunks"), ["code"], [*KEY, "start"], "inner")
    found = _with_ranges(texts, placed, "inner").mapInArrow(_unit_texts, f"{place}, chunk binary")
    found = materialise(found.distinct().withColumn("bytes_of", F.sha2("chunk", 256)), "chunk-texts")
    # Equal code and equal bytes: the group key compares them. The first occurrence is found with partial sums.
    order = F.struct(F.col("node").isNull().alias("last"), "node", "digest", "start", "stop")
    first = found.groupBy("code", "chunk", "bytes_of").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = materialise(first.select("code", "bytes_of", "first", "n"), "first-chunks")
    # The first occurrence itself stays, and so does one that overlaps it.
    same = F.col("node").eqNullSafe(F.col("first.node")) & (F.col("digest") == F.col("first.digest"))
    later = ~same | (F.col("start") >= F.col("first.stop"))
    placed = spread_join(found.drop("chunk"), first, ["code", "bytes_of"], [*KEY, "start"], "inner")
    return placed.filter(later).select(*KEY, "start", "stop")
