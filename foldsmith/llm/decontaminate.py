"""Benchmark decontamination by templates: questions are found again when their numbers, names and units changed.

Words become template tokens: typed placeholders for numbers, names and units, else the word in lower case without
punctuation around it. Windows of five tokens are joined by hash with those of the benchmark, by the template or by the
words in lower case, so a name that is no name in a copy (other case, other line breaks) is found too. Windows of one item
that lie equally far apart in the document form an alignment. Its windows count that are word for word the item's, and those
whose slots are filled consistently: each value of the item has one value in the document, the most frequent one of the
alignment. Different values of the item may have the same one in the document.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsmith.llm.tables import look_up
from foldsmith.llm.words import BYTE_BASE, WORD_BASE, Words, _byte_codes, mix, prefix_sums, range_hashes, text_blocks
from foldsmith.scratch import materialise

WINDOW = 5
SIMILARITY = 75  # percent of an item's windows that must be found
LEAST_WORDS = 2  # a window with fewer plain words keeps its values, or any list of numbers would match another
FILTER_BITS = 23
NUMBER, NAME, UNIT = (int(x) for x in mix(np.array([1, 2, 3], dtype=np.uint64)))

# Words that stand for numbers, and units of measure.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half"
).split()
UNITS = (
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds "
    "oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day "
    "days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres percent "
    "dollar dollars cent cents euro euros mph kph kmh km/h m/s hz khz mhz ghz w kw v a j kj cal kcal k c f degree degrees"
).split()


def _flags(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


_DIGIT = _flags((48, 57))
_WORD = _flags((48, 57), (65, 90), (97, 122), (128, 255))
_NUMERIC = _DIGIT | _flags((43, 47), (58, 58))
_UPPER = _flags((65, 90))
_LOWER = _flags((97, 122))
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?:;"])


@lru_cache(maxsize=1)
def _known() -> tuple[np.ndarray, np.ndarray]:
    codes = [np.unique(_codes(Words(pa.array(w)))[0]) for w in (NUMBER_WORDS, UNITS)]
    return codes[0], codes[1]


def _trim(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds without punctuation at either side; a word of punctuation alone stays whole."""
    a, b = start.copy(), end.copy()
    todo = np.arange(len(a))
    while len(todo):
        todo = todo[(a[todo] < b[todo])]
        todo = todo[~_WORD[data[a[todo]]]]
        a[todo] += 1
    todo = np.arange(len(a))
    while len(todo):
        todo = todo[(a[todo] < b[todo])]
        todo = todo[~_WORD[data[b[todo] - 1]]]
        b[todo] -= 1
    empty = a >= b
    return np.where(empty, start, a), np.where(empty, end, b)


def _codes(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each trimmed word in lower case (ASCII and Latin-1 letters), and its bounds."""
    data = words.data
    if len(data):
        after = np.zeros(len(data), dtype=bool)
        after[1:] = data[:-1] == 0xC3
        data = np.where(after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), data + np.uint8(0x20), data)
    a, b = _trim(words.data, words.start, words.end)
    sums = prefix_sums(_byte_codes(True)[data], BYTE_BASE)
    return mix(range_hashes(sums, a, b, BYTE_BASE) + (b - a).astype(np.uint64)), a, b


class Tokens:
    """Values of the words of a block of texts, and those of their template; windows of any length over them."""

    def __init__(self, words: Words):
        self.values, tokens, plain = _templates(words)
        self.count = np.diff(words.first)
        self.exact_sums, self.loose_sums = prefix_sums(self.values, WORD_BASE), prefix_sums(tokens, WORD_BASE)
        self.plain = np.concatenate([[0], np.cumsum(plain)])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the window of ``size`` words at each word: the hash of its values, the template's, and whether that counts."""
        starts = np.arange(max(0, len(self.values) - size + 1))
        loose = range_hashes(self.loose_sums, starts, starts + size, WORD_BASE) + np.uint64(2 * (WINDOW - size))
        exact = range_hashes(self.exact_sums, starts, starts + size, WORD_BASE) + np.uint64(2 * (WINDOW - size) + 1)
        n_plain = self.plain[starts + size] - self.plain[starts]
        return mix(exact), mix(loose), (n_plain >= LEAST_WORDS) & (n_plain < size)


def _templates(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of all words, their template's tokens, and which words are plain."""
    values, a, b = _codes(words)
    data = words.data
    if not len(values):
        return values, values, np.zeros(0, dtype=bool)
    within = lambda flags: np.concatenate([[0], np.cumsum(flags[data])])
    digits, numeric = within(_DIGIT), within(_NUMERIC)
    number_words, units = _known()
    number = ((digits[b] > digits[a]) & (numeric[b] - numeric[a] == b - a)) | np.isin(values, number_words)
    first = np.zeros(len(values), dtype=bool)
    first[words.first[:-1][np.diff(words.first) > 0]] = True
    after_number = np.zeros_like(first)
    after_number[1:] = number[:-1] & ~first[1:]
    unit = after_number & np.isin(values, units)
    lines = within(_flags((10, 10)))
    opens = first.copy()
    opens[1:] |= _STOP[data[words.end[:-1] - 1]] | (lines[words.start[1:]] > lines[words.end[:-1]])
    # A name has one capital: the second letter is small, so words all in capitals stay words.
    at = lambda i: data[np.minimum(i, len(data) - 1)]
    latin = (at(a) == 0xC3) & (at(a + 1) <= 0x9E)
    upper = _UPPER[at(a)] | latin
    second = a + 1 + latin
    upper &= (second < b) & (_LOWER[at(second)] | ((at(second) == 0xC3) & (at(second + 1) >= 0xA0)))
    name = upper & ~opens & ~number & ~unit
    tokens = values.copy()
    tokens[number], tokens[unit], tokens[name] = np.uint64(NUMBER), np.uint64(UNIT), np.uint64(NAME)
    return values, tokens, ~(number | unit | name)


def _window_rows(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """(node, digest, place, size, code, tokens) of the windows whose code may be wanted, a row for each of its codes.

    Without ``wanted`` the texts are items: each has windows of WINDOW words, a shorter one is a window of its own.
    """
    for part, texts in text_blocks(batches, "text"):
        words = Words(texts)
        tokens = Tokens(words)
        for size in sizes:
            n = np.maximum(tokens.count - size + 1, 0)
            if wanted is None and size < WINDOW:
                n = (tokens.count == size).astype(np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            at = place + words.first[doc]
            code = np.zeros(0, dtype=np.uint64)
            if len(at):
                exact, loose, templated = tokens.windows(size)
                # A window with filled slots has a second row, by its template.
                also = np.flatnonzero(templated[at])
                code = np.concatenate([exact[at], loose[at[also]]])
                doc, place, at = (np.concatenate([x, x[also]]) for x in (doc, place, at))
            if wanted is not None:
                low = (code & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                keep = np.flatnonzero((wanted[low >> 3] >> (low & 7).astype(np.uint8)) & 1)
                doc, place, at, code = doc[keep], place[keep], at[keep], code[keep]
            filled = tokens.values[at[:, None] + np.arange(size)].reshape(-1) if len(at) else np.zeros(0, dtype=np.uint64)
            rows = pa.array(doc.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(part.schema.get_field_index("node")).take(rows),
                    part.column(part.schema.get_field_index("digest")).take(rows),
                    pa.array(place.astype(np.int64)),
                    pa.array(np.full(len(at), size, dtype=np.int32)),
                    pa.array(code.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(filled) + 1, size, dtype=np.int32)), pa.array(filled.view(np.int64))),
                ],
                names=["node", "digest", "place", "size", "code", "tokens"],
            )


_ROWS = "node long, digest long, place long, size int, code long, tokens array<long>"


def _wanted_bits(items: DataFrame) -> np.ndarray:
    """A filter of fixed size (2 ** 23 bits) over the benchmark's window hashes; it only spares work."""
    low = items.select(F.col("code").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).cast("int").alias("low")).distinct()
    bits = np.zeros(1 << FILTER_BITS, dtype=np.uint8)
    bits[low.toPandas()["low"].to_numpy(dtype=np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def _counted(windows: list[dict]) -> tuple[list[int], bool]:
    """Places of an alignment's windows that count, and whether one of them has other values than the item."""
    pairs = [[(p["a"], p["b"]) for p in w["pairs"]] for w in windows]
    if all(a == b for each in pairs for a, b in each):
        return [w["place"] for w in windows], False
    # A token lies in up to five windows; it has one vote.
    at = {(w["place"] + i): p for w, each in zip(windows, pairs) for i, p in enumerate(each)}
    votes: dict[int, Counter] = defaultdict(Counter)
    for a, b in at.values():
        votes[a][b] += 1
    value = {a: max(n, key=lambda b: (n[b], a == b, b)) for a, n in votes.items()}
    places, changed = [], False
    for w, each in zip(windows, pairs):
        exact = all(a == b for a, b in each)
        if exact or all(value[a] == b for a, b in each):
            places.append(w["place"])
            changed |= not exact
    return places, changed


def _consistent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, digest, item, item_digest, changed, place) of the windows that count in each alignment."""
    for batch in batches:
        rows, changes, places = [], [], []
        for r, windows in enumerate(batch.column(batch.schema.get_field_index("windows"))):
            counted, changed = _counted(windows.as_py())
            rows += [r] * len(counted)
            changes += [changed] * len(counted)
            places += counted
        at = pa.array(rows, type=pa.int64())
        names = ["node", "digest", "item", "item_digest"]
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(batch.schema.get_field_index(c)).take(at) for c in names],
                pa.array(changes, type=pa.bool_()),
                pa.array(places, type=pa.int64()),
            ],
            names=[*names, "changed", "place"],
        )


def matches(texts: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(node, digest, item, share, changed) of the items found in (node, digest, text)."""
    spark = texts.sparkSession
    # Equal items stand as one, the least id; nothing is found twice for them.
    asked = benchmark.select(F.col(item).cast("long").alias("node"), F.col(text).cast("string").alias("text"))
    asked = asked.filter("text is not null").groupBy("text").agg(F.min("node").alias("node"))
    asked = asked.select("node", F.xxhash64("text").alias("digest"), "text")
    every = list(range(1, WINDOW + 1))
    items = materialise(asked.mapInArrow(lambda it: _window_rows(it, None, every), _ROWS), "item-windows")
    # Texts are cut into windows of the lengths that the items have: five words, and those of shorter items.
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    wanted = spark.sparkContext.broadcast(_wanted_bits(items))
    seen = materialise(texts.mapInArrow(lambda it: _window_rows(it, wanted.value, sizes), _ROWS), "seen-windows")
    theirs = items.select(
        F.col("node").alias("item"), F.col("digest").alias("item_digest"), F.col("place").alias("item_place"),
        F.col("tokens").alias("item_tokens"), "code", "size",
    )
    both = seen.join(theirs, ["code", "size"])
    ids = ["node", "digest", "item", "item_digest"]
    pairs = F.zip_with("item_tokens", "tokens", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    window = F.struct(F.col("item_place").alias("place"), pairs.alias("pairs"))
    lined = both.groupBy(*ids, (F.col("place") - F.col("item_place")).alias("shift")).agg(F.collect_set(window).alias("windows"))
    found = lined.mapInArrow(_consistent, "node long, digest long, item long, item_digest long, changed boolean, place long")
    found = found.groupBy(*ids).agg(F.countDistinct("place").alias("n"), F.min("changed").alias("changed"))
    sizes = items.groupBy(F.col("digest").alias("item_digest")).agg(F.countDistinct("place").alias("windows"))
    sized = look_up(found, materialise(sizes, "item-sizes"), ["item_digest"], "inner")
    hit = sized.filter(100 * F.col("n") >= SIMILARITY * F.col("windows"))
    return hit.select("node", "digest", "item", (F.col("n") / F.col("windows")).alias("share"), "changed")


def _with_hits(docs: DataFrame, benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """``row`` (the columns of docs) and ``items``, null where nothing was found."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.col(key).cast("long").alias("node"), F.xxhash64(body).alias("digest"), body.alias("text"))
    item = F.struct("item", "share", "changed")
    found = matches(texts, benchmark).groupBy("digest").agg(F.sort_array(F.collect_set(item)).alias("items"))
    found = materialise(found, "leaks")
    cells = found.agg(F.coalesce(F.sum(3 * F.size("items") + 1), F.lit(0))).first()[0]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(body).alias("digest"))
    return look_up(rows, found, ["digest"], cells=cells)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, items (sorted ids found in it), shares, n_exact, n_changed, kept.

    An item is found if three quarters of its windows of five tokens occur in alignments, word for word or with consistent
    slots; it is exact if the counted values are the item's own in one alignment, else changed. A document stays (``kept``)
    if nothing is found.

    An item of fewer than five words is one window of its own length and is found wherever its words stand.

    Null and empty texts hold nothing. Null items and items without words find nothing; equal items stand as the least id.
    Equal texts get equal results, whatever their keys. Very long texts are worked off whole, one at a time. An empty
    table gives no rows, an empty benchmark finds nothing. Other columns are not read.
    """
    hits = _with_hits(docs, benchmark, key, text)
    items = F.coalesce("items", F.array().cast("array<struct<item:bigint,share:double,changed:boolean>>"))
    n_changed = F.size(F.filter(items, lambda x: x["changed"])).cast("long")
    return hits.select(
        F.col("row")[key].alias(key),
        items["item"].alias("items"),
        items["share"].alias("shares"),
        (F.size(items) - n_changed).cast("long").alias("n_exact"),
        n_changed.alias("n_changed"),
        (F.size(items) == 0).alias("kept"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows in which an item of the benchmark was found."""
    return _with_hits(docs, benchmark, key, text).filter("items is null").select("row.*")
