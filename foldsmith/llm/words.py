"""Words of whole Arrow batches and their 64-bit hashes, by numpy inside the tasks.

A word is a run of characters other than space and the controls 9 to 13. A batch of texts is worked off
in blocks of half a megabyte; a longer text is a block of its own, so memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=8)
def _powers(base: int, inverse: bool, size: int) -> np.ndarray:
    step = pow(base, -1, 1 << 64) if inverse else base
    out = np.full(size, step, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; tables are kept by size classes."""
    size = 1 << max(12, int(n - 1).bit_length()) if n else 1
    return _powers(base, inverse, size)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _byte_codes(fold_case: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

BYTE_BASE = 0xD6E8FEB86659FD93
WORD_BASE = 0xA0761D6478BD642F


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the ranges [start, end) given the prefix sums of item * base ** position."""
    return (prefix[end] - prefix[start]) * powers(base, len(prefix), inverse=True)[start]


def prefix_sums(items: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(items) + 1, dtype=np.uint64)
    np.cumsum(items * powers(base, len(items)), out=out[1:])
    return out


class Words:
    """Word boundaries (byte offsets) of a block of texts; words of text d are first[d] .. first[d + 1] - 1."""

    def __init__(self, texts: pa.Array, fold_case: bool = False):
        offsets, self.data = string_bytes(texts)
        self.offsets = offsets
        inside = ~_SPACE[self.data]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(inside):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            full = offsets[:-1] < offsets[1:]
            before[offsets[:-1][full]] = False
            after[offsets[1:][full] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._fold_case = fold_case

    def hashes(self) -> np.ndarray:
        sums = prefix_sums(_byte_codes(self._fold_case)[self.data], BYTE_BASE)
        return mix(range_hashes(sums, self.start, self.end, BYTE_BASE) + (self.end - self.start).astype(np.uint64))


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and UTF-8 bytes of a string array; nulls are empty."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    if not len(texts) or offsets is None:
        return np.zeros(len(texts) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def text_blocks(
    batches: Iterator[pa.RecordBatch], text: str, block_bytes: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches whose texts stay near ``block_bytes``, with their text column."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if column.type == pa.null():
            column = column.cast(pa.string())
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(sizes) // block_bytes
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a), column.slice(a, b - a)


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; a shorter text is one shingle."""
    codes = words.hashes()
    sums = prefix_sums(codes, WORD_BASE)
    starts = np.arange(max(0, len(codes) - n + 1))
    full = mix(range_hashes(sums, starts, starts + n, WORD_BASE) + np.uint64(n))
    for a, b in zip(words.first.tolist(), words.first.tolist()[1:]):
        if b - a >= n:
            yield np.unique(full[a : b - n + 1])
        elif b > a:
            whole = range_hashes(sums, np.array([a]), np.array([b]), WORD_BASE)
            yield mix(whole + np.uint64(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)


def long_lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list<long> column; its int32 offsets hold 2 ** 31 values, far above what a block of texts has."""
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint64)
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))
