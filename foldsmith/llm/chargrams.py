"""Hashed character n-grams of texts, by numpy inside the tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from foldsmith.llm.words import ODD, mix, string_bytes

ORDERS = (3, 4, 5)


@lru_cache(maxsize=1)
def _small_letters() -> np.ndarray:
    """Lower case of the code points below 1424, where it is one character; white space becomes a blank."""
    out = np.arange(1424, dtype=np.uint32)
    for i in range(1424):
        low = chr(i).lower()
        out[i] = 32 if chr(i).isspace() else ord(low) if len(low) == 1 else i
    return out


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts with a blank before and after each, and the offsets of the texts."""
    offsets, data = string_bytes(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    small = _small_letters()
    points = np.where(points < len(small), small[np.minimum(points, len(small) - 1)], points)
    n = len(starts) - 1
    bounds = starts + 2 * np.arange(n + 1)
    out = np.full(bounds[-1], 32, dtype=np.uint32)
    out[np.arange(len(points)) + 2 * np.repeat(np.arange(n), np.diff(starts)) + 1] = points
    return out, bounds


def gram_sets(texts: pa.Array, bits: int) -> Iterator[np.ndarray]:
    """For each text the distinct buckets of its n-grams of ``ORDERS``, in no fixed order."""
    points, bounds = code_points(texts)
    codes = mix(points.astype(np.uint64) + np.uint64(ODD))
    grams = {}
    total = codes.copy()
    for k in range(1, max(ORDERS)):
        total = total[:-1] * np.uint64(0xD6E8FEB86659FD93) + codes[k:]
        if k + 1 in ORDERS:
            grams[k + 1] = (mix(total + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int32)
    last = np.zeros(1 << bits, dtype=np.int32)
    for a, b in zip(bounds.tolist(), bounds.tolist()[1:]):
        found = np.concatenate([g[a : max(a, b - n + 1)] for n, g in grams.items()])
        # The place written last in each bucket marks one of its occurrences.
        order = np.arange(len(found), dtype=np.int32)
        last[found] = order
        yield found[last[found] == order]
