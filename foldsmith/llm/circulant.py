"""Circulant MinHash: every signature coordinate comes from two permutations, the second one shifted.

A shingle is folded into a universe of 2 ** 20 places, the first permutation moves it, and coordinate k is
the least value of the second permutation read k places further on. Reading K places in a row gives all K
coordinates of a shingle, so a signature is one gather and one minimum.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from foldsmith.llm.words import WORD_BASE, mix, powers

UNIVERSE_BITS = 20
GATHER_ROWS = 8192


@lru_cache(maxsize=4)
def _tables(seed: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    size = 1 << UNIVERSE_BITS
    first = rng.permutation(size).astype(np.int32)
    second = rng.permutation(size).astype(np.int32)
    ring = np.concatenate([second, second[: k - 1]])
    return first, np.lib.stride_tricks.sliding_window_view(ring, k)


def signature(shingles: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k coordinates of a non-empty set of 64-bit shingle hashes."""
    first, shifted = _tables(seed, k)
    places = first[(shingles >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)]
    out = shifted[places[:GATHER_ROWS]].min(axis=0)
    for at in range(GATHER_ROWS, len(places), GATHER_ROWS):
        np.minimum(out, shifted[places[at : at + GATHER_ROWS]].min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each row of signatures and band; the band's number is part of the key."""
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    folded = (mix(parts + np.uint64(1)) * powers(WORD_BASE, rows)).sum(axis=2, dtype=np.uint64)
    return mix(folded + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
