"""E8 lattice hashing of unit vectors: random projections, decoding, neighbouring cells."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from foldsmith.llm.words import mix

LENGTH = 8


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: (+-1, +-1, 0 ..) in any places, and (+-1/2 ..) with an even number of minuses."""
    pairs = []
    for i, j in itertools.combinations(range(LENGTH), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(LENGTH)
            v[i], v[j] = a, b
            pairs.append(v)
    halves = [s for s in itertools.product((0.5, -0.5), repeat=LENGTH) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*pairs, *halves])


def _even(z: np.ndarray) -> np.ndarray:
    """Nearest point with whole entries and an even sum: where the sum is odd, the entry rounded worst goes the other way."""
    near = np.rint(z)
    off = z - near
    worst = np.abs(off).argmax(axis=-1)[..., None]
    step = np.where(np.take_along_axis(off, worst, -1) >= 0, 1.0, -1.0)
    moved = near.copy()
    np.put_along_axis(moved, worst, np.take_along_axis(near, worst, -1) + step, -1)
    return np.where((near.sum(axis=-1) % 2 != 0)[..., None], moved, near)


def decode(z: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row of eight numbers: whole or half-whole entries, whichever are nearer."""
    whole, half = _even(z), _even(z - 0.5) + 0.5
    nearer = ((z - whole) ** 2).sum(axis=-1) <= ((z - half) ** 2).sum(axis=-1)
    return np.where(nearer[..., None], whole, half)


@dataclass(frozen=True)
class LatticeHash:
    """``tables`` hashes of ``blocks`` E8 points each; ``cell`` is the size of the cells, ``probes`` the neighbouring
    cells looked into per table."""

    width: int
    blocks: int
    tables: int
    cell: float
    probes: int
    seed: int = 2718

    def projections(self) -> np.ndarray:
        """width x (tables * blocks * 8) Gaussian directions, the same wherever they are drawn."""
        rng = np.random.default_rng(self.seed)
        return rng.standard_normal((self.width, self.tables * self.blocks * LENGTH)) / self.cell

    def keys(self, unit: np.ndarray, projections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x tables, rows x tables x probes): keys of the own cells and of the nearest cells beside them.

        A key adds up one hash per block, so a neighbouring cell's key changes that block's hash only.
        """
        near = neighbours()
        z = (unit @ projections).reshape(len(unit), self.tables, self.blocks, LENGTH)
        own = decode(z)
        part = self._hash(own)
        home = part.sum(axis=2, dtype=np.uint64)
        # Moving to a neighbour n lengthens the squared way to the projection by |n|^2 - 2 (z - own) n = 2 - 2 (z - own) n.
        further = -((z - own) @ near.T).reshape(len(unit), self.tables, -1)
        best = np.argpartition(further, self.probes, axis=2)[:, :, : self.probes]
        block, step = best // len(near), best % len(near)
        row, table = np.ogrid[: len(unit), : self.tables]
        moved = own[row[..., None], table[..., None], block] + near[step]
        there = self._hash_at(moved, np.broadcast_to(np.arange(self.tables)[None, :, None], block.shape), block)
        probed = home[..., None] - part[row[..., None], table[..., None], block] + there
        return home, probed

    def _hash(self, points: np.ndarray) -> np.ndarray:
        table, block = np.indices(points.shape[1:3])
        return self._hash_at(points, table[None], block[None])

    @staticmethod
    def _hash_at(points: np.ndarray, table: np.ndarray, block: np.ndarray) -> np.ndarray:
        doubled = np.rint(2 * points).astype(np.int64).view(np.uint64)
        out = mix((np.asarray(table) * 64 + block + 1).astype(np.uint64))
        for i in range(LENGTH):
            out = mix((out ^ doubled[..., i]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i))
        return out


@lru_cache(maxsize=64)
def meeting_chance(width: int, blocks: int, cell: float, probes: int, cosine: float, trials: int = 1600) -> float:
    """Share of simulated pairs with this cosine of which one stands in a cell that the other looks into, in one table."""
    rng = np.random.default_rng(99)
    met, rounds = 0, 8
    for i in range(rounds):
        u = rng.standard_normal((trials // rounds, width))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        v = rng.standard_normal(u.shape)
        v -= (v * u).sum(axis=1, keepdims=True) * u
        size = np.linalg.norm(v, axis=1, keepdims=True)
        v = cosine * u + np.sqrt(1 - cosine * cosine) * np.divide(v, size, out=np.zeros_like(v), where=size > 0)
        one = LatticeHash(width, blocks, 1, cell, probes, seed=1000 + i)
        p = one.projections()
        (hu, pu), (hv, pv) = one.keys(u, p), one.keys(v, p)
        hit = (hu == hv) | (pu == hv[..., None]).any(axis=2) | (pv == hu[..., None]).any(axis=2)
        met += int(hit.sum())
    return met / (trials // rounds * rounds)
