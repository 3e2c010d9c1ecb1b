"""A multiway hyperplane tree (GNAT) whose split points store distance ranges to their sibling subtrees.

The tree is laid out on a bounded sample and then describes all rows: every row goes to the nearest split point at
each node, and the ranges are the least and largest distances of all rows of a subtree from each split point.
Points are vectors with one more coordinate that gives all rows the same length, so that the inner product with a
query decides the distance from it: d^2 = |q|^2 + longest^2 - 2 <q, x>.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

# Split points are chosen among this many rows; every row of the table is filed under them.
SAMPLE_ROWS = 16_384
FANOUT = 16
DEPTH = 3
LEAST_LEAF, MOST_LEAF = 256, 65_536
# Relative slack of the distances, so that rounding never rules a row out.
SLACK = 1e-9


def leaf_rows(n: int) -> int:
    """Rows of a leaf, growing with the square root of the table: what an anchor is sent to and what a task holds then
    grow alike."""
    return min(MOST_LEAF, max(LEAST_LEAF, 4 * math.isqrt(n)))


@dataclass
class Node:
    """Split points and, for each, the child it leads to: a node, or below zero the leaf -1 - child."""

    points: np.ndarray
    children: list[int]
    low: np.ndarray = field(default=None)  # low[i, j]: least distance of split point i from the rows of subtree j
    high: np.ndarray = field(default=None)


@dataclass
class Tree:
    nodes: list[Node]
    leaves: int
    longest: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Rows with the added coordinate."""
        rest = np.sqrt(np.maximum(0.0, self.longest - (x * x).sum(axis=1)))
        return np.hstack([x, rest[:, None]])

    def walk(self, lifted: np.ndarray):
        """(node, rows, distances, nearest) for every node that rows pass through."""
        todo = [(0, np.arange(len(lifted)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            apart = distances(lifted[rows], node.points)
            nearest = apart.argmin(axis=1)
            yield at, rows, apart, nearest
            for j, child in enumerate(node.children):
                if child >= 0:
                    inside = rows[nearest == j]
                    if len(inside):
                        todo.append((child, inside))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int32)
        for at, rows, _, nearest in self.walk(self.lift(x)):
            ends = np.array([-1 - c for c in self.nodes[at].children], dtype=np.int32)
            out[rows] = ends[nearest]
        return out

    def reachable(self, queries: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """queries x leaves: the leaf's subtree is not ruled out for the annulus between ``near`` and ``far``.

        Subtree j is ruled out by split point i if no distance within its range can give a distance from the query
        inside the annulus, by the triangle inequality.
        """
        out = np.zeros((len(queries), self.leaves), dtype=bool)
        lifted = np.hstack([queries, np.zeros((len(queries), 1))])
        slack = SLACK * (math.sqrt(self.longest) + far.max(initial=0.0) + 1.0)
        todo = [(0, np.arange(len(queries)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            apart = distances(lifted[rows], node.points)
            for j, child in enumerate(node.children):
                if not np.isfinite(node.low[:, j]).all():
                    continue  # no rows there
                least = np.maximum(apart - node.high[:, j], node.low[:, j] - apart).max(axis=1)
                most = (apart + node.high[:, j]).min(axis=1)
                alive = rows[(least <= far[rows] + slack) & (most >= near[rows] - slack)]
                if not len(alive):
                    continue
                if child >= 0:
                    todo.append((child, alive))
                else:
                    out[alive, -1 - child] = True
        return out


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(0.0, squares))


def _spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` different points far from each other: of a few times as many drawn ones, each next the farthest off."""
    drawn = np.unique(x[rng.choice(len(x), min(len(x), 4 * k), replace=False)], axis=0)
    chosen = [0]
    away = distances(drawn, drawn[:1])[:, 0]
    while len(chosen) < min(k, len(drawn)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distances(drawn, drawn[chosen[-1:]])[:, 0])
    return drawn[chosen]


def plant(sample: np.ndarray, n: int, longest: float, seed: int = 11) -> Tree:
    """A tree for ``n`` rows from a sample of them; deep enough for leaves of ``leaf_rows``, DEPTH at most."""
    rng = np.random.default_rng(seed)
    tree = Tree([], 0, longest)
    wanted = max(2, math.ceil(n / leaf_rows(n)))
    depth = min(DEPTH, max(1, math.ceil(math.log(wanted) / math.log(FANOUT))))
    fanout = min(FANOUT, max(2, math.ceil(wanted ** (1 / depth))))

    def grow(rows: np.ndarray, level: int) -> int:
        at = len(tree.nodes)
        tree.nodes.append(None)
        points = _spread(rows, fanout, rng)
        nearest = distances(rows, points).argmin(axis=1)
        children = []
        for j in range(len(points)):
            inside = rows[nearest == j]
            if level + 1 < depth and len(inside) >= 2 * fanout:
                children.append(grow(inside, level + 1))
            else:
                children.append(-1 - tree.leaves)
                tree.leaves += 1
        tree.nodes[at] = Node(points, children)
        return at

    grow(tree.lift(sample), 0)
    return tree
