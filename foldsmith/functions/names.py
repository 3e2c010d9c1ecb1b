"""Which column combinations are built, and what the results are called."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

MODES = ("all", "legacy")


def _check(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")


def flag_pairs(n: int, mode: str = "all") -> list[tuple[int, int]]:
    """Index pairs of n flags. ``legacy`` leaves out neighbours."""
    _check(mode)
    gap = 1 if mode == "all" else 2
    return [(a, b) for a in range(n) for b in range(a + gap, n)]


def flag_triples(n: int, mode: str = "all") -> list[tuple[int, int, int]]:
    """Index triples of n flags.

    ``legacy``: pairs as in :func:`flag_pairs`; the third index is 0 or 1, and with first index 0
    also anything two or more past the second.
    """
    _check(mode)
    if mode == "all":
        return list(combinations(range(n), 3))
    out = []
    for a, b in flag_pairs(n, mode):
        third = [0, 1] + (list(range(b + 2, n)) if a == 0 else [])
        out += [(a, b, c) for c in third]
    return out


def category_pairs(n: int, mode: str = "all") -> list[tuple[int, int]]:
    """Index pairs of n categories for group statistics.

    ``legacy``: the first index is even; the second is a lower odd index, or two or more above.
    """
    _check(mode)
    if mode == "all":
        return list(combinations(range(n), 2))
    return [
        (x, y)
        for x in range(0, n, 2)
        for y in range(n)
        if (y < x and y % 2 == 1) or y >= x + 2
    ]


def odds_pairs(n_cat: int, n_flag: int, mode: str = "all") -> list[tuple[int, int]]:
    """Index pairs (category, category or flag) for target odds; flags follow the categories."""
    _check(mode)
    gap = 1 if mode == "all" else 2
    return [(i, j) for i in range(n_cat) for j in range(i + gap, n_cat + n_flag)]


@dataclass(frozen=True)
class TripleForm:
    """``(a <join> [not] b) or [not] c`` over 0/1 flags."""

    name: str
    join: str
    not_b: bool
    not_c: bool

    def column(self, a: str, b: str, c: str) -> str:
        # Fixed format: 'not' is glued to the flag it negates.
        return f"{a}_{self.join}_{'not' * self.not_b}{b}_or_{'not' * self.not_c}{c}"


TRIPLE_FORMS = (
    TripleForm("or", "or", False, False),
    TripleForm("and_or", "and", False, False),
    TripleForm("ornot", "or", True, False),
    TripleForm("ornot_ornot", "or", True, True),
    TripleForm("andnot_or", "and", True, False),
    TripleForm("and_ornot", "and", False, True),
)


def pair_column(a: str, b: str) -> str:
    return f"{a}_or_{b}"


def set_name(keys: tuple[str, ...]) -> str:
    return "_".join(keys)


def penalty(name: str, rules) -> float:
    """Weight of the first rule whose name parts all occur in ``name``; 1.0 when none does."""
    for parts, weight in rules:
        if all(p in name for p in parts):
            return float(weight)
    return 1.0
