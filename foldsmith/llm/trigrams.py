"""Boolean trigram queries of regular expressions: what a text must contain for a pattern to match it."""

from __future__ import annotations

import re

_PARSER = re._parser
_OPS = re._constants
MAX_VARIANTS = 16
MAX_CLASS = 5

# A clause lists alternatives; a text has to contain all trigrams of one of them.
Clause = list[frozenset[str]]


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _literals(op, arg) -> list[str] | None:
    """The strings one parsed item can match, if they are few."""
    if op is _OPS.LITERAL:
        return [chr(arg).lower()]
    if op is _OPS.IN and all(o is _OPS.LITERAL for o, _ in arg) and len(arg) <= MAX_CLASS:
        return sorted({chr(a).lower() for _, a in arg})
    if op is _OPS.SUBPATTERN:
        return _strings(arg[3])
    if op is _OPS.BRANCH:
        parts = [_strings(b) for b in arg[1]]
        return None if None in parts else sorted({s for p in parts for s in p})
    if op is _OPS.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
        once = _strings(arg[2])
        return None if once is None else ["", *once]
    return None


def _strings(items) -> list[str] | None:
    out = [""]
    for op, arg in items:
        more = _literals(op, arg)
        if more is None or len(out) * len(more) > MAX_VARIANTS:
            return None
        out = [a + b for a in out for b in more]
    return out


def clauses(pattern: str) -> list[Clause]:
    """All of these must hold, in lower case, for a match; none means that the pattern has no mandatory trigram."""
    return _clauses(_PARSER.parse(pattern))


def _clauses(items) -> list[Clause]:
    found: list[Clause] = []
    now = [""]

    def close() -> None:
        sets = [trigrams(s) for s in now]
        if all(sets):
            found.append(sorted(set(sets), key=sorted))

    for op, arg in items:
        more = _literals(op, arg)
        if more is not None and len(now) * len(more) <= MAX_VARIANTS:
            now = [a + b for a in now for b in more]
            continue
        close()
        now = more if more is not None else [""]
        if more is None and op is _OPS.SUBPATTERN:
            found += _clauses(arg[3])
        elif more is None and op is _OPS.MAX_REPEAT and arg[0] >= 1:
            found += _clauses(arg[2])
    close()
    return found
