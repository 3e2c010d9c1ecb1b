"""A small table with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row string, node long, digest string, shard string, slot string, band int, size double, quality string, _gone int"
)
EXTRA = ("r", 5, "d", "s", "t", 1, 0.5, "q", 3)


def prose(rng, n, vocabulary=3000):
    return " ".join(("w%d" % rng.randrange(vocabulary)) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def rows(seed=5):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(12)]
    shared = prose(rng, 60)
    texts = [None, "", " \n\t ", "One", "two words", "one two three four", *base]
    for b in base[:4]:
        words = b.split(" ")
        words[len(words) // 2] = "CHANGED"
        texts += [b, b.upper(), " ".join(words), " ".join(words[:-3])]
    texts += [base[0]] * 6 + [prose(rng, 40) + "\n" + shared + "\n" + prose(rng, 50) for _ in range(6)]
    texts += ["the menu | a | b | c | d\n" * 30, "same same same " * 60, prose(rng, 30000)]
    texts += ["a x y a b b a y b\n" + "line one here.\nline two here.\nline three.\n" + prose(rng, 70) for _ in range(3)]
    out = [(i, t, "en", "s%d" % (i % 4) if i % 5 else None, len(t) if t else 0) for i, t in enumerate(texts)]
    out += [out[6], out[6], (None, base[5], None, "s1", None), (None, None, None, None, None)]
    return [(*r, *EXTRA) for r in out]


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near_duplicates(docs):
    """{doc_id: (size, component)} for rows with an id."""
    sets = [(i, shingles(t)) for i, t in docs if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            k = len(a & b)
            if k and 100 * k >= 75 * (len(a) + len(b) - k):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def substring_rows(texts, window=35):
    """(n_words, n_removed, sha256 of the kept words) of each text."""
    each = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in each for i in range(len(w) - window + 1))
    out = []
    for w in each:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
BASE = (("assign", ASSIGN, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))


def secret_spans(text):
    return [
        (m.start(), k, m.end()) for k, (_, rule, group, least) in enumerate(BASE) for m in rule.finditer(text or "") if len(m[group]) >= least
    ]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    w = words(text)
    tri = defaultdict(list)
    for i in range(len(w) - 2):
        tri[tuple(w[i : i + 3])].append(i)
    again = {j for at in tri.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def crc(text):
    return zlib.crc32((text or "").encode())
