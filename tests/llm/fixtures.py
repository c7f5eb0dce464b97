"""Small tables and brute-force versions for the training-data operators."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

SPACE = r"[^\x20\x09-\x0D]+"


def prose(rng: random.Random, n: int, vocab: int = 5000) -> str:
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    """Null ids and texts, empty, blank, long, one-character, repeated and equal texts."""
    rng = random.Random(3)
    long = prose(rng, 30_000)
    return [
        (1, None), (2, ""), (3, "  \n\t "), (4, "x"), (5, long), (6, long), (7, "one two"), (8, "One  TWO"),
        (None, "one two"), (None, None), (9, "ü" * 5000), (10, "!!! ***"), (11, "a b c"), (11, "a b c"),
        (11, "d e f"), (-5, "naïve Ünïcode 日本語 😀 ▁ text."), (2**62, "0 1 2 3"),
    ]


def odd_frame(spark, rows=None):
    """The odd rows with further columns whose names operators use themselves."""
    rows = odd_rows() if rows is None else rows
    full = [(i, t, None, "s", None if t is None else len(t), 1, "k", [1], 2, 3, "p", None) for i, t in rows]
    return spark.createDataFrame(
        full, "doc_id long, text string, lang string, source string, n_chars long, n long, key string, "
              "ids array<int>, cid long, pos int, base string, spans string")


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingles(t, k):
    w = re.findall(SPACE, lower(t or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard_components(rows, k, num, den):
    """(doc_id, set size, smallest doc_id reachable) by comparing all pairs that share a shingle."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for a, s in enumerate(sets):
        shared = Counter(b for g in s for b in holders[g] if b < a)
        for b, n in shared.items():
            if den * n >= num * (len(s) + len(sets[b]) - n):
                parent[find(a)] = find(b)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        known = [x for x in (least.get(r), d) if x is not None]
        least[r] = min(known) if known else None
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def repeated_words(rows, m=50):
    """Words of each document that stand in an m-word run of another document."""
    holders, texts = defaultdict(set), {}
    for d, t in rows:
        w = texts[d] = re.findall(SPACE, t or "")
        for j in range(len(w) - m + 1):
            holders[tuple(w[j:j + m])].add(d)
    out = {}
    for d, w in texts.items():
        cover = {x for j in range(len(w) - m + 1) if len(holders[tuple(w[j:j + m])]) > 1 for x in range(j, j + m)}
        if cover:
            out[d] = cover
    return out
