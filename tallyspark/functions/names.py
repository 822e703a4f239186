"""Plain functions of single texts: accents and the likeness of names."""

from __future__ import annotations

import unicodedata


def fold(text: str) -> str:
    """Lower case in compatibility decomposition, without combining marks."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def ratio(a: str, b: str) -> float:
    return 200 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text to a piece of the longer one that is no longer than it."""
    a, b = sorted((a, b), key=len)
    if a in b:
        return 100.0 if a else 0.0
    pieces = {b[max(0, k) : k + len(a)] for k in range(1 - len(a), len(b))}
    best = max(ratio(a, p) for p in pieces)
    return best if len(a) < len(b) else max(best, *(ratio(b, a[max(0, k) : k + len(b)]) for k in range(1 - len(b), len(a))))


def token_ratio(a: str, b: str) -> float:
    """The best of sorted words, and of the common words against either side's with its own."""
    x, y = set(a.split()), set(b.split())
    both, own_a, own_b = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (own_a and own_b):
        return 100.0
    best = ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    lead = len(both) + bool(both)
    changed = len(own_a) + len(own_b) - 2 * _common(own_a, own_b)
    best = max(best, 100 * (1 - changed / (2 * lead + len(own_a) + len(own_b))))
    return max(best, *(100 * (1 - (1 + len(o)) / (len(both) + lead + len(o))) for o in (own_a, own_b))) if both else best


def partial_token_ratio(a: str, b: str) -> float:
    x, y = a.split(), b.split()
    return 100.0 if set(x) & set(y) else partial_ratio(" ".join(sorted(x)), " ".join(sorted(y)))


def weighted_ratio(a: str, b: str) -> float:
    """0 to 100: whole texts, their words, and pieces where one is half as long again as the other."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * token_ratio(a, b))
    scale = 0.9 if longer <= 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))
