"""Plain versions that several tests share."""

from __future__ import annotations

import itertools


def plain_pairs(rows, n, t):
    sets = []
    for i, text in rows:
        w = (text or "").lower().split()
        if w and i is not None:
            sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or {tuple(w)}))
    return {(min(i, j), max(i, j), len(a & b), len(a | b)) for (i, a), (j, b) in itertools.combinations(sets, 2) if i != j and len(a & b) >= t * len(a | b) - 1e-9}
