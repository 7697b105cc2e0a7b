"""Plain versions of the contracts, for comparison."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = WORD.findall(lowered(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def near_components(docs):
    """docs: (id, text). Returns id -> (size, component), comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    seen = set()
    for ids in by.values():
        for x in range(len(ids)):
            for y in range(x + 1, len(ids)):
                if (p := (ids[x], ids[y])) not in seen:
                    seen.add(p)
                    both = len(sets[p[0]] & sets[p[1]])
                    if 100 * both >= 75 * len(sets[p[0]] | sets[p[1]]):
                        a, b = sorted((root(p[0]), root(p[1])))
                        parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}
