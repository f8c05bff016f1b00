"""Plain, slow versions of the operators, for small tables."""

import re
from collections import Counter, defaultdict


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall("[^\x20\x09-\x0d]+", text)


def shingles(text, k):
    w = words(text, lower=True)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(rows, k, percent):
    """{id: (set size, least id reachable)} of (id, text) rows."""
    sets = {d: shingles(t, k) for d, t in rows}
    holders, parent = defaultdict(list), {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d, s in sets.items():
        common = Counter(e for x in s for e in holders[x] if e > d)
        for e, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def without_repeats(rows, length=13):
    """{id: (words, removed, kept words)}."""
    lists, first = {d: words(t) for d, t in rows}, {}
    for d in sorted(lists):
        for i in range(len(lists[d]) - length + 1):
            first.setdefault(tuple(lists[d][i : i + length]), d)
    out = {}
    for d, w in lists.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out[d] = (len(w), sum(gone), [x for x, g in zip(w, gone) if not g])
    return out
