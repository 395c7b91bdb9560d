"""Plain single-machine versions that the operators are compared with."""

import collections
import re

SPACE = " \t\n\x0b\x0c\r"


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))


def kept_lines(docs):
    """docs: (key, text) -> [(key, lines, kept lines)]; a key of None counts as the largest."""
    order = lambda k: (k is None, k or 0)
    holders = collections.defaultdict(set)
    for key, text in docs:
        for line in (text or "").split("\n"):
            k = low(line.strip(SPACE))
            if len(k) >= 10:
                holders[k].add(order(key))
    out = []
    for key, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(h := holders.get(low(x.strip(SPACE)), ())) < 2 or min(h) == order(key)]
        out.append((key, lines, kept))
    return out


def shingle_set(text, n):
    w = words(text)
    return frozenset(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near_components(docs, n=2, percent=80):
    """docs: {id: text} -> ({id: component}, {id: set size})."""
    sets = {i: shingle_set(t, n) for i, t in docs.items()}
    holders, parent = collections.defaultdict(list), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        common = collections.Counter(j for s in sets[i] for j in holders[s])
        for j, c in common.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}
