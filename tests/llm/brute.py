"""Plain single-machine versions to hold the operators against."""

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def shingles(text, size=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(docs, percent=80):
    sets = {d: shingles(t) for d, t in docs}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(sets, links)
    return {d: (len(sets[d]), comp[d]) for d in sets}


def overlaps(doc, item, least=13):
    """Whether some diagonal has a run of ``least`` words (or the whole item) with at most one substitution in five."""
    a, b = words(doc), words(item)
    need = min(least, len(b))
    if len(b) < 5:
        return False
    for d in range(-len(b) + 1, len(a)):
        same = [a[i + d] == b[i] for i in range(max(0, -d), min(len(b), len(a) - d))]
        for s in range(len(same)):
            wrong = 0
            for e in range(s, len(same)):
                wrong += not same[e]
                if e - s + 1 >= need and 5 * wrong <= e - s + 1:
                    return True
    return False
