"""Brute-force counterparts of the operators, on plain Python data."""
import re
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contamination(docs, items, window=13):
    """``{doc: (n_words, n_hit, items)}`` for lists of (id, text)."""
    known = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            known[tuple(w[j:j + n])].add(str(i))
    sizes = {len(k) for k in known}
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                key = tuple(w[j:j + n])
                if key in known:
                    hit.update(range(j, j + n))
                    found |= known[key]
        out[i] = len(w), len(hit), sorted(found)
    return out


def shingles(text, k=5):
    w = words(text)
    if len(w) >= k:
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs, threshold=0.8):
    """``{doc: (n_links, component)}`` for a list of (id, text) with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    links = [(a, b) for a, b in combinations(sorted(sets), 2)
             if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold]
    n = Counter(x for ab in links for x in ab)
    root = roots(sets, links)
    return {i: (n[i], root[i]) for i in sets}
