"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return WORD.findall(text or "")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def kept_words(texts, window):
    """Words of each text that no repeated window covers."""
    ws = [words(t) for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for w in ws:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        out.append([x for j, x in enumerate(w) if j not in gone])
    return out


def grams(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(rows, k, threshold):
    """(class, links) of each (id, text), by all pairs."""
    sets = [grams(t, k) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold - 1e-12:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (no, _) in enumerate(rows):
        if no is not None:
            least[top(i)] = min(no, least.get(top(i), no))
    return [(least.get(top(i)), links[i]) for i in range(len(rows))]


def near(texts, items, within):
    """Ids of the items of which some passage has all terms at most `within` words apart, for each text."""
    out = []
    for w in map(terms, texts):
        spans = [set(w[i:i + within + 1]) for i in range(len(w))]
        found = set()
        for no, t in items:
            p = terms(t)
            n = min(within, len(p))
            if n and any(set(p[i:i + n]) <= s for i in range(len(p) - n + 1) for s in spans):
                found.add(no)
        out.append(sorted(str(x) for x in found if x is not None))
    return out


def contaminated(texts, items, window):
    """(n_words, n_hit, item ids) of each text."""
    passages = {}
    for no, t in items:
        w = terms(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            passages.setdefault(tuple(w[i:i + n]), set()).add(no)
    out = []
    for t in texts:
        w, hit, found = terms(t), set(), set()
        for n in {len(p) for p in passages}:
            for i in range(len(w) - n + 1):
                ids = passages.get(tuple(w[i:i + n]))
                if ids:
                    hit.update(range(i, i + n))
                    found |= ids
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def measures(text):
    w, t = words(text), text or ""
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if c[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def least_capacity(sizes, shards):
    """Smallest capacity for contiguous shards in which a larger group has a shard of its own."""
    def needed(c):
        n, room = 0, -1
        for s in sizes:
            if s > c:
                n, room = n + 1, -1
            elif room < s:
                n, room = n + 1, c - s
            else:
                room -= s
        return n
    c = 0
    while needed(c) > shards:
        c += 1
    return c
