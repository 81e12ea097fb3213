"""Operators of the subpackage by definition, in plain Python."""

import re

WORD = re.compile(r"(?:[0-9a-z]|[^\x00-\x7F])+")


def words(text):
    return WORD.findall((text or "").lower())


def shared_runs(a, b, least):
    """Maximal runs of equal words on each diagonal: (start in a, end in a, start in b, end in b)."""
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and (i == 0 or j == 0 or a[i - 1] != b[j - 1]):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n >= least:
                    out.add((i, i + n, j, j + n))
    return out


def maximal_repeats(docs, least):
    """Rows (length, occurrences, id, start, end) of maximal repeats of (id, text) pairs, each with all its places."""
    from collections import defaultdict

    texts = [(i, words(t)) for i, t in docs]
    found = defaultdict(set)
    for d, (_, w) in enumerate(texts):
        for a in range(len(w)):
            for b in range(a + least, len(w) + 1):
                found[tuple(w[a:b])].add((d, a))
    out = set()
    for s, places in found.items():
        n = len(s)
        if len(places) < 2:
            continue
        left = {texts[d][1][a - 1] if a else (d,) for d, a in places}
        right = {texts[d][1][a + n] if a + n < len(texts[d][1]) else (d,) for d, a in places}
        if len(left) < 2 or len(right) < 2:
            continue
        out |= {(n, len(places), texts[d][0], a, a + n) for d, a in places}
    return out


def components(pairs):
    """Least member of each node's component."""
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def cross_parse(text, sample, segment):
    """Phrases of ``text`` (bytes) against ``sample``: longest matches, which end with an unknown byte that breaks them."""
    count = 0
    for base in range(0, len(text), segment):
        part, i = text[base : base + segment], 0
        while i < len(part):
            n = 0
            while i + n < len(part) and part[i : i + n + 1] in sample:
                n += 1
            if i + n < len(part) and part[i + n : i + n + 1] not in sample:
                n += 1
            count += 1
            i += n
    return count


def best_subset(lengths, counts, target):
    """Largest sum up to ``target``."""
    reach = {0}
    for n, c in zip(lengths, counts):
        reach = {r + n * k for r in reach for k in range(c + 1) if r + n * k <= target}
    return max(reach)
