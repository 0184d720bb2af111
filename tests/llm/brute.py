"""Plain versions of the text operators for small tables."""

from __future__ import annotations

import collections
import hashlib
import re

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def order(doc_id):
    return float("inf") if doc_id is None else doc_id


def word_runs(docs, run=50):
    """[(doc_id, n_words, n_removed, sha)] in the order of ``docs``."""
    words = [WORDS.findall((t or "").encode()) for _, t in docs]
    first: dict = {}
    for (d, _), w in zip(docs, words, strict=True):
        for i in range(len(w) - run + 1):
            k = tuple(w[i:i + run])
            first[k] = min(first.get(k, float("inf")), order(d))
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - run + 1):
            if first[tuple(w[i:i + run])] < order(d):
                gone[i:i + run] = [True] * run
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def byte_runs(docs, run=50):
    """[(doc_id, n_bytes, n_removed, n_spans, sha)] in the order of ``docs``."""
    texts, first = [(t or "").encode() for _, t in docs], {}
    for (d, _), b in zip(docs, texts, strict=True):
        for i in range(len(b) - run + 1):
            k = b[i:i + run]
            first[k] = min(first.get(k, float("inf")), order(d))
    out = []
    for (d, _), b in zip(docs, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - run + 1):
            if first[b[i:i + run]] < order(d):
                gone[i:i + run] = b"\1" * run
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text, n):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in WORDS.findall((text or "").encode())]
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def linked_rows(docs, n=4, percent=85):
    """Sets of the rows, and the smallest row that each is linked with over any number of links."""
    sets = [shingles(t, n) for _, t in docs]
    holders = collections.defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].add(i)
    links = []
    for i, s in enumerate(sets):
        for j, both in collections.Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                links.append((i, j))
    return sets, roots(range(len(docs)), links)


def jaccard(docs, n=4, percent=85):
    """[(doc_id, size, component)] in the order of ``docs``; rows are nodes."""
    sets, root = linked_rows(docs, n, percent)
    least: dict = {}
    for i, (d, _) in enumerate(docs):
        least[root[i]] = min(least.get(root[i], float("inf")), order(d))
    return [(d, len(s), None if least[root[i]] == float("inf") else least[root[i]])
            for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]
