"""Plain single-process versions of the contracts, for small tables."""

import hashlib
import math
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def targets(docs):
    """{source: (size, target)}: shares 5, 2, 1 of 150% by code point, null last, stopped at twice the size."""
    size = {}
    for _, text, source in docs:
        size[source] = size.get(source, 0) + len(words(text))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    budget, free, target = 1.5 * sum(size.values()), set(names), {}
    while free:
        share = {s: budget * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in over}
        budget, free = budget - sum(2 * size[s] for s in over), free - over
    return {s: (size[s], target[s]) for s in names}


def near(docs, n=5, percent=85):
    """[(doc_id, shingles, component, kept)] with one row a document; ids are unique."""
    sets = {}
    for i, text in docs:
        w = words((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up, ids = {i: i for i in sets}, sorted(sets)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= percent * (len(x) + len(y) - common):
                    p, q = root(a), root(b)
                    up[max(p, q)] = min(p, q)
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def windows(docs, n=20):
    """[(doc_id, words, removed, sha256 of the kept words)]; ids are unique."""
    first, out = {}, []
    split = sorted((i, words(t)) for i, t in docs)
    for i, w in split:
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), (i, k))
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < (i, k):
                gone[k : k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def top(rows, modulus, k, score):
    """[(query_id, rank, vec_id, score)] of exact search; score(queries, all) gives a matrix."""
    ids = np.array([i for i, _ in rows])
    at = np.flatnonzero(ids % modulus == 0)
    scores = score(at)
    out = []
    for q, row in zip(at, scores, strict=True):
        order = [j for j in np.lexsort((ids, -row)) if ids[j] != ids[q]][:k]
        out += [(int(ids[q]), r + 1, int(ids[j]), row[j].item()) for r, j in enumerate(order)]
    return sorted(out)


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0
