"""Plain versions of the operators, for small tables."""

import hashlib
import re

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near(docs, k):
    """doc_id: (shingles, component) at a similarity of 0.8."""
    sets = {i: shingles(t, k) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    c = components(ids, links)
    return {i: (len(sets[i]), c[i]) for i in ids}


def repeats(docs, length=50):
    """doc_id: (bytes, removed, spans, sha256 of what stays)."""
    first = {}
    raw = [(i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, b in raw:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (n and gone[n - 1]) for n, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def water_fill(sizes, weights, epochs=3):
    """Targets by clamping and sharing anew until nothing is above its cap."""
    left, free, target = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total >= epochs * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = float(epochs * sizes[i])
        left -= sum(target[i] for i in over)
        free -= over
    return target
