"""Plain single-machine versions of the contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(nodes, links):
    """Smallest node reachable, by node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def fingerprint(text, shingle=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def repeats(texts, window=200):
    """(n_bytes, n_removed, n_spans, kept_sha256) of every text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + window] for r in raw for i in range(len(r) - window + 1))
    out = []
    for r in raw:
        hit = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                hit[i : i + window] = True
        kept = bytes(b for b, h in zip(r, hit) if not h)
        spans = int((hit[:-1] & ~np.append(False, hit[:-2])).sum()) if len(r) else 0
        out.append((len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def targets(sizes, cap=3, weights=(5, 2, 1)):
    """Target by source: share the excess again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    share = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    done, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in done]
        left = total - sum(done.values())
        if not rest:
            return done
        given = {s: left * share[s] / sum(share[r] for r in rest) for s in rest}
        above = [s for s in rest if given[s] > cap * sizes[s]]
        if not above:
            return {**done, **given}
        done.update({s: float(cap * sizes[s]) for s in above})


def links(vectors, threshold):
    """(a, b) positions with equal labels and cosine of at least the threshold."""
    out = []
    for i, (_, x, la) in enumerate(vectors):
        for j in range(i):
            _, y, lb = vectors[j]
            if la is None or la != lb or not usable(x) or not usable(y) or len(x) != len(y):
                continue
            a, b = np.array(x, float), np.array(y, float)
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                out.append((i, j))
    return out


def usable(x):
    return bool(x) and all(c is not None and math.isfinite(c) for c in x) and any(x)


def crc(text):
    return zlib.crc32(text.encode())
