"""Plain versions of the operators, over small tables in one process."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import xxhash


def words(text):
    return (text or "").encode().split()


def repeats(rows, window=50):
    """doc_id -> (n_words, n_removed, sha256 of the kept words); rows of (doc_id, text) with distinct ids."""
    first = {}
    tokens = {d: words(t) for d, t in rows}
    for d, w in tokens.items():
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, w in tokens.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def simhash(text):
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    w = (text or "").encode().translate(table).split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, distance=2):
    """id -> smallest id reachable over fingerprints within `distance` bits."""
    parent = {p: p for p in set(prints.values())}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = sorted(parent)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    least = defaultdict(lambda: 1 << 62)
    for d, p in prints.items():
        least[root(p)] = min(least[root(p)], d)
    return {d: least[root(p)] for d, p in prints.items()}


def substring_distance(item, text):
    """Least edits between `item` and any part of `text`."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        above, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(above[j - 1] + (c != d), above[j] + 1, row[j - 1] + 1))
    return min(row)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        above, row = row, [i]
        for j, d in enumerate(b, 1):
            row.append(min(above[j - 1] + (c != d), above[j] + 1, row[j - 1] + 1))
    return row[-1]


def similar_groups(texts, size=5):
    """id -> smallest id reachable over texts whose sets of `size`-word runs have a Jaccard similarity of at least 0.8."""
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().translate(table).split()
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: root(d) for d in ids}
