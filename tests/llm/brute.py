"""Plain versions of the operators for small inputs, written from their definitions."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text: str | None, width: int = 5) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def components(ids, links) -> dict:
    """Smallest id reachable, by union and find."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def near_classes(docs: list[tuple]) -> dict:
    """doc_id -> (n_shingles, component) by comparing every pair that shares a shingle."""
    sets = {i: shingle_set(t) for i, t in docs}
    holders: dict = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared: dict = {}
    for members in holders.values():
        for k, a in enumerate(members):
            for b in members[k + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    found = components(sets, links)
    return {i: (len(sets[i]), found[i]) for i in sets}


def repeated_bytes(docs: list[tuple], length: int = 50) -> dict:
    """doc_id -> (n_bytes, n_removed, n_spans, sha256 of the rest) by looking up every window."""
    first: dict = {}
    data = {i: (t or "").encode() for i, t in docs}
    for i in sorted(data):
        for k in range(len(data[i]) - length + 1):
            first.setdefault(data[i][k : k + length], i)
    out = {}
    for i, raw in data.items():
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out
