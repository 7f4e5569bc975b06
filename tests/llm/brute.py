"""Plain versions of the operators for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from outboxlake.llm.components import Forest

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = _WORDS.findall((text or "").translate(_LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def classes(rows):
    """{doc_id: (n_shingles, component)} by comparing every pair."""
    sets, forest = {d: shingles(t) for d, t in rows}, Forest()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                forest.join(a, b)
    return {d: (len(sets[d]), forest.find(d)) for d in ids}


def repeated(rows):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], d), d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def snapshots(rows):
    """{kept conv_id: number of copies} of (conv_id, turn, role, text)."""
    turns = defaultdict(set)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].add((turn if turn is not None else -1, role or "", text or "", role, text))
    whole = {c: tuple(x[3:] for x in sorted(v, key=lambda x: x[:3])) for c, v in turns.items()}
    inner = {v[:k] for v in whole.values() for k in range(1, len(v))}
    groups = defaultdict(list)
    for conv, v in whole.items():
        if v not in inner:
            groups[v].append(conv)
    return {min(v): len(v) for v in groups.values()}
