import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from outboxlake.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in dict.fromkeys(items):
        if item is not None and text is not None:
            asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for doc, c in counted:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = 0
            for t, times in wanted.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, doc, -s) for k, (s, _, doc) in enumerate(found[:top])]
    return sorted(out)


def searched(spark, docs, items, top, segment_bytes=ranked.SEGMENT_BYTES):
    docs = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, term string, score int")
    items = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, segment string, rank int")
    return sorted(map(tuple, ranked.search(ranked.build(docs, segment_bytes), items, top).collect()))


WORDS = [f"w{k}" for k in range(40)] + ["É", "é", "日本", "Foo", "foo", "x" * 300]


def corpus(seed, n):
    rng = random.Random(seed)
    docs = [(k, " ,.".join(rng.choices(WORDS, weights=range(len(WORDS), 0, -1), k=rng.choice([0, 1, 3, 3, 20, 200])))) for k in range(n)]
    docs += [(3, docs[3][1]), (n, docs[5][1]), (n + 1, docs[5][1]), (None, docs[7][1]), (n + 2, None), (n + 3, "-- !"), (n + 4, "w1 " * 20000)]
    rng.shuffle(docs)
    items = [(k, " ".join(rng.choices(WORDS, k=rng.randrange(1, 12)))) for k in range(12)]
    items += [(1, "w1 w1 w2"), (2, items[2][1]), (None, "w1"), (50, None), (51, "unknown"), (52, "")]
    return docs, items


@pytest.mark.parametrize("segment_bytes", [200, 4000])
def test_every_score_of_a_plain_scan(spark, segment_bytes):
    docs, items = corpus(segment_bytes, 60)
    for top in (2, 20):
        assert searched(spark, docs, items, top, segment_bytes) == plain(docs, items, top)


def test_empty_tables(spark):
    docs, items = corpus(1, 10)
    assert searched(spark, [(1, None)], items, 20) == []
    assert searched(spark, docs, [(1, "")], 20) == []
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ranked.search(ranked.build(empty), empty.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(ranked, "ITEM_BLOCK", 3)
    monkeypatch.setattr(ranked, "BROADCAST_PAIRS", 0)
    docs, items = corpus(2, 40)
    assert searched(spark, docs, items, 4) == plain(docs, items, 4)


def test_strata_below_the_last_hit_are_skipped():
    rng = np.random.default_rng(1)
    n, entries, docs = 3000, [], []
    m = np.sort(rng.integers(75, 400, n))
    for _ in range(3):
        own = np.sort(rng.choice(n, 1500, replace=False))
        tf = rng.integers(1, 5, len(own))
        by = np.lexsort((tf, m[own]))
        own, tf = own[by], tf[by]
        new = np.flatnonzero(np.append(True, (m[own][1:] != m[own][:-1]) | (tf[1:] != tf[:-1])))
        entries.append(np.column_stack([m[own][new], tf[new], np.diff(np.append(new, len(own)))]).astype(np.int64).tobytes())
        docs.append(own.astype(np.int32).tobytes())
    segment = ranked.Segment(entries, docs, n)
    weights = np.array([3000, 100, 1])
    scores = np.zeros(n, np.int64)
    for t, w in enumerate(weights):
        part = slice(segment.at[t], segment.at[t + 1])
        np.add.at(scores, segment.doc[part], w * segment.impact[part])
    want = np.lexsort((np.arange(n), -scores))[:20]
    found, got = segment.best(np.arange(3), weights, 20)
    assert found.tolist() == want.tolist() and got.tolist() == scores[want].tolist()
