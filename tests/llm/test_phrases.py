import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from outboxlake.llm import bytescan as bs
from outboxlake.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, cover, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            ws = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(ws)
            for k in range(1, 5):
                f.update((lang or "und", *ws[i : i + k]) for i in range(len(ws) - k + 1))
    often = {g: a for g, a in f.items() if a >= least and len(g) > 2}
    longer = defaultdict(int)
    for g, a in often.items():
        for k in range(2, len(g) - 1):
            for i in range(1, len(g) - k + 1):
                longer[(g[0], *g[i : i + k])] = max(longer[(g[0], *g[i : i + k])], a)
    best = defaultdict(list)
    for g, a in often.items():
        if 100 * longer[g] >= cover * a:
            continue
        cuts = [(2000000 * a // (f[g[: k + 1]] + f[(g[0], *g[k + 1 :])]), k, f[g[: k + 1]], f[(g[0], *g[k + 1 :])]) for k in range(1, len(g) - 1)]
        score, _, l, r = min(cuts)
        best[g[0]].append((-score, -a, " ".join(g[1:]).encode(), l, r))
    out = []
    for lang, found in best.items():
        for k, (s, a, p, l, r) in enumerate(sorted(found)[:top]):
            out.append((lang, k + 1, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "A", "b", "ß", "É", "x(y)", "日", "\x85", "word", "w" * 300]
    texts = []
    for _ in range(150):
        texts.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", "!?"]) for _ in range(rng.choice([0, 1, 3, 30]))))
    passage = "one two three four five six seven"
    texts += [passage] * 7 + ["zero " + passage + " eight"] * 6 + ["a a a a a a a"] * 6 + [None, "", " .. "]
    rows = [(rng.choice(["en", "de", None, "und"]), t) for t in texts]
    return rows + rows[:40]


def found(spark, rows, least, cover, top):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, text string, words int, phrase string, size int")
    return sorted(map(tuple, phrases.collocations(docs, least, cover, top).collect()))


@pytest.mark.parametrize(("seed", "least", "cover", "top"), [(1, 5, 80, 2000), (2, 2, 50, 6)])
def test_same_as_counting_every_run(spark, seed, least, cover, top):
    rows = corpus(seed)
    assert found(spark, rows, least, cover, top) == plain(rows, least, cover, top)


def test_empty_tables(spark):
    assert found(spark, [("en", None)], 1, 80, 10) == []
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_paths_join_edges_that_nothing_leaves(spark):
    rows = [("en", "one two three four five six seven")] * 3 + [("en", "nine three four five ten")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    runs, totals = phrases.frequent_runs(docs, 1)
    got = sorted((" ".join(r.words), r.f) for r in phrases.paths(runs).collect())
    # The node "three four five" has a second edge on either side.
    assert got == [
        ("nine three four five", 1),
        ("one two three four five", 3),
        ("three four five six seven", 3),
        ("three four five ten", 1),
    ]
    assert totals.collect()[0].n == 26
    counts = {" ".join(r.words): r.f for r in runs.collect()}
    assert counts["three four five"] == 4 and counts["seven"] == 3 and counts["five six"] == 3


def test_words_of_equal_hash_stay_apart(monkeypatch):
    data = np.frombuffer(b"aa bb aa cc", np.uint8)
    start, end = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11])
    monkeypatch.setattr(bs, "word_codes", lambda d, s, e: np.zeros(len(s), np.uint64))
    words = phrases.Words(data, start, end)
    assert words.of.tolist() == [0, 1, 0, 2] and words.text(np.array([0, 1, 2])) == b"aa\nbb\ncc\n"
    monkeypatch.setattr(phrases, "_hashed", lambda g: np.zeros(len(g), np.uint64))
    grams, counts = phrases.combined(np.array([[1, 2], [0, 1], [1, 2]]), np.array([1, 1, 1]))
    assert grams.tolist() == [[0, 1], [1, 2]] and counts.tolist() == [1, 2]


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000
    rows = [("en", ["x"], big), ("en", ["y"], big), ("en", ["x", "y"], big - 1)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, words array<string>, f long")).collect()[0]
    assert got.score == 2000000 * (big - 1) // (2 * big)
