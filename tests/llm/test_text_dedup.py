import random

import numpy as np

from outboxlake.llm import jaccard, suffixes
from outboxlake.llm.components import components
from outboxlake.llm.jaccard import shingle_classes
from outboxlake.llm.suffixes import repeated_strings

from . import brute

DDL = "doc_id long, text string, block string, score double"


def _texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    shared = " ".join(rng.choice(words) for _ in range(60))
    base = [[rng.choice(words) for _ in range(rng.randint(3, 90))] for _ in range(n // 4)]
    out = []
    for _ in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append(" ".join(text) + (" " + shared if rng.random() < 0.3 else ""))
    return [*out, None, "", " \n\t", "One two", "one TWO", "one two three", "a" * 300, "x " * 20_000]


def _frame(spark, texts, seed=1):
    ids = random.Random(seed).sample(range(10 * len(texts)), len(texts))
    rows = list(zip(ids, texts, strict=True))
    return rows, spark.createDataFrame([(d, t, "b", 0.5) for d, t in rows], DDL).repartition(5)


def test_classes_match_brute_force(spark):
    rows, docs = _frame(spark, _texts(5, 160))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_classes(docs).collect()}
    assert got == brute.classes(rows)


def test_classes_of_many_near_copies(spark):
    """More members than a chunk holds, many of them not linked to the smallest one."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(320):
        text = list(base)
        for k in rng.sample(range(120), rng.randint(0, 7)):
            text[k] = f"u{rng.randrange(10**9)}"
        texts.append(" ".join(text))
    rows, docs = _frame(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_classes(docs).collect()}
    assert got == brute.classes(rows)


def _cut_texts(rng, n):
    """Texts of many lengths from a few bases that share a passage, some words replaced."""
    passage = [f"p{k}" for k in range(30)]
    bases = [passage + [f"b{b}w{k}" for k in range(370)] for b in range(5)]
    out = []
    for _ in range(n):
        text = rng.choice(bases)[: rng.randint(8, 400)]
        for _ in range(rng.choice([0, 0, 1, 3, 6])):
            text[rng.randrange(len(text))] = f"u{rng.randrange(50)}"
        out.append(" ".join(text))
    return out


def test_classes_across_sizes_and_chunks(spark, monkeypatch):
    """Links cross the sizes at which cells meet, and cells are split into several chunks."""
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    rows, docs = _frame(spark, _cut_texts(random.Random(4), 260))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_classes(docs).collect()}
    assert got == brute.classes(rows)


def test_sets_of_long_texts_with_a_common_passage_stay(spark, monkeypatch):
    """Sets are built for texts that a bound leaves with a partner, not for all that share shingles."""
    rng, made = random.Random(6), []

    def stored(df, label):
        out = write(df, label)
        if label == "sets":
            made.extend(r.doc_id for r in out.collect())
        return out

    write = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", stored)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for _ in range(8):
        passage = fresh(2400)
        texts += [" ".join(passage + fresh(3600)) for _ in range(2)]
    base = fresh(6000)
    texts += [" ".join(base), " ".join(base[:3000] + fresh(200) + base[3200:])]
    rows, docs = _frame(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_classes(docs).collect()}
    assert got == brute.classes(rows)
    assert sorted(made) == sorted(d for d, _ in rows[-2:])


def test_classes_of_odd_tables(spark):
    assert shingle_classes(spark.createDataFrame([], DDL)).collect() == []
    rows = [(1, "a b c d e f", "", 0.0), (1, "a b c d e f", "", 0.0), (None, "a b c d e f", "", 0.0), (2, None, "", 0.0)]
    got = [tuple(r) for r in shingle_classes(spark.createDataFrame(rows, DDL)).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 0, 2)], key=str)


def test_repeated_strings_match_brute_force(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdé ") for _ in range(400))
    texts = []
    for _ in range(120):
        text = ""
        for _ in range(rng.randint(0, 6)):
            a = rng.randint(0, 399)
            fresh = "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 80)))
            text += base[a : a + rng.randint(1, 120)] if rng.random() < 0.6 else fresh
        texts.append(text)
    rows, docs = _frame(spark, [*texts, None, "", "a" * 300, "a" * 120, "a" * 49 + "b", base, base, "y" * 50_000])
    got = {r.doc_id: tuple(r)[1:5] for r in repeated_strings(docs).collect()}
    assert got == brute.repeated(rows)


def test_texts_that_share_a_middle_are_kept(spark):
    # Any two of these differ in every 50-byte string; only 20 bytes in the middle are common.
    rng = random.Random(9)
    letters = "abcdefghijklmnop"
    rows = [(k, "".join(rng.choices(letters, k=15)) + "x" * 20 + "".join(rng.choices(letters, k=15))) for k in range(150_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeated_strings(docs).where("n_removed > 0").count() == 0


def test_strings_of_equal_hash_are_told_apart(monkeypatch):
    rng = random.Random(3)
    context = np.array([[rng.choice(b"ab") for _ in range(80)] for _ in range(40)], np.uint8)
    context[:, 30:] = context[0, 30:]
    ranges, low = np.tile(np.array([0, 30], np.uint8), (40, 1)), np.arange(40)
    want = {}
    for i in range(40):
        for d in range(31):
            least = min(j for j in range(40) if (context[j, 30 - d : 80 - d] == context[i, 30 - d : 80 - d]).all())
            if least < i:
                want.setdefault((i, least), set()).add(d)
    for blind in (False, True):
        if blind:
            monkeypatch.setattr(suffixes.bs, "mix", lambda x: np.zeros_like(x))
        got = {}
        for row, mask, least in zip(*suffixes.smallest_ids(context, ranges, low), strict=True):
            got.setdefault((int(row), int(least)), set()).update(d for d in range(31) if int(mask) >> d & 1)
        assert got == want


def test_repeated_strings_of_odd_tables(spark):
    assert repeated_strings(spark.createDataFrame([], DDL)).collect() == []
    text = "0123456789" * 6
    rows = [(7, text, "", 0.0), (7, text, "", 0.0), (9, "x" + text, "", 0.0), (None, text, "", 0.0)]
    got = [(r.doc_id, r.n_removed) for r in repeated_strings(spark.createDataFrame(rows, DDL)).collect()]
    assert sorted(got, key=str) == sorted([(7, 0), (7, 0), (9, 60), (None, 60)], key=str)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(300, 400)] + [(8, 8), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {5: 5} | {k: 5 for k in range(300, 400)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
