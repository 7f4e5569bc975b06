import random
import zlib

import pytest
from pyspark.sql import functions as F

from outboxlake.llm import labelled, quality, toxicity

BAD = ["idiot", "scum", "trash"]


def _corpus(seed, n=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioubcdrst") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    docs, labels = [], []
    for d in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic, good = int(rng.random() < 0.4), int(rng.random() < 0.5)
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(BAD))
        if not good:
            at = rng.randrange(len(text))
            text[at:at] = [rng.choice(words)] * 30
        docs.append((d, " ".join(text), "en", 0.1, "z"))
        labels.append((d, good, toxic))
    return docs, labels


DOCS, LABELS = "doc_id long, text string, lang string, score double, predicted string", "doc_id long, quality int, toxic int"


@pytest.mark.parametrize(
    ("operator", "label", "parts", "part"), [(toxicity, "toxic", 3, 1), (quality, "quality", 4, 2)], ids=["toxicity", "quality"]
)
def test_held_out_accuracy_and_odd_rows(spark, operator, label, parts, part):
    docs, labels = _corpus(4)
    odd = [(900, None, "en", 0.0, ""), (901, "", "en", 0.0, ""), (None, "some words", None, None, None), (0, docs[0][1], "en", 0.0, "")]
    frame = spark.createDataFrame(docs + odd, DOCS).repartition(4)
    known = spark.createDataFrame([*labels, (0, None, None), (None, 1, 1), (77_777, 1, 1), labels[1], labels[1]], LABELS)
    model = operator.fit(frame, known)
    rows = operator.score(frame, model).withColumn("held_out", labelled.held_out(F.col("doc_id"), parts, part)).collect()
    assert len(rows) == len(docs) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    truth = {d: x[0 if label == "quality" else 1] for d, *x in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % parts == part}
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right >= 0.93 * len(held)
    assert [r.predicted for r in rows if r.doc_id in (900, 901)] == [0, 0]


@pytest.mark.parametrize("operator", [toxicity, quality], ids=["toxicity", "quality"])
def test_without_labels_or_rows(spark, operator):
    docs = spark.createDataFrame([(1, "a text", "en", 0.0, "")], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in operator.score(docs, operator.fit(docs, none)).collect()] == [0.5]
    assert operator.score(docs.limit(0), operator.fit(docs.limit(0), none)).collect() == []


def test_sample_is_bounded_and_leaves_the_held_out_rows(spark):
    docs, labels = _corpus(6)
    frame, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    rows = labelled.sample(frame, known, "toxic", 3, 1, class_rows=40).collect()
    assert len(rows) == 80
    small = labelled.sample(frame, known, "toxic", 3, 1, class_rows=40, sample_bytes=5000).collect()
    assert 0 < sum(len(r.text.encode()) for r in small) <= 5000
    texts = {t: d for d, t, *_ in docs}
    assert all(zlib.crc32(str(texts[r.text]).encode()) % 3 != 1 for r in rows)


def test_attention_gradients():
    import numpy as np

    rng = np.random.default_rng(0)
    x, start, y = rng.normal(size=(9, 5)), np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0])
    p = {k: rng.normal(size=(5, 3)) for k in "wvu"} | {k: rng.normal(size=3) for k in "bcdao"} | {"q": np.array(0.2)}
    loss = lambda: -np.mean(y * np.log(f := quality._forward(p, x, start)["y"]) + (1 - y) * np.log(1 - f))
    for name, g in quality._gradients(p, x, start, y).items():
        at = tuple(0 for _ in p[name].shape)
        old = p[name][at].copy()
        p[name][at] = old + 1e-6
        up = loss()
        p[name][at] = old - 1e-6
        down = loss()
        p[name][at] = old
        assert abs((up - down) / 2e-6 - g[at]) < 1e-6


def test_a_long_text_does_not_push_others_out(spark):
    rows = [(k, "word " * 10 + str(k)) for k in range(200)]
    known = spark.createDataFrame([(k, k % 2, k % 2) for k in range(200)], "doc_id long, quality int, toxic int")
    size = max(len(t) for _, t in rows)
    for long in range(200):
        if labelled.sample(spark.createDataFrame(rows[long : long + 1], "doc_id long, text string"), known, "toxic", 3, 1).count():
            break
    texts = [(k, t * 2000 if k == long else t) for k, t in rows]
    frame = spark.createDataFrame([*texts, (5, None), texts[7]], "doc_id long, text string")
    got = labelled.sample(frame, known, "toxic", 3, 1, sample_bytes=400 * size).collect()
    assert len(got) > 100 and max(len(r.text or "") for r in got) <= 2 * size
    assert {r.label for r in got} == {0, 1}
    # A class with nothing but long texts gives its smallest one.
    texts = [(k, t * (20 + k) if k % 2 else t) for k, t in rows]
    got = labelled.sample(spark.createDataFrame(texts, "doc_id long, text string"), known, "toxic", 3, 1, sample_bytes=10 * size).collect()
    assert sum(r.label for r in got) == 1 and len(got) > 2
