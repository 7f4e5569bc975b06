"""Quality: attention-based multiple-instance learning over passages.

A text is a bag of passages of 40 words. Each is encoded by its shape (lengths, symbols,
digits, capitals, repeats, sentence ends) and signed sums of hashed words, so that every
word of a text counts and no text is cut. A hidden layer represents passages, a gated
attention (tanh times sigmoid) weighs them, and the weighted mean decides. Only document
labels are learnt from; the weights over passages come out of the training.

The network is fitted in one task on a bounded sample (see `labelled.sample`) and sent to
all tasks, some tens of KB; scoring is one pass without a shuffle. Null, empty and blank
texts have no passage and score 0. Without rows of both classes every other text scores
0.5. Columns of the input that clash with the added ones are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outboxlake.llm import bytescan as bs
from outboxlake.llm import labelled
from outboxlake.llm.store import prepare

PASSAGE = 40
HASHED = 32
HIDDEN = 16
THRESHOLD = 0.7
PARTS, PART = 4, 2
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.01, 1e-4

_CHARS = [chr(b) for b in range(128)]
_KINDS = np.zeros((6, 256), bool)
_KINDS[0, :128] = [c.isalpha() for c in _CHARS]
_KINDS[1, :128] = [c.isdigit() for c in _CHARS]
_KINDS[2, :128] = [c.isupper() for c in _CHARS]
_KINDS[3, :128] = [c.isprintable() and not c.isalnum() and c not in " .,;:!?'\"()-" for c in _CHARS]
_KINDS[4, 128:] = True
_KINDS[5, [ord(c) for c in ".!?"]] = True


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the text number of each (sorted)."""
    raw, at = bs.flat(texts)
    start, end, owner = bs.words(raw, at)
    if not len(start):
        return np.zeros((0, 12 + HASHED)), np.zeros(0, np.int64)
    code = bs.word_codes(bs.LOWER[raw], start, end)
    rank = np.arange(len(start)) - bs.group_starts(owner, len(at))[owner]
    first = np.flatnonzero(rank % PASSAGE == 0)
    n = np.diff(np.append(first, len(start))).astype(float)
    passage = np.repeat(np.arange(len(first)), n.astype(int))

    def total(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x.astype(float), first)

    size = total(end - start)
    columns = [np.log1p(n), size / n]
    letters = np.zeros(len(start), np.int64)
    for k in range(len(_KINDS)):
        sums = np.concatenate([[0], np.cumsum(_KINDS[k][raw])])
        per_word = sums[end] - sums[start]
        if k in (0, 1, 4):
            letters += per_word
        columns.append(total(per_word) / size if k < 5 else total(_KINDS[5][raw[end - 1]]) / n)
    columns.append(total(letters == 0) / n)
    again = np.append(False, (code[1:] == code[:-1]) & (passage[1:] == passage[:-1]))
    columns.append(total(again) / n)
    order = np.lexsort((code, passage))
    new = np.append(True, (code[order][1:] != code[order][:-1]) | (passage[order][1:] != passage[order][:-1]))
    columns.append(np.bincount(passage[order][new], minlength=len(first)) / n)
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    last = np.append(first[1:], len(start)) - 1
    columns.append((lines[end[last]] - lines[start[first]]) / n)
    signed = np.where(code >> np.uint64(63), 1.0, -1.0)
    column = (code >> np.uint64(8)).astype(np.int64) % HASHED
    sums = np.bincount(passage * HASHED + column, signed, len(first) * HASHED).reshape(-1, HASHED)
    return np.column_stack([*columns, sums / np.sqrt(n)[:, None]]), owner[first]


def _forward(p: dict, x: np.ndarray, start: np.ndarray) -> dict:
    """Bags are runs of rows that begin at `start`."""
    h = np.tanh(x @ p["w"] + p["b"])
    g, s = np.tanh(x @ p["v"] + p["c"]), 1 / (1 + np.exp(-np.clip(x @ p["u"] + p["d"], -30, 30)))
    e = (g * s) @ p["a"]
    n = np.diff(np.append(start, len(x)))
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), n))
    weight = e / np.repeat(np.add.reduceat(e, start), n)
    z = np.add.reduceat(weight[:, None] * h, start)
    y = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["q"], -30, 30)))
    return {"h": h, "g": g, "s": s, "weight": weight, "z": z, "y": y, "n": n}


def _gradients(p: dict, x: np.ndarray, start: np.ndarray, labels: np.ndarray) -> dict:
    f = _forward(p, x, start)
    dy = (f["y"] - labels) / len(labels)
    dz = dy[:, None] * p["o"]
    dz_row = np.repeat(dz, f["n"], axis=0)
    dweight = (dz_row * f["h"]).sum(1)
    mean = np.repeat(np.add.reduceat(f["weight"] * dweight, start), f["n"])
    de = f["weight"] * (dweight - mean)
    dg = de[:, None] * p["a"] * f["s"] * (1 - f["g"] ** 2)
    ds = de[:, None] * p["a"] * f["g"] * f["s"] * (1 - f["s"])
    dh = f["weight"][:, None] * dz_row * (1 - f["h"] ** 2)
    return {
        "w": x.T @ dh, "b": dh.sum(0), "v": x.T @ dg, "c": dg.sum(0), "u": x.T @ ds, "d": ds.sum(0),
        "a": ((f["g"] * f["s"]) * de[:, None]).sum(0), "o": f["z"].T @ dy, "q": np.array(dy.sum()),
    }


def train(bags: list[np.ndarray], labels: np.ndarray) -> dict | None:
    """Adam on the log loss; None without both classes."""
    keep = [k for k, bag in enumerate(bags) if len(bag)]
    bags, labels = [bags[k] for k in keep], labels[keep].astype(float)
    if len(set(labels.tolist())) < 2:
        return None
    every = np.concatenate(bags)
    mean, deviation = every.mean(0), every.std(0) + 1e-6
    bags = [np.clip((bag - mean) / deviation, -8, 8) for bag in bags]
    rng = np.random.default_rng(3)
    dim = every.shape[1]
    scale = 1 / np.sqrt(dim)
    p = {name: rng.normal(0, scale, (dim, HIDDEN)) for name in "wvu"} | {name: np.zeros(HIDDEN) for name in "bcd"}
    p |= {"a": rng.normal(0, 0.3, HIDDEN), "o": rng.normal(0, 0.3, HIDDEN), "q": np.zeros(())}
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            sizes = [len(bags[k]) for k in some]
            grads = _gradients(p, np.concatenate([bags[k] for k in some]), np.cumsum([0, *sizes[:-1]]), labels[some])
            step += 1
            for k, g in grads.items():
                g = g + DECAY * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return p | {"mean": mean, "deviation": deviation}


def predict(model: dict | None, x: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Score of each text, and the weight of each passage in its text."""
    out, weights = np.zeros(n), np.zeros(len(x))
    if len(x):
        texts, start = np.unique(owner, return_index=True)
        if model is None:
            out[texts] = 0.5
        else:
            x = np.clip((x - model["mean"]) / model["deviation"], -8, 8)
            found = _forward(model, x, start)
            out[texts], weights = found["y"], found["weight"]
    return out, weights


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("label", pa.int32()), ("bag", pa.binary())])
    for piece in bs.pieces(batches):
        x, owner = encode(piece.column("text"))
        cut = bs.group_starts(owner, piece.num_rows)
        bags = [bs.packed(x[a:b].astype(np.float32)) for a, b in zip(cut, cut[1:], strict=False)]
        yield bs.batch_of(schema, piece.column("key").to_pylist(), piece.column("label").to_pylist(), bags)


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["key", "label"], kind="stable")
    bags = [np.frombuffer(b, np.float32).reshape(-1, 12 + HASHED).astype(float) for b in pdf["bag"]]
    return pd.DataFrame({"model": [pickle.dumps(train(bags, pdf["label"].to_numpy()))]})


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Learns `labels.quality` from the sampled rows."""
    rows = labelled.sample(docs, labels, "quality", PARTS, PART).mapInArrow(_bags, "key long, label int, bag binary")
    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_fit, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in bs.pieces(batches):
            x, owner = encode(piece.column("text"))
            p, weights = predict(model.value, x, owner, piece.num_rows)
            top = np.zeros(piece.num_rows)
            np.maximum.at(top, owner, weights)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(top)],
                names=[*piece.schema.names, "score", "predicted", "top_weight"],
            )

    return score


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """All rows and columns of `docs`, with score, predicted and the largest passage weight."""
    spark = prepare(docs.sparkSession)
    docs = docs.drop("score", "predicted", "top_weight")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    schema = ", ".join([*fields, "score double, predicted int, top_weight double"])
    return docs.mapInArrow(_scorer(spark.sparkContext.broadcast(model)), schema)
