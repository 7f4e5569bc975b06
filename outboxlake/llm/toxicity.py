"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, word pairs and pairs with one or two words left
out between them, each hashed to 40 bits; a feature is present or not, so length does not
scale a score. Per-coordinate rates and the L1 term leave weights only on features that
decide, a compact table that is sent to all tasks.

The model is fitted on a bounded sample (see `labelled.sample`) in one task; scoring is one
pass over all whole texts without a shuffle. Null or empty texts get the score of the bias
alone. Without rows of both classes the model is empty and every score is 0.5. Columns of
the input that clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outboxlake.llm import bytescan as bs
from outboxlake.llm import labelled
from outboxlake.llm.store import prepare

THRESHOLD = 0.7
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
EPOCHS = 6
SKIPS = (1, 2, 3)
PARTS, PART = 3, 1
_BITS = np.uint64((1 << 40) - 1)

#: Everything in ASCII but letters and digits parts words.
BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.bias)
        if len(self.keys) and len(hashes):
            table = np.zeros(1 << 16, bool)
            table[self.keys & np.uint64(0xFFFF)] = True
            near = np.flatnonzero(table[hashes & np.uint64(0xFFFF)])
            at = np.minimum(np.searchsorted(self.keys, hashes[near]), len(self.keys) - 1)
            hit = self.keys[at] == hashes[near]
            pairs = np.unique(owner[near][hit] * len(self.keys) + at[hit])
            np.add.at(out, pairs // len(self.keys), self.weights[pairs % len(self.keys)])
        return out


def features(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """40-bit feature hashes, with repeats, and the text number of each."""
    data, at = bs.flat(piece.column("text"))
    data = bs.LOWER[data]
    start, end, owner = bs.words(data, at, BREAKS)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = bs.word_codes(data, start, end)
    hashes, owners = [code & _BITS], [owner]
    for skip in SKIPS:
        if len(code) > skip:
            same = owner[skip:] == owner[:-skip]
            pair = bs.mix(code[:-skip] * bs._STEPS[2 * skip] + code[skip:] * bs._STEPS[2 * skip + 1])
            hashes.append(pair[same] & _BITS)
            owners.append(owner[skip:][same])
    return np.concatenate(hashes), np.concatenate(owners)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("label", pa.int32()), ("features", pa.binary())])
    for piece in bs.pieces(batches):
        hashes, owner = features(piece)
        order = np.argsort(owner, kind="stable")
        cut = bs.group_starts(owner[order], piece.num_rows)
        hashes = hashes[order]
        rows = [bs.packed(np.unique(hashes[a:b])) for a, b in zip(cut, cut[1:], strict=False)]
        yield bs.batch_of(schema, piece.column("key").to_pylist(), piece.column("label").to_pylist(), rows)


def ftrl(examples: list[np.ndarray], labels: np.ndarray) -> Model:
    """Examples are sets of feature hashes; features of a single example are left out."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    keys, n = np.unique(np.concatenate(examples), return_counts=True)
    keys = keys[n > 1]
    index = []
    for x in examples:
        at = np.searchsorted(keys, x)
        hit = keys[np.minimum(at, len(keys) - 1)] == x if len(keys) else np.zeros(len(x), bool)
        index.append(np.append(at[hit] + 1, 0))
    z, n = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    l1 = np.full(len(keys) + 1, L1)
    l1[0] = 0.0  # the bias is not shrunk

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= l1[i], 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(examples)):
            i = index[k]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - step * w
            n[i] += g * g
    w = weights(np.arange(len(z)))
    kept = np.flatnonzero(w[1:])
    return Model(keys[kept], w[1:][kept], float(w[0]))


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["key", "label"], kind="stable")
    model = ftrl([np.frombuffer(x, np.uint64) for x in pdf["features"]], pdf["label"].to_numpy())
    return pd.DataFrame({"keys": [bs.packed(model.keys)], "weights": [bs.packed(model.weights)], "bias": [model.bias]})


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns `labels.toxic` from the sampled rows; only the few weights come to the driver."""
    rows = labelled.sample(docs, labels, "toxic", PARTS, PART)
    rows = rows.mapInArrow(_distinct, "key long, label int, features binary")
    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_fit, "keys binary, weights binary, bias double").collect()
    if not found:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    return Model(np.frombuffer(found[0]["keys"], np.uint64), np.frombuffer(found[0]["weights"]), found[0]["bias"])


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in bs.pieces(batches):
            hashes, owner = features(piece)
            p = 1 / (1 + np.exp(-np.clip(model.value.logits(hashes, owner, piece.num_rows), -700, 700)))
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
                names=[*piece.schema.names, "score", "predicted"],
            )

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of `docs`, with score (0 to 1) and predicted (0 or 1)."""
    spark = prepare(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    fields = [*docs.schema.fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double, predicted int"])
    return docs.mapInArrow(_scorer(spark.sparkContext.broadcast(model)), schema)
