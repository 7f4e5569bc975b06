"""Embedding near-dedup: cross-polytope hashing with multiprobe and verified pairs.

Vectors link when their cosine, in double precision, is at least 0.95. Each table rotates
the vectors by three rounds of random signs and a fast Hadamard transform; the largest
coordinate with its sign is a vertex of the cross-polytope, and `vertices` of them make a
bucket. A vector lies in its home bucket and also visits the buckets next to it: those in
which its closest call among the vertices went the other way. A pair is found when one of
the two lies where the other one lies or visits.

The number of vertices per bucket grows with the logarithm of the vectors, so that buckets
keep their size, and the number of tables with the vertices, so that recall keeps: it is
set from random pairs of cosine 0.95, to find `RECALL` of them. Vectors are hashed and
compared by their length; only equal lengths share buckets. Equal vectors are one row with a weight. Only keys are shuffled first;
vectors travel to buckets of two and more. Large buckets are cut into chunks whose pairs
are compared block by block with a matrix product; a task returns a count of links and a
spanning forest per chunk pair, never its pairs. A pair that meets in several buckets
counts in the first one only.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing,
and vectors of different lengths not with each other. Rows with a null id are returned with a null component. A
repeated id is one vector for the components and several for the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outboxlake.llm import bytescan as bs
from outboxlake.llm.components import Forest, components
from outboxlake.llm.store import prepare, stored

COSINE = 0.95
#: Tables at least; more where pairs of cosine 0.95 would be found with less than `RECALL`.
TABLES = 8
RECALL = 0.98
#: Random pairs that the share found by one table is taken from, in each of `TABLES` tables.
PAIRS = 256
PROBES = 3
ROUNDS = 3
CHUNK = 1024
#: Buckets of up to so many members share a task's group.
SMALL = 256
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row, of a power of two columns, scaled to keep lengths."""
    n, width = x.shape[1], 1
    while width < n:
        x = x.reshape(len(x), -1, 2, width)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        width *= 2
    return x / math.sqrt(n)


def signs(dim: int, vertices: int, tables: int = TABLES) -> np.ndarray:
    """Random signs for every table, vertex and round."""
    size = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng(SEED).choice([-1.0, 1.0], (tables, vertices, ROUNDS, size))


def vertices_for(dim: int, n: int) -> int:
    """Vertices per bucket that keep buckets of n vectors small."""
    per_vertex = math.log2(2 << max(1, (dim - 1).bit_length()))
    return max(1, math.ceil((math.log2(max(n, 2)) - 1) / per_vertex))


def tables_for(dim: int, vertices: int) -> int:
    """Tables that find a pair of cosine `COSINE` with a probability of `RECALL`."""
    if dim == 1:
        return TABLES
    rng = np.random.default_rng(SEED + 1)
    a, b = _unit(rng.normal(size=(PAIRS, dim))), rng.normal(size=(PAIRS, dim))
    b = _unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    flips = signs(dim, vertices)
    (home_a, visit_a), (home_b, visit_b) = hashed(a, flips), hashed(COSINE * a + math.sqrt(1 - COSINE**2) * b, flips)
    meets = (home_a == home_b) | (visit_a == home_b[:, :, None]).any(axis=2) | (visit_b == home_a[:, :, None]).any(axis=2)
    missed = 1 - min(max(meets.mean(), 1e-3), 1 - 1e-9)
    return max(TABLES, math.ceil(math.log(1 - RECALL) / math.log(missed)))


@lru_cache(maxsize=32)
def flips_for(dim: int, n: int) -> np.ndarray:
    """The signs for vectors of this length in a table of n; the same in every task."""
    vertices = vertices_for(dim, n)
    return signs(dim, vertices, tables_for(dim, vertices))


def hashed(x: np.ndarray, flips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home bucket (n, tables) and visited buckets (n, tables, probes) of unit vectors."""
    n, size = len(x), flips.shape[-1]
    padded = np.zeros((n, size))
    padded[:, : x.shape[1]] = x
    tables, vertices = flips.shape[:2]
    home = np.zeros((n, tables), np.uint64)
    visits = np.zeros((n, tables, PROBES), np.uint64)
    for t in range(tables):
        codes, others, calls = [], [], []
        for v in range(vertices):
            y = padded
            for r in range(flips.shape[2]):
                y = hadamard(y * flips[t, v, r])
            both = np.concatenate([y, -y], axis=1)
            top = np.argpartition(-both, PROBES, axis=1)[:, : PROBES + 1]
            value = np.take_along_axis(both, top, 1)
            order = np.argsort(-value, axis=1, kind="stable")
            top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
            codes.append(top[:, 0])
            others.append(top[:, 1:])
            calls.append(value[:, :1] - value[:, 1:])
        code = np.stack(codes, 1).astype(np.uint64)
        home[:, t] = _key(code, t, x.shape[1])
        # The closest calls over all vertices of the bucket, one vertex changed at a time.
        gaps = np.concatenate(calls, 1)
        best = np.argpartition(gaps, PROBES - 1, axis=1)[:, :PROBES]
        for p in range(PROBES):
            vertex, other = best[:, p] // PROBES, best[:, p] % PROBES
            changed = code.copy()
            rows = np.arange(n)
            changed[rows, vertex] = np.stack(others, 1)[rows, vertex, other].astype(np.uint64)
            visits[:, t, p] = _key(changed, t, x.shape[1])
    return home, visits


def _key(code: np.ndarray, table: int, dim: int) -> np.ndarray:
    key = np.full(len(code), (dim << 24) + table + 1, np.uint64)
    for v in range(code.shape[1]):
        key = bs.mix(key * np.uint64(0x9E3779B97F4A7C15) + code[:, v] + np.uint64(1))
    return key


def _matrix(values: list, kind: str) -> np.ndarray:
    """Packed singles or doubles of one length as doubles."""
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64)


def _by_length(values: list) -> Iterator[np.ndarray]:
    """Places of the values of each length."""
    size = np.fromiter(map(len, values), np.int64, len(values))
    for one in np.unique(size):
        yield np.flatnonzero(size == one)


_CLEAN = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary())])


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as packed singles or doubles; null where a vector cannot link."""
    for batch in batches:
        out = []
        kind = np.float32 if pa.types.is_float32(batch.schema.field("embedding").type.value_type) else np.float64
        for values in batch.column("embedding"):
            packed = None
            if values.is_valid and len(values.values) and not values.values.null_count:
                x = values.values.to_numpy(zero_copy_only=False).astype(kind)
                if np.isfinite(x).all() and x.any():
                    packed = bs.packed(x + kind(0))  # no negative zeros
            out.append(packed)
        yield bs.batch_of(_CLEAN, batch.column("vec_id").to_pylist(), out)


_KEYS_DDL = "rep long, bucket long, home boolean"


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(n: int, kind: str):
    schema = pa.schema([("rep", pa.int64()), ("bucket", pa.int64()), ("home", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, reps = batch.column("vector").to_pylist(), batch.column("rep").to_numpy()
            for at in _by_length(vectors):
                x = _unit(_matrix([vectors[i] for i in at], kind))
                home, visits = hashed(x, flips_for(x.shape[1], n))
                ids = reps[at]
                yield bs.batch_of(schema, np.repeat(ids, home.shape[1]), home.ravel().astype(np.int64), np.ones(home.size, bool))
                per = visits.shape[1] * visits.shape[2]
                yield bs.batch_of(schema, np.repeat(ids, per), visits.ravel().astype(np.int64), np.zeros(visits.size, bool))

    return run


_FOUND_DDL = "a long, b long, links long"


class _Links:
    """Checks candidate pairs; counts the links of each row and keeps a spanning forest."""

    def __init__(self, x: np.ndarray, pdf: pd.DataFrame, flips: np.ndarray) -> None:
        self.x, self.flips = x, flips
        self.ids, self.weight = pdf["rep"].to_numpy(), pdf["weight"].to_numpy()
        self.bucket = pdf["bucket"].to_numpy().astype(np.uint64)
        self.counts = np.zeros(len(x), np.int64)
        self.forest, self.tree = Forest(), []

    def check(self, p: np.ndarray, q: np.ndarray) -> None:
        for a in range(0, len(p), 1 << 14):
            i, j = p[a : a + (1 << 14)], q[a : a + (1 << 14)]
            close = (self.x[i] * self.x[j]).sum(axis=1) >= COSINE
            i, j = i[close], j[close]
            if not len(i):
                continue
            rows, inverse = np.unique(np.concatenate([i, j]), return_inverse=True)
            home, visits = hashed(self.x[rows], self.flips)
            u, v = inverse[: len(i)], inverse[len(i) :]
            first = _first_bucket(home[u], visits[u], home[v], visits[v]) == self.bucket[i]
            i, j = i[first], j[first]
            np.add.at(self.counts, i, self.weight[j])
            np.add.at(self.counts, j, self.weight[i])
            for m, n in zip(self.ids[i].tolist(), self.ids[j].tolist(), strict=True):
                if self.forest.join(m, n):
                    self.tree.append((m, n, 0))

    def rows(self) -> pd.DataFrame:
        hit = np.flatnonzero(self.counts)
        out = pd.DataFrame({"a": self.ids[hit], "b": self.ids[hit], "links": self.counts[hit]})
        return pd.concat([out.groupby(["a", "b"], as_index=False).sum(), pd.DataFrame(self.tree, columns=["a", "b", "links"])]).astype("int64")


def _compare(n: int, kind: str):
    """Links in a group of small buckets, or of one chunk pair of a large bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # A bucket has vectors of one length, a group of small buckets may have several.
        return pd.concat([one_length(pdf.iloc[at]) for at in _by_length(list(pdf["vector"]))])

    def one_length(pdf: pd.DataFrame) -> pd.DataFrame:
        # Side 0 are residents; side 1 are visitors, or the residents of the other chunk.
        pdf = pdf.sort_values(["bucket", "side", "rep"], kind="stable")
        x = _unit(_matrix(list(pdf["vector"]), kind))
        links = _Links(x, pdf, flips_for(x.shape[1], n))
        bucket, side = pdf["bucket"].to_numpy(), pdf["side"].to_numpy()
        if pdf["l"].iloc[0] < 0:
            end = np.searchsorted(bucket, bucket, "right")
            own = np.flatnonzero(side == 0)
            after = end[own] - own - 1
            total = np.cumsum(after)
            done = 0
            while done < len(own):
                stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + (1 << 18), "right")))
                many, rows = after[done:stop], own[done:stop]
                step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                links.check(np.repeat(rows, many), np.repeat(rows, many) + 1 + step)
                done = stop
            return links.rows()
        left = int((side == 0).sum())
        same = left == len(pdf)
        for a in range(0, left, 128):
            near = x[a : min(a + 128, left)] @ (x if same else x[left:]).T >= COSINE - 1e-9
            i, j = np.nonzero(near)
            i, j = i + a, j + (0 if same else left)
            keep = i < j
            links.check(i[keep], j[keep])
        return links.rows()

    return run


def _first_bucket(home_a: np.ndarray, visit_a: np.ndarray, home_b: np.ndarray, visit_b: np.ndarray) -> np.ndarray:
    """The bucket in which a pair counts: of the first table where it meets, the common home or the smaller key."""
    out = np.zeros(len(home_a), np.uint64)
    open_ = np.ones(len(home_a), bool)
    for t in range(home_a.shape[1]):
        at_b = (home_a[:, t] == home_b[:, t]) | (visit_a[:, t] == home_b[:, t, None]).any(axis=1)
        at_a = (home_a[:, t] == home_b[:, t]) | (visit_b[:, t] == home_a[:, t, None]).any(axis=1)
        top = np.uint64(2**64 - 1)
        key = np.minimum(np.where(at_b, home_b[:, t], top), np.where(at_a, home_a[:, t], top))
        meets = open_ & (at_a | at_b)
        out[meets] = key[meets]
        open_ &= ~meets
    return out


def near_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `embeddings` (vec_id, embedding)."""
    spark = prepare(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_clean, "vec_id long, vector binary")
    rows = stored(rows, "vectors")
    # Equal values have equal bytes; scaled copies are compared like any other pair.
    fits = rows.where(F.col("vector").isNotNull() & F.col("vec_id").isNotNull())
    reps = fits.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    reps = stored(reps, "reps")
    n = reps.count()
    kind = "f4" if embeddings.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"
    keys = stored(reps.select("rep", "vector").mapInArrow(_keys(n, kind), _KEYS_DDL), "keys")
    sizes = keys.groupBy("bucket").agg(
        F.sum(F.col("home").cast("int")).alias("residents"), F.count("*").alias("members")
    ).where("residents > 0 and members > 1")
    sizes = sizes.withColumn("chunks", F.ceil(F.col("residents") / CHUNK).cast("int"))
    sizes = sizes.withColumn("guests", F.ceil((F.col("members") - F.col("residents")) / CHUNK).cast("int"))
    placed = keys.join(sizes, "bucket").withColumn("hash", F.xxhash64("rep"))
    parts = max(64, n // 500)
    small = placed.where(F.col("members") <= SMALL).select(
        F.pmod("bucket", F.lit(parts)).alias("part"), F.lit(-1).alias("l"), F.lit(-1).alias("r"), F.when(F.col("home"), 0).otherwise(1).alias("side"), "bucket", "rep"
    )
    placed = placed.where(F.col("members") > SMALL).withColumn("part", F.col("bucket"))
    home = placed.where("home").withColumn("chunk", F.pmod("hash", "chunks").cast("int"))
    visitor = placed.where("not home").withColumn("chunk", F.pmod("hash", "guests").cast("int"))
    # Chunk pairs of residents (left before right), and of residents with visitors.
    number = F.sequence(F.lit(0), F.col("chunks") - 1)
    guests = F.sequence(F.col("chunks"), F.col("chunks") + F.col("guests") - 1)
    guests = F.when(F.col("guests") > 0, guests).otherwise(F.array().cast("array<int>"))
    to_left = F.concat(F.filter(number, lambda k: k >= F.col("chunk")), guests)
    before = F.filter(number, lambda k: k < F.col("chunk"))
    at = F.col("chunk")
    left = home.select("part", at.alias("l"), F.explode(to_left).alias("r"), F.lit(0).alias("side"), "bucket", "rep")
    right = home.select("part", F.explode(before).alias("l"), at.alias("r"), F.lit(1).alias("side"), "bucket", "rep")
    visiting = visitor.select("part", F.explode(number).alias("l"), (F.col("chunks") + at).alias("r"), F.lit(1).alias("side"), "bucket", "rep")
    work = small.union(left).union(right).union(visiting).join(reps, "rep")
    found = work.groupBy("part", "l", "r").applyInPandas(_compare(n, kind), _FOUND_DDL)
    found = stored(found, "links")
    counts = found.where("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    classes = components(found.where("a <> b").select("a", "b"))
    of = reps.join(counts, F.col("rep") == F.col("a"), "left").join(classes, F.col("rep") == F.col("node"), "left")
    of = of.select("vector", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(of.where("links > 0 or weight > 1"), "vector", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.when(F.col("vec_id").isNotNull(), F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
