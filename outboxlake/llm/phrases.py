"""Phrase collocations from a weighted de Bruijn graph.

Nodes are runs of three words, edges the runs of four that join two of them; an edge weighs as
often as it occurs. Only edges and the last words of pieces are counted in the corpus:

1. A task counts the edges of a few megabytes of text and deals them out by hash, packed with
   a dictionary of their words. A piece's last three words (or all, if fewer) go along as ends.
2. Where all copies of an edge meet, its weight is final. A node's occurrences are the weights
   of the edges that leave it plus the pieces that end in it, so what the edges of a bucket
   carry out of each node is added up there and sent on to the node; runs of two words follow
   from nodes in the same way, and words from runs of two. A hot run reaches its next place as
   one sum per bucket, whatever its weight: no group is larger than what hashing deals out.
3. Edges that are frequent enough to matter are compacted: where a node and the edges on both
   sides weigh the same, nothing else enters or leaves, and the two edges become one path.
   Paths cover the runs inside them, which settles most of the phrases that a longer one makes
   superfluous; the others are met from the frequent nodes.

Equal words and runs are found by hash and settled by their bytes. Counts are exact, weights
are compared as decimals.

Null text is empty, null languages count as `und` (together with that name), ids are not read,
repeated rows count again, an empty table gives no rows, other columns do not matter. Very long
texts are read whole, one at a time. Words may hold anything but spaces, tabs and piece ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outboxlake.llm import bytescan as bs
from outboxlake.llm.ranked import gathered
from outboxlake.llm.store import prepare, stored

EDGE = 4
#: Text bytes that a task counts at a time, and that a bucket of edges stands for.
CHUNK_BYTES, BUCKET_BYTES = 6 << 20, 10 << 20
#: Parts of a language's phrases that are ranked before all of them are.
PARTS = 64

PIECE_ENDS = np.zeros(256, bool)
PIECE_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
BREAKS = PIECE_ENDS.copy()
BREAKS[[0x20, 0x09]] = True
_LINE = np.zeros(256, bool)
_LINE[0x0A] = True

FLOW, END, DONE = 0, 1, 2
_ROW_DDL = "lang string, bucket int, kind int, size int, words binary, grams binary, counts binary, total long"
_ROW = ["lang", "bucket", "kind", "size", "words", "grams", "counts", "total"]
_ROW_SCHEMA = pa.schema(
    [("lang", pa.string()), ("bucket", pa.int32()), ("kind", pa.int32()), ("size", pa.int32())]
    + [(c, pa.binary()) for c in ("words", "grams", "counts")]
    + [("total", pa.int64())]
)


class Words:
    """Distinct words of a run of bytes: `of` every occurrence, first occurrence and hash of each."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.data = data
        codes = bs.word_codes(data, start, end)
        order = np.argsort(codes, kind="stable")
        same = codes[order[1:]] == codes[order[:-1]]
        a, b = order[:-1][same], order[1:][same]
        if _equal(data, start[a], end[a], start[b], end[b]):
            new = np.append(True, ~same) if len(order) else np.zeros(0, bool)
            self.of = np.empty(len(order), np.int32)
            self.of[order] = np.cumsum(new) - 1
            first = order[new]
        else:
            # Two words share a hash: the bytes themselves are the keys.
            seen: dict[bytes, int] = {}
            self.of = np.array([seen.setdefault(data[i:j].tobytes(), len(seen)) for i, j in zip(start, end, strict=True)], np.int32)
            first = np.unique(self.of, return_index=True)[1]
        self.start, self.end, self.code = start[first], end[first], codes[first]

    def text(self, chosen: np.ndarray) -> bytes:
        """The chosen words, each followed by a line end."""
        size = self.end[chosen] - self.start[chosen] + 1
        at = np.cumsum(size)
        place = np.repeat(self.start[chosen] - (at - size), size) + np.arange(at[-1] if len(at) else 0)
        out = self.data[np.minimum(place, max(len(self.data) - 1, 0))]
        out[at - 1] = 0x0A
        return out.tobytes()


def _equal(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> bool:
    """Whether all pairs of stretches hold equal bytes."""
    size = a_end - a
    if not np.array_equal(size, b_end - b):
        return False
    for k in range(0, len(a), 1 << 17):
        part = slice(k, k + (1 << 17))
        n = size[part]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(data[np.repeat(a[part], n) + step], data[np.repeat(b[part], n) + step]):
            return False
    return True


_STEPS = bs.mix(np.arange(1, EDGE + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _hashed(columns: np.ndarray) -> np.ndarray:
    total = columns[:, 0].astype(np.uint64) * _STEPS[0]
    for j in range(1, columns.shape[1]):
        total = total + columns[:, j].astype(np.uint64) * _STEPS[j]
    return bs.mix(total)


def combined(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their counts."""
    if not len(grams):
        return grams, counts
    codes = _hashed(grams)
    order = np.argsort(codes, kind="stable")
    grams, counts, codes = grams[order], counts[order], codes[order]
    same = codes[1:] == codes[:-1]
    if (same[:, None] & (grams[1:] != grams[:-1])).any():
        order = np.lexsort(grams.T)
        grams, counts = grams[order], counts[order]
        same = (grams[1:] == grams[:-1]).all(axis=1)
    begin = np.flatnonzero(np.append(True, ~same))
    return grams[begin], np.add.reduceat(counts, begin)


def _squeeze(values: np.ndarray) -> bytes:
    """Compressed numbers in as few bytes each as the largest needs."""
    most = int(values.max(initial=0))
    kind = next(k for k in ("u1", "u2", "u4", "u8") if most < 1 << 8 * int(k[1]))
    raw = np.ascontiguousarray(values).astype(kind).tobytes()
    return kind[1].encode() + len(raw).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def _widen(packed: bytes) -> np.ndarray:
    raw = pa.decompress(packed[9:], int.from_bytes(packed[1:9], "little"), "zstd", asbytes=True) if len(packed) > 9 else b""
    return np.frombuffer(raw, f"<u{packed[:1].decode()}").astype(np.int64)


def pack(lang: str, kind: int, words: Words, grams: np.ndarray, counts: np.ndarray, buckets: int, fixed: int | None = None) -> list[tuple]:
    """Rows of runs of words, one per bucket, with the words they use."""
    if not len(grams):
        return []
    size = grams.shape[1]
    if fixed is None:
        to = ((_hashed(words.code[grams]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    else:
        to = np.full(len(grams), fixed)
    order = np.lexsort((grams[:, 0], to))
    grams, counts, to = grams[order], counts[order], to[order]
    cut = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
    rows = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        used, local = np.unique(grams[a:b], return_inverse=True)
        text = words.text(used)
        # Columns apart: the first is in order.
        table = _squeeze(local.reshape(-1, size).T)
        shown = len(text).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(text, asbytes=True)
        rows.append((lang, int(to[a]), kind, size, shown, table, _squeeze(counts[a:b]), 0))
    return rows


class Unpacked:
    """Runs of the same size of several rows over one set of words."""

    def __init__(self, pdf: pd.DataFrame, size: int) -> None:
        texts = [pa.decompress(w[8:], int.from_bytes(w[:8], "little"), "zstd", asbytes=True) for w in pdf["words"]]
        data = np.frombuffer(b"".join(texts), np.uint8)
        start, end, _ = bs.words(data, np.array([0, len(data)]), _LINE)
        self.words = Words(data, start, end)
        own = np.cumsum([0, *(t.count(b"\n") for t in texts)])
        grams = [self.words.of[_widen(g).reshape(size, -1).T + at] for g, at in zip(pdf["grams"], own, strict=False)]
        self.grams = np.concatenate(grams) if grams else np.zeros((0, size), np.int32)
        self.counts = np.concatenate([_widen(c) for c in pdf["counts"]]) if grams else np.zeros(0, np.int64)
        self.of_row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])


def _runs(ends: bool, buckets: int):
    """Edges of the texts of a task, or the last words of their pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered(batches, CHUNK_BYTES):
            langs = np.array(rows.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                data, at = bs.flat(rows.column("text").take(pa.array(np.flatnonzero(langs == lang))))
                data = bs.LOWER[data]
                start, end, owner = bs.words(data, at, BREAKS)
                if not len(start):
                    continue
                piece = np.cumsum(PIECE_ENDS[data])[start]
                new = np.append(True, (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1]))
                first = np.flatnonzero(new)
                behind = np.append(first[1:], len(start))
                words = Words(data, start, end)
                out = []
                if ends:
                    for size in range(1, EDGE):
                        has = behind[(behind - first == size) | ((size == EDGE - 1) & (behind - first > size))]
                        tails = np.column_stack([words.of[has - size + j] for j in range(size)])
                        out += pack(lang, END, words, *combined(tails, np.ones(len(tails), np.int64)), buckets)
                else:
                    left = np.repeat(behind, behind - first) - np.arange(len(start))
                    place = np.flatnonzero(left >= EDGE)
                    edges = np.column_stack([words.of[place + j] for j in range(EDGE)])
                    out = pack(lang, FLOW, words, *combined(edges, np.ones(len(edges), np.int64)), buckets)
                if out:
                    yield bs.batch_of(_ROW_SCHEMA, *zip(*out, strict=True))

    return run


def _level(size: int, least: int, buckets: int):
    """Final counts of runs of `size` words, what they add to their first words, and all else unchanged."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = (pdf["size"] == size) & (pdf["kind"] != DONE)
        rest, rows = pdf[~mine], []
        if mine.any():
            chosen = pdf[mine]
            lang, bucket = chosen["lang"].iloc[0], int(chosen["bucket"].iloc[0])
            runs = Unpacked(chosen, size)
            grams, counts = combined(runs.grams, runs.counts)
            often = counts >= least
            rows = pack(lang, DONE, runs.words, grams[often], counts[often], buckets, bucket)
            if size > 1:
                rows += pack(lang, FLOW, runs.words, *combined(grams[:, :-1], counts), buckets)
                last = (chosen["kind"] == END).to_numpy()[runs.of_row]
                rows += pack(lang, END, runs.words, *combined(runs.grams[last, 1:], runs.counts[last]), buckets)
            else:
                rows.append((lang, bucket, DONE, 0, None, None, None, int(counts.sum())))
        return pd.concat([rest, pd.DataFrame(rows, columns=_ROW)]) if rows else rest

    return run


_FREQUENT = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("f", pa.int64())])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            runs = Unpacked(pd.DataFrame([row]), row["size"])
            lines = runs.words.text(np.arange(len(runs.words.start))).decode().split("\n")
            yield bs.batch_of(_FREQUENT, [row["lang"]] * len(runs.grams), [[lines[w] for w in g] for g in runs.grams.tolist()], runs.counts)


def frequent_runs(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """((lang, words, f) of every run of 1 to 4 words that occurs `least` times within pieces, (lang, n))."""
    prepare(docs.sparkSession)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    docs = docs.select(lang, F.col("text").cast("string").alias("text"))
    volume = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(16, volume // BUCKET_BYTES)
    rows = docs.mapInArrow(_runs(False, buckets), _ROW_DDL)
    for size in range(EDGE, 0, -1):
        if size == EDGE - 1:
            rows = rows.unionByName(docs.mapInArrow(_runs(True, buckets), _ROW_DDL))
        rows = rows.groupBy("lang", "bucket").applyInPandas(_level(size, least, buckets), _ROW_DDL)
    rows = stored(rows, "runs")
    totals = rows.where("size = 0").groupBy("lang").agg(F.sum("total").alias("n"))
    found = rows.where("size > 0").mapInArrow(_listed, "lang string, words array<string>, f long")
    return stored(found, "frequent"), totals


def _phrase(words) -> F.Column:
    return F.array_join(words, " ")


def paths(runs: DataFrame) -> DataFrame:
    """(lang, words, f): the edges among frequent runs, joined into paths wherever nothing else
    enters or leaves between them.

    A node that weighs as much as the edges on both sides has no other edge and no piece that
    starts or ends there, so a path stays inside one piece and cannot close on itself. Places on
    paths are found by doubling: each round looks twice as far back.
    """
    edges = runs.where(F.size("words") == EDGE).select("lang", "f", "words", _phrase("words").alias("edge"))
    nodes = runs.where(F.size("words") == EDGE - 1).select("lang", "f", _phrase("words").alias("node"))
    into = edges.select("lang", "f", "edge", _phrase(F.slice("words", 2, EDGE - 1)).alias("node"))
    out = edges.select("lang", "f", F.col("edge").alias("next"), _phrase(F.slice("words", 1, EDGE - 1)).alias("node"))
    links = nodes.join(into, ["lang", "f", "node"]).join(out, ["lang", "f", "node"])
    links = links.select("lang", F.col("edge").alias("before"), F.col("next").alias("edge"))
    # (edge, an edge further back on its path, how far): heads point at themselves.
    far = edges.select("lang", "edge").join(links, ["lang", "edge"], "left")
    far = far.select("lang", "edge", F.coalesce("before", "edge").alias("back"), F.col("before").isNotNull().cast("long").alias("steps"))
    far = stored(far, "path-places")
    total = far.agg(F.sum("steps").alias("s")).first()["s"] or 0
    while total:
        other = far.select("lang", F.col("edge").alias("back"), F.col("back").alias("further"), F.col("steps").alias("more"))
        far = far.join(other, ["lang", "back"]).select("lang", "edge", F.col("further").alias("back"), (F.col("steps") + F.col("more")).alias("steps"))
        far, before = stored(far, "path-places"), total
        total = far.agg(F.sum("steps").alias("s")).first()["s"]
        if total == before:
            break
    ends = F.struct("steps", F.element_at("words", -1).alias("word"))
    whole = far.join(edges, ["lang", "edge"]).groupBy("lang", "back").agg(F.sort_array(F.collect_list(ends)).alias("more"), F.max("f").alias("f"))
    first = F.slice(F.split("back", " ", -1), 1, EDGE - 1)
    return whole.select("lang", F.concat(first, F.col("more.word")).alias("words"), "f")


def _inside(words: str, size: int) -> F.Column:
    """All runs of `size` words of a list."""
    places = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda k: F.array_join(F.slice(F.col(words), k, size), " "))


def scored(runs: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of runs of two words or more by their weakest cut."""
    counts = runs.select("lang", _phrase("words").alias("part"), "f")
    cuts = runs.where(F.size("words") >= 2).select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang",
        _phrase("words").alias("phrase"),
        "a",
        "k",
        _phrase(F.expr("slice(words, 1, k)")).alias("head"),
        _phrase(F.expr("slice(words, k + 1, size(words))")).alias("tail"),
    )
    heads = counts.select("lang", F.col("part").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r"))
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    score = F.expr("CAST(2000000 * CAST(a AS DECIMAL(24, 0)) div (CAST(l AS DECIMAL(24, 0)) + r) AS BIGINT)")
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(runs: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the count of the commonest longer run around each run inside one."""
    joined = stored(paths(runs), "paths")
    inner = joined.select("lang", "f", F.explode(F.concat(_inside("words", 2), _inside("words", 3))).alias("phrase"))
    # A path's inner nodes weigh as much as the path, which holds their pairs already.
    nodes = runs.where(F.size("words") == 3).select("lang", "f", "words", _phrase("words").alias("node"))
    held = joined.select("lang", "f", F.explode(_inside("words", 3)).alias("node"))
    nodes = nodes.join(held, ["lang", "f", "node"], "left_anti")
    pairs = nodes.select("lang", "f", F.explode(_inside("words", 2)).alias("phrase"))
    return inner.unionByName(pairs).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, least: int = 30, cover: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the `top` phrases of every language.

    Phrases of 2 to 4 words occur `least` times; one whose words lie inside a longer phrase that
    occurs at least `cover` percent as often is left out.
    """
    runs, totals = frequent_runs(docs, least)
    kept = scored(runs).join(covered(runs), ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(24,0)") < cover * F.col("a").cast("decimal(24,0)")))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # Ranked in parts first, so that no task sees a whole language.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("place") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return kept.where(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
