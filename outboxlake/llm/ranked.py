"""Ranked lexical search over a length-stratified index.

The normaliser m of a document depends on its length alone, so documents of equal m form a
stratum in which a term's share of the score depends on tf alone. The index is cut into
segments of consecutive documents, each with all of its strata. A term's posting list in a
segment is ordered by stratum and within it by tf; one entry (m, tf, count) stands for all
documents behind it, and the impact is computed once per entry.

A search meets only the postings of the items' terms. For every item and segment, the largest
tf of each term in a stratum bounds the scores there. Strata are visited from the highest bound
on; once `top` documents are found, strata whose bound lies below the last of them are skipped
(not those that equal it: ties go by id). Segments give their best `top`, which are ranked.

Every row of `docs` is a document of its own, also where ids repeat. Null text has no terms.
Null ids take part and rank behind all others of equal score. Items: rows that repeat are
taken once, several texts under one id count as one item with the terms of all, rows without
an id are left out. An empty table of either kind gives no rows. Only doc_id and text (item_id
and text) are read, whatever other columns are called. Texts are taken whole; a long text
makes its own segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outboxlake.llm import bytescan as bs
from outboxlake.llm.store import prepare, stored

#: Text bytes of a segment, one text at least.
SEGMENT_BYTES = 6 << 20
#: Items that are scored together over a segment, about.
ITEM_BLOCK = 256
#: Pairs of item and term up to which the items' terms are sent to every task.
BROADCAST_PAIRS = 500_000
_NO_ID = np.iinfo(np.int64).max

#: Bytes between terms: all of ASCII but digits and letters.
SEPARATORS = np.ones(256, bool)
for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    SEPARATORS[low : high + 1] = False

_SECOND = np.random.default_rng(20240502).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) in batches of about `limit` bytes of text."""
    held, size = [], 0
    for piece in bs.pieces(batches, limit=limit, most=1 << 20):
        own = pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
        if held and size + own > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if piece.num_rows:
            held.append(piece)
            size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def term_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit codes of each term."""
    second = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(bs.mix(_SECOND[data]) * bs.powers(len(data))[0][: len(data)], out=second[1:])
    return bs.word_codes(data, start, end), bs.mix(bs.span_hash(second, start, end) ^ (end - start).astype(np.uint64))


def order_by_code(first: np.ndarray, second: np.ndarray, *less: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by both codes and what else is given, and where each code begins in it."""
    order = np.lexsort((*less, first))
    same = first[order[1:]] == first[order[:-1]]
    if (same & (second[order[1:]] != second[order[:-1]])).any():
        order = np.lexsort((*less, second, first))
        same = (first[order[1:]] == first[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
    return order, np.flatnonzero(np.append(True, ~same)) if len(order) else np.zeros(0, np.int64)


def cut_out(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches as strings."""
    size = end - start
    at = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=at[1:])
    place = np.repeat(start - at[:-1], size) + np.arange(at[-1])
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[place]))])


def packed_lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Rows of a table of numbers, cut at `at`, as binaries."""
    wide = values.dtype.itemsize * int(np.prod(values.shape[1:], dtype=np.int64))
    ends = pa.py_buffer((at * wide).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, ends, pa.py_buffer(np.ascontiguousarray(values))])


def normalisers(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    distinct, of = np.unique(lengths, return_inverse=True)
    return np.array([75 + 25 * int(n) * n_docs // n_terms for n in distinct], np.int64)[of]


_SIZES_DDL = "docs long, terms long"
_SIZES = pa.schema([("docs", pa.int64()), ("terms", pa.int64())])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in bs.pieces(batches):
        data, at = bs.flat(piece.column("text"))
        owner = bs.words(data, at, SEPARATORS)[2]
        yield bs.batch_of(_SIZES, [len(np.unique(owner))], [len(owner)])


_INDEX = pa.schema([("segment", pa.string()), ("term", pa.string()), ("n_docs", pa.int64()), ("entries", pa.binary()), ("docs", pa.binary())])
_INDEX_DDL = "segment string, term string, n_docs long, entries binary, docs binary"


def _postings(n_docs: int, n_terms: int, segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition, k = TaskContext.get().partitionId(), 0
        for rows in gathered(batches, segment_bytes):
            data, at = bs.flat(rows.column("text"))
            data = bs.LOWER[data]
            start, end, owner = bs.words(data, at, SEPARATORS)
            if not len(owner):
                continue
            segment, k = f"{partition}-{k}", k + 1
            # Documents are numbered by id, so that numbers break ties as ids do.
            ids = rows.column("doc_id").fill_null(_NO_ID).to_numpy()
            by_id = np.argsort(ids, kind="stable")
            number = np.empty(len(ids), np.int32)
            number[by_id] = np.arange(len(ids), dtype=np.int32)
            m = normalisers(np.bincount(owner, minlength=len(ids)), n_docs, n_terms)[by_id]
            codes, seconds = term_codes(data, start, end)
            order, begin = order_by_code(codes, seconds, number[owner])
            term = np.zeros(len(order), np.int64)
            term[begin[1:]] = 1
            term, doc = np.cumsum(term), number[owner[order]]
            pair = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])))
            tf = np.diff(np.append(pair, len(order)))
            term, doc = term[pair], doc[pair]
            by = np.lexsort((tf, m[doc], term))
            term, doc, tf = term[by], doc[by], tf[by]
            stratum = m[doc]
            entry = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1]) | (tf[1:] != tf[:-1])))
            entries = np.column_stack([stratum[entry], tf[entry], np.diff(np.append(entry, len(term)))])
            lists = np.searchsorted(term, np.arange(len(begin) + 1))
            one = order[begin]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([segment] * len(begin), pa.string()),
                    cut_out(data, start[one], end[one]),
                    pa.array(np.diff(lists), pa.int64()),
                    packed_lists(entries, np.searchsorted(entry, lists)),
                    packed_lists(doc, lists),
                ],
                schema=_INDEX,
            )
            yield bs.batch_of(_INDEX, [segment], [None], [len(ids)], [b""], [bs.packed(ids[by_id])])

    return run


class Index:
    """Postings (segment, term, n_docs, entries, docs), a row without term per segment that holds
    its ids, and the corpus sizes."""

    def __init__(self, rows: DataFrame, n_docs: int, n_terms: int) -> None:
        self.rows, self.n_docs, self.n_terms = rows, n_docs, n_terms


def build(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> Index:
    """Indexes every term of every row of `docs` (doc_id, text); written to the shared folder."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = docs.select("text").mapInArrow(_sizes, _SIZES_DDL).agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    n_docs, n_terms = sizes["docs"] or 0, sizes["terms"] or 0
    return Index(stored(docs.mapInArrow(_postings(n_docs, n_terms, segment_bytes), _INDEX_DDL), "lexical"), n_docs, n_terms)


_TERMS_DDL = "item_id long, term string, times long"
_TERMS = pa.schema([("item_id", pa.int64()), ("term", pa.string()), ("times", pa.int64())])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in bs.pieces(batches):
        data, at = bs.flat(piece.column("text"))
        data = bs.LOWER[data]
        start, end, owner = bs.words(data, at, SEPARATORS)
        order, begin = order_by_code(*term_codes(data, start, end), owner)
        new = np.zeros(len(order), bool)
        new[begin] = True
        new[1:] |= owner[order[1:]] != owner[order[:-1]]
        pair = np.flatnonzero(new)
        one = order[pair]
        items = piece.column("item_id").to_numpy()[owner[one]]
        times = np.diff(np.append(pair, len(order)))
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), cut_out(data, start[one], end[one]), pa.array(times, pa.int64())], schema=_TERMS)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Segment:
    """The postings of some terms in one segment, ready for items."""

    def __init__(self, entries: list[bytes], docs: list[bytes], n_docs: int) -> None:
        table = np.frombuffer(b"".join(entries), np.int64).reshape(-1, 3)
        self.n_docs = n_docs
        self.doc = np.frombuffer(b"".join(docs), np.int32)
        self.strata, stratum = np.unique(table[:, 0], return_inverse=True)
        shares = impact(table[:, 1], table[:, 0])
        self.impact, self.stratum = np.repeat(shares, table[:, 2]), np.repeat(stratum, table[:, 2])
        self.at = np.concatenate([[0], np.cumsum([len(d) // 4 for d in docs])])
        first = np.concatenate([[0], np.cumsum([len(e) // 24 for e in entries])])
        # Entries of a term and stratum come by tf: the last has the largest impact.
        last = np.ones(len(table), bool)
        last[:-1] = stratum[1:] != stratum[:-1]
        last[first[1:] - 1] = True
        self.bound = [(stratum[a:b][last[a:b]], shares[a:b][last[a:b]]) for a, b in zip(first[:-1], first[1:], strict=True)]

    def best(self, terms: np.ndarray, weights: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the `top` best documents of an item, best first."""
        bounds = np.zeros(len(self.strata), np.int64)
        for t, w in zip(terms, weights, strict=True):
            where, shares = self.bound[t]
            bounds[where] += w * shares
        place = np.concatenate([np.arange(self.at[t], self.at[t + 1]) for t in terms])
        weight = np.repeat(weights, self.at[terms + 1] - self.at[terms])
        doc, stratum, gain = self.doc[place], self.stratum[place], weight * self.impact[place]
        order = np.argsort(-bounds, kind="stable")
        scores = np.zeros(self.n_docs, np.int64)
        # The first strata hold postings for twice the documents that are wanted, or more.
        held = np.cumsum(np.bincount(stratum, minlength=len(self.strata))[order])
        step = int(np.searchsorted(held, 2 * top * len(terms))) + 1
        at = 0
        while at < len(order):
            visit = order[at : at + step]
            visit = visit[bounds[visit] >= max(self._least(scores, top), 1)]
            if not len(visit):
                break
            now = np.zeros(len(self.strata), bool)
            now[visit] = True
            chosen = now[stratum]
            np.add.at(scores, doc[chosen], gain[chosen])
            at, step = at + step, 4 * step
        found = np.flatnonzero(scores)
        found = found[np.lexsort((found, -scores[found]))][:top]
        return found, scores[found]

    @staticmethod
    def _least(scores: np.ndarray, top: int) -> int:
        return int(np.partition(scores, -top)[-top]) if len(scores) >= top else 0


_FOUND_DDL = "item_id long, doc_id long, score long"


def _search(top: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        listed = pdf["term"].isna().to_numpy()
        ids = np.frombuffer(pdf["docs"][listed].iloc[0], np.int64)
        rows = pdf[~listed]
        if rows.empty:
            return pd.DataFrame({"item_id": [], "doc_id": pd.array([], "Int64"), "score": []})
        segment = Segment(list(rows["entries"]), list(rows["docs"]), len(ids))
        item = np.concatenate(list(rows["items"]))
        weight = np.concatenate(list(rows["weights"]))
        term = np.repeat(np.arange(len(rows)), rows["items"].map(len))
        order = np.argsort(item, kind="stable")
        item, weight, term = item[order], weight[order], term[order]
        begin = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        out = []
        for a, b in zip(begin, np.append(begin[1:], len(item)), strict=True):
            found, scores = segment.best(term[a:b], weight[a:b], top)
            out.append((np.full(len(found), item[a]), ids[found], scores))
        found = [np.concatenate(x) for x in zip(*out, strict=True)]
        doc_id = pd.arrays.IntegerArray(found[1].copy(), found[1] == _NO_ID)
        return pd.DataFrame({"item_id": found[0], "doc_id": doc_id, "score": found[2]})

    return run


def search(index: Index, items: DataFrame, top: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score) of the `top` best documents with a score above 0 of every item."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id is not null and text is not null").distinct()
    terms = items.mapInArrow(_item_terms, _TERMS_DDL).groupBy("item_id", "term").agg(F.sum("times").alias("times"))
    terms = stored(terms, "item-terms")
    size = terms.agg(F.count("*").alias("pairs"), F.count_distinct("item_id").alias("items")).first()
    blocks = max(1, -(-size["items"] // ITEM_BLOCK))
    small = size["pairs"] <= BROADCAST_PAIRS

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    words = index.rows.where("term is not null")
    held = words.select("term", "n_docs").join(sent(terms.select("term").distinct()), "term", "left_semi")
    held = held.groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * index.n_docs + 2) / (2 * F.col("df") + 1)))
    asked = (
        terms.join(sent(held), "term")
        .select("term", "item_id", (weight * F.col("times")).cast("long").alias("weight"))
        .withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
        .groupBy("block", "term")
        .agg(F.collect_list(F.struct("item_id", "weight")).alias("asked"))
        .select("block", "term", F.col("asked.item_id").alias("items"), F.col("asked.weight").alias("weights"))
    )
    asked = stored(asked, "asked")
    met = words.drop("n_docs").join(sent(asked), "term")
    # Each block of items needs a segment's ids beside its postings.
    listed = index.rows.where("term is null").select(
        "segment",
        "term",
        "entries",
        "docs",
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.lit(None).cast("array<long>").alias("items"),
        F.lit(None).cast("array<long>").alias("weights"),
    )
    found = met.unionByName(listed).groupBy("segment", "block").applyInPandas(_search(top), _FOUND_DDL)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
