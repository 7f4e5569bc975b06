"""Jaccard self-join on word shingles with a count-vector R-tree.

Words are runs of `[^\\x20\\x09-\\x0D]` with A-Z lower-cased; a text's set holds its distinct
5-word shingles (with fewer words, the whole sequence as one; without words, none). Two
texts link when 100 * |A and B| >= 75 * |A or B|.

How it scales:

1. Texts with equal sets collapse to their smallest id, so copies cost one row each.
2. A linked pair shares k shingles among the first |A| - ceil(.75 |A|) + k of either text in
   any fixed order. The order is by hash with the most frequent shingles last, which keeps
   passages that many texts share out of the way. Which shingles count as frequent only
   changes the cost, never the result. Texts that share fewer than k with others drop out.
3. Blocks of texts exchange each of these shingles once (smallest text only) and get the
   shingles back that other texts hold too, with the smallest text that holds it, its pivot,
   and about how many do. Texts with a common pivot form a tile. A text with h such shingles
   and no partner with fewer than k in common joins the tiles of its h - k + 1 rarest only:
   the rarest one that a linked pair shares is among them for both, so they meet in its tile.
4. Shingles are hashed into groups, more of them for larger sets, and counted: the sum of
   min(a, b) over the groups bounds the overlap. Only texts that a bound leaves with a
   partner get their sets built and moved.
5. Pivot links are checked first (count bound, then sets). Tiles that are one component by
   then are done; this is linear in the links, also for a group of thousands of copies.
6. Other tiles are cut into cells of like sizes (a factor of two, and those below that may
   link into it) and searched through an R-tree over the count vectors, where a node keeps
   the largest count per group. Members left with a partner in another component come back
   with their sets, on which surviving pairs are checked. Large cells are split into chunks;
   only members outside the cell's main component visit all chunks.

Null texts and texts without words have no shingles and link with nothing. Repeated ids
keep their rows; each row gets the class of its own text. Rows with a null id get a null
class. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outboxlake.llm import bytescan as bs
from outboxlake.llm.components import Forest, components
from outboxlake.llm.store import prepare, stored

WORDS = 5
#: Groups of a count vector, as powers of two: about one to two for each shingle.
LEAST_GROUPS, MOST_GROUPS = 8, 15
#: Shingles that a linked pair shares in its prefixes, by the size of the sets.
SHARED = ((22, 16), (11, 8), (1, 3))
#: Entries of the list of frequent shingles that is sent to all tasks (8 bytes each).
FREQUENT = 1 << 16
CHUNK = 256
#: Bytes kept of a prefix shingle's hash, and those that travel beside its bucket. Shingles
#: that agree in them only add candidates; pairs are checked on whole hashes.
PREFIX_BYTES, KEY_BYTES = 6, 5
#: Bytes of a whole hash.
HASH_BYTES = 7
LEAF = 16
_MASK = np.uint64((1 << 56) - 1)


def shingles(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 56-bit shingle hashes of every text, and the offset of each text."""
    data, at = bs.flat(batch.column("text"))
    n = batch.num_rows
    start, end, owner = bs.words(bs.LOWER[data], at)
    codes = bs.word_codes(bs.LOWER[data], start, end) if len(start) else np.zeros(0, np.uint64)
    hashes, first = bs.windows(codes, owner, WORDS)
    of = owner[first]
    bounds = bs.group_starts(owner, n)
    counts = np.diff(bounds)
    few = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for j in range(WORDS - 1):
            has = counts[few] > j
            short[has] += codes[bounds[few][has] + j] * bs._STEPS[j]
        hashes = np.concatenate([hashes, bs.mix(short + counts[few].astype(np.uint64))])
        of = np.concatenate([of, few])
    keys = np.sort((of.astype(np.uint64) << np.uint64(56)) | (hashes & _MASK))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys & _MASK, bs.group_starts((keys >> np.uint64(56)).astype(np.int64), n)


def groups_of(sizes: np.ndarray) -> np.ndarray:
    """The next power of two above the size of each set, within bounds."""
    return 1 << np.clip(np.frexp(sizes)[1], LEAST_GROUPS, MOST_GROUPS).astype(np.int64)


def packed_counts(hashes: np.ndarray) -> bytes:
    """A set's count vector with one byte a count, or as many as the largest one needs."""
    groups = int(groups_of(len(hashes)))
    counts = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % groups, minlength=groups)
    return bs.packed(counts.astype(np.min_scalar_type(counts.max())))


def counts_of(values, sizes: np.ndarray) -> np.ndarray:
    """The count vectors of sets, folded to the groups of the smallest one."""
    own = groups_of(sizes)
    groups = int(own.min())
    counts = [np.frombuffer(v, f"u{len(v) // k}") for v, k in zip(values, own.tolist(), strict=True)]
    counts = [c if len(c) == groups else c.reshape(-1, groups).sum(0) for c in counts]
    return np.stack(counts).astype(np.min_scalar_type(max(int(c.max()) for c in counts)))


def common_in_prefix(n: np.ndarray) -> np.ndarray:
    few = np.select([n >= size for size, _ in SHARED], [k for _, k in SHARED], 0)
    return np.minimum(n, np.maximum(few, n // 32))


def _count_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])
    held: list[np.ndarray] = []
    for piece in bs.pieces(batches):
        held.append(shingles(piece)[0])
        if sum(map(len, held)) > 1_000_000:
            yield _often(held, schema)
            held = []
    if held:
        yield _often(held, schema)


def _often(held: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    value, n = np.unique(np.concatenate(held), return_counts=True)
    keep = n >= 3
    return bs.batch_of(schema, value[keep].astype(np.int64), n[keep])


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    counts = docs.select("text").mapInArrow(_count_frequent, "shingle long, n long")
    top = counts.groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(FREQUENT)
    return np.sort(top.toPandas()["shingle"].to_numpy(np.int64).astype(np.uint64))


_BLOCKS = pa.schema(
    [
        ("block", pa.string()),
        ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())]))),
        ("ids", pa.binary()),
        ("lengths", pa.binary()),
        ("needs", pa.binary()),
        ("prefix", pa.binary()),
    ]
)
_BLOCKS_DDL = "block string, docs array<struct<doc_id:long,n:long,s1:long,s2:long>>, ids binary, lengths binary, needs binary, prefix binary"


def _blocks(frequent):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        late = frequent.value
        partition, k = TaskContext.get().partitionId(), 0
        for piece in bs.pieces(batches, limit=4 << 20):
            yield _block(piece, late, f"{partition}-{k}")
            k += 1

    return scan


def _block(piece: pa.RecordBatch, late: np.ndarray, name: str) -> pa.RecordBatch:
    hashes, at = shingles(piece)
    sizes = np.diff(at)
    padded = np.append(hashes, np.uint64(0))
    s1 = np.add.reduceat(bs.mix(padded), at[:-1]) if len(sizes) else np.zeros(0, np.uint64)
    s2 = np.add.reduceat(bs.mix(padded ^ np.uint64(0x5851F42D4C957F2D)), at[:-1]) if len(sizes) else s1
    s1, s2 = np.where(sizes > 0, s1, 0).astype(np.uint64), np.where(sizes > 0, s2, 0).astype(np.uint64)
    ids = piece.column("doc_id")
    rows = [
        {"doc_id": i, "n": int(n), "s1": int(a), "s2": int(b)}
        for i, n, a, b in zip(ids.to_pylist(), sizes, s1.astype(np.int64), s2.astype(np.int64), strict=True)
    ]
    # Frequent shingles go to the end of their text's order; the rest stays sorted by hash.
    of = np.repeat(np.arange(len(sizes)), sizes)
    if len(late) and len(hashes):
        found = np.searchsorted(late, hashes)
        is_late = late[np.minimum(found, len(late) - 1)] == hashes
        order = np.argsort(of * 2 + is_late, kind="stable")
        hashes = hashes[order]
    keep = sizes - -(-3 * sizes // 4) + common_in_prefix(sizes)
    # The smallest partner has three quarters of the size.
    needs = common_in_prefix(-(-3 * sizes // 4))
    rank = np.arange(len(hashes)) - np.repeat(at[:-1], sizes)
    usable = ~np.asarray(ids.is_null())
    keep = np.where(usable, keep, 0)
    chosen = hashes[rank < np.repeat(keep, sizes)]
    known = ids.fill_null(0).to_numpy()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name]),
            pa.array([rows], _BLOCKS.field("docs").type),
            pa.array([bs.packed(known.astype(np.int64))]),
            pa.array([bs.packed(keep.astype(np.int32))]),
            pa.array([bs.packed(needs.astype(np.int32))]),
            pa.array([bs.squeezed(chosen >> np.uint64(56 - 8 * PREFIX_BYTES), PREFIX_BYTES)]),
        ],
        schema=_BLOCKS,
    )


_SENT_DDL = "bucket int, block string, start int, base long, keys binary, low binary, many binary"


def _send(buckets: int):
    """Each shingle of a block once, with the smallest text that holds it and whether others do."""
    schema = pa.schema(
        [("bucket", pa.int32()), ("block", pa.string()), ("start", pa.int32()), ("base", pa.int64())]
        + [(c, pa.binary()) for c in ("keys", "low", "many")]
    )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                owner = np.repeat(ids, np.frombuffer(row["lengths"], np.int32))
                keys = bs.widened([row["prefix"]], PREFIX_BYTES)
                if not len(keys):
                    continue
                order = np.lexsort((owner, keys))
                keys, owner = keys[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                last = np.append(first[1:], len(keys)) - 1
                many = owner[first] != owner[last]
                keys, low = keys[first], owner[first]
                base = int(low.min())
                low = near(low - base)
                to = bucket_of(keys, buckets)
                cut = np.searchsorted(to, np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cut))
                parts = [slice(cut[b], cut[b + 1]) for b in full]
                yield bs.batch_of(
                    schema,
                    full,
                    [row["block"]] * len(full),
                    cut[full],
                    [base] * len(full),
                    [bs.squeezed(keys[k], KEY_BYTES) for k in parts],
                    [bs.packed(low[k]) for k in parts],
                    [bs.packed(np.packbits(many[k])) for k in parts],
                )

    return send


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of prefix keys; sorted keys give sorted buckets."""
    return ((keys >> np.uint64(8 * PREFIX_BYTES - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def near(ids: np.ndarray) -> np.ndarray:
    """Four bytes a number where all fit."""
    return ids.astype(np.uint32) if len(ids) and ids.min() >= 0 and ids.max() < 1 << 32 else ids.astype(np.int64)


def near_ids(value: bytes, n: int) -> np.ndarray:
    return np.frombuffer(value, np.uint32 if len(value) == 4 * n else np.int64).astype(np.int64)


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """For every block of a bucket: which of its shingles another text holds too, their pivots, and
    how many blocks hold them (up to 255)."""
    sizes = pdf["keys"].map(len).to_numpy() // KEY_BYTES
    keys = bs.widened(list(pdf["keys"]), KEY_BYTES)
    low = np.concatenate([near_ids(v, n) + base for v, base, n in zip(pdf["low"], pdf["base"], sizes, strict=True)])
    many = np.concatenate([np.unpackbits(np.frombuffer(v, np.uint8), count=n) for v, n in zip(pdf["many"], sizes, strict=True)])
    order = np.lexsort((low, keys))
    sorted_keys, sorted_low = keys[order], low[order]
    first = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
    run = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    last = sorted_low[np.append(begin[1:], len(keys)) - 1]
    shared = (last != sorted_low[begin]) | (np.bitwise_or.reduceat(many[order], begin) > 0)
    held = np.minimum(np.diff(np.append(begin, len(keys))), 255).astype(np.uint8)
    use, pivot, holders = np.empty(len(keys), bool), np.empty(len(keys), np.int64), np.empty(len(keys), np.uint8)
    use[order], pivot[order], holders[order] = shared[run], sorted_low[begin][run], held[run]
    at = np.concatenate([[0], np.cumsum(sizes)])
    parts = [slice(a, b) for a, b in zip(at, at[1:], strict=False)]
    out = pd.DataFrame(
        {
            "block": pdf["block"],
            "start": pdf["start"],
            "size": sizes,
            "used": [bs.packed(np.packbits(use[k])) for k in parts],
            "pivots": [bs.packed(near(pivot[k][use[k]])) for k in parts],
            "holders": [bs.packed(holders[k][use[k]]) for k in parts],
        }
    )
    return out[out["pivots"].map(len) > 0]


_MET_DDL = "block string, start int, size int, used binary, pivots binary, holders binary"


def _memberships(blocks: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
    """The distinct (text, pivot) pairs of one block, by the rarest shared shingles of each text."""
    if blocks.empty or back.empty:
        return pd.DataFrame({"doc_id": np.zeros(0, np.int64), "pivot": np.zeros(0, np.int64)})
    row = blocks.iloc[0]
    own = bs.widened([row["prefix"]], PREFIX_BYTES)
    ids, lengths = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int32)
    needs = np.frombuffer(row["needs"], np.int32)
    owner = np.repeat(np.arange(len(ids)), lengths)
    distinct, number = np.unique(own, return_inverse=True)
    used, pivots, holders = np.zeros(len(distinct), bool), np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.uint8)
    for start, size, bits, low, held in zip(back["start"], back["size"], back["used"], back["pivots"], back["holders"], strict=True):
        at = start + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=size))
        used[at], pivots[at], holders[at] = True, near_ids(low, len(at)), np.frombuffer(held, np.uint8)
    owner, number = owner[used[number]], number[used[number]]
    # The same order in all blocks; numbers are in the order of the shingles.
    order = np.lexsort((number, holders[number], owner))
    owner, number = owner[order], number[order]
    at = bs.group_starts(owner, len(ids))
    keep = np.arange(len(owner)) - at[owner] <= (np.diff(at) - needs)[owner]
    return pd.DataFrame({"doc_id": ids[owner[keep]], "pivot": pivots[number[keep]]}).drop_duplicates()


_VECTORS_DDL = "doc_id long, n long, vector binary"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("vector", pa.binary())])
    for piece in bs.pieces(batches):
        hashes, at = shingles(piece)
        vectors = [packed_counts(hashes[a:b]) for a, b in zip(at, at[1:], strict=False)]
        yield bs.batch_of(schema, piece.column("doc_id").to_pylist(), np.diff(at), vectors)


_SETS_DDL = "doc_id long, n long, shingles binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])
    for piece in bs.pieces(batches):
        hashes, at = shingles(piece)
        sets = [bs.squeezed(hashes[a:b], HASH_BYTES) for a, b in zip(at, at[1:], strict=False)]
        yield bs.batch_of(schema, piece.column("doc_id").to_pylist(), np.diff(at), sets)


def _within_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, n_b = batch.column("n").to_numpy(), batch.column("n_b").to_numpy()
        vectors = zip(batch.column("vector").to_pylist(), batch.column("vector_b").to_pylist(), strict=True)
        both = [counts_of(pair, np.array(sizes)) for pair, *sizes in zip(vectors, n, n_b, strict=True)]
        bound = np.array([np.minimum(*pair).sum(dtype=np.int64) for pair in both], np.int64)
        yield batch.select(["a", "b"]).filter(pa.array(7 * bound >= 3 * (n + n_b)))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Members that two sorted sets have in common."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = common(a, b)
    return both > 0 and 100 * both >= 75 * (len(a) + len(b) - both)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [
            linked(bs.widened([x], HASH_BYTES), bs.widened([y], HASH_BYTES))
            for x, y in zip(batch.column("shingles").to_pylist(), batch.column("shingles_b").to_pylist(), strict=True)
        ]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class CountTree:
    """An R-tree over count vectors, packed bottom-up from points in order of size and mass.

    A node knows the largest count per group and the range of set sizes below it.
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray) -> None:
        # Neighbours in size first, then by how their counts lie over the groups.
        lean = vectors @ np.arange(vectors.shape[1])
        self.order = np.lexsort((lean, sizes))
        self.levels = [(vectors[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > 1:
            top, small, large = self.levels[-1]
            at = np.arange(0, len(top), LEAF)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(small, at), np.maximum.reduceat(large, at)))

    def candidates(self, vectors: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) whose overlap bound and sizes allow a link."""
        query = np.arange(len(vectors))
        node = np.zeros(len(vectors), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, small, large = self.levels[depth]
            if depth < len(self.levels) - 1:
                fan = np.arange(LEAF)
                query = np.repeat(query, LEAF)
                node = (node[:, None] * LEAF + fan).ravel()
                query, node = query[node < len(top)], node[node < len(top)]
            own = sizes[query]
            fits = (4 * large[node] >= 3 * own) & (3 * small[node] <= 4 * own)
            query, node = query[fits], node[fits]
            keep = np.zeros(len(query), bool)
            step = (1 << 21) // vectors.shape[1]
            for a in range(0, len(query), step):
                q, x = query[a : a + step], node[a : a + step]
                bound = np.minimum(vectors[q], top[x]).sum(1, dtype=np.int64)
                keep[a : a + step] = 7 * bound >= 3 * (sizes[q] + small[x])
            query, node = query[keep], node[keep]
        return query, self.order[node]


def _candidates(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]:
    """Residents, those who look for them, and the pairs of different components in bound."""
    residents, visitors = pdf[~pdf["visits"]], pdf[pdf["visits"]]
    left = visitors if len(visitors) else residents
    if residents.empty:
        return residents, left, np.zeros(0, np.int64), np.zeros(0, np.int64)
    vectors, visits = counts_of(pdf["vector"], pdf["n"].to_numpy()), pdf["visits"].to_numpy()
    left_n, right_n = left["n"].to_numpy(), residents["n"].to_numpy()
    tree = CountTree(vectors[~visits], right_n)
    q, x = tree.candidates(vectors[visits] if len(visitors) else vectors, left_n)
    keep = left["component"].to_numpy()[q] != residents["component"].to_numpy()[x]
    # Two members from below the cell's sizes meet in the cell below.
    keep &= np.maximum(left_n[q], right_n[x]) >= 1 << int(pdf["cell"].iloc[0]) - 1
    if not len(visitors):
        keep &= left["doc_id"].to_numpy()[q] < residents["doc_id"].to_numpy()[x]
    return residents, left, q[keep], x[keep]


def _active(pdf: pd.DataFrame) -> pd.DataFrame:
    """The members of one chunk that have a possible partner in another component."""
    residents, left, q, x = _candidates(pdf)
    rows = pd.concat([left.iloc[np.unique(q)], residents.iloc[np.unique(x)]])
    return rows[list(_PLACE)].drop_duplicates()


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """New links between components in one chunk: residents among themselves, or with visitors."""
    sets = [bs.widened([v], HASH_BYTES) for v in pdf.pop("shingles")]
    pdf["vector"], pdf["row"] = [packed_counts(s) for s in sets], np.arange(len(pdf))
    residents, left, q, x = _candidates(pdf)
    left_id, right_id = left["doc_id"].to_numpy(), residents["doc_id"].to_numpy()
    left_root, right_root = left["component"].to_numpy(), residents["component"].to_numpy()
    left_row, right_row = left["row"].to_numpy(), residents["row"].to_numpy()
    forest, links = Forest(), []
    for i, j in zip(q.tolist(), x.tolist(), strict=True):
        a, b = int(left_root[i]), int(right_root[j])
        if forest.find(a) != forest.find(b) and linked(sets[left_row[i]], sets[right_row[j]]):
            forest.join(a, b)
            links.append((int(left_id[i]), int(right_id[j])))
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


_PLACE = ("pivot", "cell", "chunk", "from", "doc_id", "component", "visits")
_PLACE_DDL = "pivot long, cell int, chunk long, `from` long, doc_id long, component long, visits boolean"


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets of the texts with these ids (doc_id), written once."""
    # Runtime filters are built from filtered scans only; conditions on stored steps that
    # always hold (here and below) make them so.
    ids = stored(ids.distinct().withColumn("asked", F.lit(1)), "asked").where("asked > 0")
    return stored(docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets, _SETS_DDL), "sets").where("n > 0")


def _with_sets(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    other = sets.select(F.col("doc_id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    own = sets.select(F.col("doc_id").alias("a"), *columns)
    return pairs.join(own, "a").join(other, "b")


def shingle_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text)."""
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs))
    blocks = stored(docs.mapInArrow(_blocks(frequent), _BLOCKS_DDL), "blocks")
    rows = blocks.select(F.inline("docs"))

    same = rows.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    # A repeated id with different texts stands for the text of its smallest class.
    same = stored(same, "classes")

    volume = blocks.agg(F.sum(F.length("prefix")), F.count("*")).first()
    buckets = max(64, int((volume[0] or 0) // (3 << 20)))
    sent = blocks.select("block", "ids", "lengths", "prefix").mapInArrow(_send(buckets), _SENT_DDL)
    back = sent.groupBy("bucket").applyInPandas(_meet, _MET_DDL)
    own = blocks.select("block", "ids", "lengths", "needs", "prefix")
    member = own.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(_memberships, "doc_id long, pivot long")
    member = stored(member, "memberships")
    reps = same.select("rep").distinct()
    member = member.join(reps, F.col("doc_id") == F.col("rep"), "left_semi").distinct()
    crowd = member.groupBy("pivot").agg(F.count("*").alias("members")).where("members > 1")
    member = stored(member.join(crowd, "pivot").select("doc_id", "pivot", "members"), "tiles").where("members > 1")

    # Members are representatives already.
    texts = docs.join(member.select("doc_id"), "doc_id", "left_semi")
    vectors = stored(texts.mapInArrow(_vectors, _VECTORS_DDL), "vectors").where("n > 0")
    sizes = vectors.select("doc_id", "n").distinct()

    star = member.where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))
    star = _with_sets(star, sizes, "n").where("4 * n >= 3 * n_b and 4 * n_b >= 3 * n").select("a", "b").distinct()
    star = _with_sets(star, vectors, "n", "vector").mapInArrow(_within_bound, "a long, b long").distinct()
    star = stored(star, "bounded").where("a <> b")
    sets = _sets_of(docs, star.select(F.explode(F.array("a", "b")).alias("doc_id")))
    links = stored(_with_sets(star, sets, "shingles").select("a", "b", "shingles", "shingles_b").mapInArrow(_checked, "a long, b long"), "links")
    known = components(links)

    placed = member.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(sizes, "doc_id")
    # A cell holds sizes of as many binary digits, and those below that may link to them.
    digits = F.length(F.bin("n"))
    reaches = F.col("n") * 4 >= F.lit(3) * F.expr("shiftleft(1L, length(bin(n)))")
    cells = F.explode(F.when(reaches, F.array(digits, digits + 1)).otherwise(F.array(digits)))
    placed = placed.select("pivot", cells.alias("cell"), "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    tile = ("pivot", "cell")
    mixed = placed.groupBy(*tile).agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.count("*").alias("all"),
        F.max((F.col("doc_id") == F.col("pivot")).cast("int")).alias("has_pivot"),
        F.max(digits).alias("most"),
    )
    # The pivot itself has been compared with every member.
    mixed = mixed.where("low <> high and all - has_pivot > 1 and most = cell")
    placed = stored(placed.join(mixed.select(*tile, "all"), [*tile]).drop("n"), "mixed")
    parts = placed.groupBy(*tile, "component").agg(F.count("*").alias("k"))
    main = parts.groupBy(*tile).agg(F.max(F.struct("k", "component")).alias("top"))
    placed = placed.join(main.select(*tile, F.col("top.component").alias("main")), [*tile])
    chunks = F.ceil(F.col("all") / CHUNK)
    placed = placed.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")))
    home = placed.select(*tile, "chunk", F.lit(-1).cast("long").alias("from"), "doc_id", "component", F.lit(False).alias("visits"))
    # In cells of several chunks, members outside the main component meet every chunk, and
    # the residents are sent once more for each chunk of such visitors.
    outside = placed.where("chunks > 1 and component <> main")
    groups = outside.select(*tile, F.col("chunk").alias("from")).distinct()
    hosts = placed.where("chunks > 1").join(groups, [*tile]).select(*tile, "chunk", "from", "doc_id", "component", F.lit(False).alias("visits"))
    guests = outside.select(
        *tile, F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("to"), F.col("chunk").alias("from"), "doc_id", "component"
    ).select(*tile, F.col("to").alias("chunk"), "from", "doc_id", "component", F.lit(True).alias("visits"))
    key = (*tile, "chunk", "from")
    work = home.union(hosts).union(guests).join(vectors, "doc_id")
    active = stored(work.groupBy(*key).applyInPandas(_active, _PLACE_DDL), "active").where("chunk >= 0")
    sets = _sets_of(docs, active.select("doc_id"))
    found = active.join(sets, "doc_id").groupBy(*key).applyInPandas(_search, "a long, b long")
    links = links.union(stored(found, "found"))
    final = components(links)

    class_of = same.join(final, F.col("rep") == F.col("node"), "left").select(
        "n", "s1", "s2", F.coalesce("component", "rep").alias("component")
    )
    # Copies may stand in other classes too when an id repeats: the id is then one node.
    out = rows.join(class_of, ["n", "s1", "s2"], "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )
