"""Exact substring dedup with range-partitioned suffixes.

A byte goes if a 50-byte string that covers it also starts in a text with a smaller id.
Strings are judged on the input; matches never cross texts.

Sorting every suffix would move fifty times the input. Instead:

1. Texts are packed into compressed blocks, written once.
2. Each 50-byte string has an anchor: the start of its 20-byte gram with the least hash,
   the first of equals. Equal strings have their anchors at equal places, so suffixes need
   only be compared at anchors, about one position in sixteen. Blocks exchange their
   distinct anchor grams and learn which of them stand in other texts too; unique text ends
   here.
3. The suffixes at shared anchors, with the bytes before them that belong to strings of the
   anchor, are range-partitioned by sampled splitters of their leading 20 bytes. Equal
   suffixes of one block travel once, with the block's smallest id, so a passage held by a
   third of all texts costs one row a block. Splitters never part equal leading bytes, so
   every boundary can be decided inside a bucket.
4. Buckets sort their suffixes by multikey sort (one 8-byte key after the other, ties only)
   and read runs of equal prefixes off the common-prefix lengths of neighbours. For each
   distance between string and anchor, equal strings are those with an equal run and equal
   bytes before the anchor; the smallest id among them goes back to the blocks.
   Whole contexts that are equal are told apart from others by 128 bits of two independent
   hashes, grams (which only nominate) by 40 bits beside their bucket.
5. Blocks mark the strings whose smallest id is below their text's and cut the union.

Null text is empty. A null id counts as larger than all others. Rows with equal ids do not
remove from each other. Texts below 50 bytes are kept whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outboxlake.llm import bytescan as bs
from outboxlake.llm.store import prepare, stored

SPAN = 50
GRAM = 20
BEFORE = SPAN - GRAM
BLOCK_BYTES = 1 << 20
#: Bytes of text whose anchors are found at a time.
STEP_BYTES = 1 << 17
#: Leading grams that the splitters are chosen from.
SAMPLE = 20_000
_NO_ID = np.iinfo(np.int64).max
_PLACE = np.uint64((1 << 30) - 1)
_SPREAD = np.uint64(0xD1342543DE82EF95)

_BLOCKS = pa.schema(
    [("block", pa.string()), ("ids", pa.binary()), ("lengths", pa.binary()), ("size", pa.int64()), ("data", pa.binary()), ("sample", pa.list_(pa.binary()))]
)
_BLOCKS_DDL = "block string, ids binary, lengths binary, size long, data binary, sample array<binary>"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    partition, k = TaskContext.get().partitionId(), 0
    for piece in bs.pieces(batches, limit=BLOCK_BYTES, most=1 << 20):
        data, at = bs.flat(piece.column("text"))
        ids = piece.column("doc_id").fill_null(_NO_ID).to_numpy()
        raw = data.tobytes()
        some = [raw[i : i + GRAM] for i in range(17, max(len(raw) - GRAM, 0), max(len(raw) // 64, 1))]
        yield bs.batch_of(
            _BLOCKS,
            [f"{partition}-{k}"],
            [bs.packed(ids.astype(np.int64))],
            [bs.packed(np.diff(at).astype(np.int64))],
            [len(raw)],
            [pa.Codec("zstd", 9).compress(raw, asbytes=True)],
            [some],
        )
        k += 1


_SECOND = np.random.default_rng(20240503).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _second_sums(data: np.ndarray) -> np.ndarray:
    """Running sums as `bytescan.prefix_hash`, of other codes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SECOND[data] * bs.powers(len(data))[0][: len(data)], out=sums[1:])
    return sums


def _anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, first, last) places and (gram, context, second context) hashes of the anchors of these texts."""
    n = len(data)
    ends = np.repeat(at[1:], np.diff(at))
    whole = np.flatnonzero(np.arange(n) + SPAN <= ends)
    if not len(whole):
        return np.zeros((3, 0), np.int64), np.zeros((3, 0), np.uint64)
    sums = bs.prefix_hash(data)
    grams = bs.mix((sums[GRAM:] - sums[:-GRAM]) * bs.powers(n)[1][: n - GRAM + 1])
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= BEFORE + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = BEFORE + 1 - width
    least = np.minimum(least[: len(least) - rest], least[rest:])
    place = (least[whole] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    anchor, first = place[new], whole[new]
    last = whole[np.append(new[1:], len(place)) - 1]
    shape = ((anchor - first) * 64 + last - anchor + BEFORE).astype(np.uint64)
    context = bs.mix(bs.span_hash(sums, first, last + SPAN) ^ bs.mix(shape))
    second = bs.mix(bs.span_hash(_second_sums(data), first, last + SPAN) ^ shape)
    # Anchors are least hashes, so they crowd near zero: spread again before they are dealt out.
    return np.stack([anchor, first, last]), np.stack([bs.mix(grams[anchor] ^ _SPREAD), context, second])


class Block:
    """The texts of one block and their anchors."""

    def __init__(self, row) -> None:
        self.ids = np.frombuffer(row["ids"], np.int64)
        lengths = np.frombuffer(row["lengths"], np.int64)
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        raw = pa.decompress(row["data"], row["size"], "zstd", asbytes=True) if row["size"] else b""
        self.data = np.frombuffer(raw, np.uint8)

    def find_anchors(self) -> None:
        """`anchor` places, `gram` and context hashes, and first and last start of each anchor's strings.

        Texts are taken a few at a time, so that working memory does not grow with the block.
        """
        parts, text = [np.zeros((3, 0), np.int64)], 0
        hashes = [np.zeros((3, 0), np.uint64)]
        while text < len(self.ids):
            end = max(int(np.searchsorted(self.at, self.at[text] + STEP_BYTES, "right")) - 1, text + 1)
            places, found = _anchors(self.data[self.at[text] : self.at[end]], self.at[text : end + 1] - self.at[text])
            parts.append(places + self.at[text])
            hashes.append(found)
            text = end
        self.anchor, self.first, self.last = np.concatenate(parts, axis=1)
        self.gram, self.whole, self.second = np.concatenate(hashes, axis=1)
        self.owner = np.searchsorted(self.at, self.anchor, "right") - 1

    def find_contexts(self) -> None:
        """Distinct (gram, context) in order: their hashes, smallest and largest ids, one anchor each;
        `number` of every anchor."""
        self.find_anchors()
        if not len(self.anchor):
            self.number = self.one = self.low = self.high = np.zeros(0, np.int64)
            self.keys = np.zeros(0, np.uint64)
            self.context = np.zeros((0, 2), np.uint64)
            return
        order = np.lexsort((self.second, self.whole, self.gram))
        gram, context = self.gram[order], np.column_stack([self.whole[order], self.second[order]])
        new = np.append(True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1]).any(axis=1))
        begin = np.flatnonzero(new)
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        ids = self.ids[self.owner[order]]
        self.low, self.high = np.minimum.reduceat(ids, begin), np.maximum.reduceat(ids, begin)
        self.keys, self.context, self.one = gram[begin], context[begin], order[begin]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


#: Bytes that travel of a gram's hash (beside its bucket); a context's hashes travel whole.
_GRAM_BYTES = 5
_OFFER_DDL = "bucket int, block string, start int, base long, keys binary, contexts binary, low binary, many binary"


def _offer(buckets: int):
    schema = pa.schema(
        [("bucket", pa.int32()), ("block", pa.string()), ("start", pa.int32()), ("base", pa.int64())]
        + [(c, pa.binary()) for c in ("keys", "contexts", "low", "many")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                block.find_contexts()
                if not len(block.keys):
                    continue
                base = int(block.ids.min())
                # Four bytes an id where the block's ids lie close enough.
                wide = int(block.ids.max()) - base >= 1 << 32
                low = block.low if wide else (block.low - base).astype(np.uint32)
                cut = np.searchsorted(_bucket(block.keys, buckets), np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cut))
                parts = [slice(cut[b], cut[b + 1]) for b in full]
                yield bs.batch_of(
                    schema,
                    full,
                    [row["block"]] * len(full),
                    cut[full],
                    [base] * len(full),
                    [bs.squeezed(block.keys[k], _GRAM_BYTES) for k in parts],
                    [bs.packed(block.context[k]) for k in parts],
                    [bs.packed(low[k]) for k in parts],
                    [bs.packed(np.packbits(block.low[k] != block.high[k])) for k in parts],
                )

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """For every block of a bucket: its contexts of grams in more than one text, with the smallest ids."""
    sizes = pdf["keys"].map(len).to_numpy() // _GRAM_BYTES
    keys = bs.widened(list(pdf["keys"]), _GRAM_BYTES)
    contexts = np.frombuffer(b"".join(pdf["contexts"]), np.uint64).reshape(-1, 2)
    lows = zip(pdf["low"], pdf["base"], sizes, strict=True)
    low = np.concatenate(
        [np.frombuffer(v, np.uint32).astype(np.int64) + b if len(v) == 4 * n else np.frombuffer(v, np.int64) for v, b, n in lows]
    )
    many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(pdf["many"], sizes, strict=True)])
    of = np.repeat(np.arange(len(pdf)), sizes)
    place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(pdf["start"].to_numpy(), sizes)
    order = np.lexsort((contexts[:, 1], contexts[:, 0], keys))
    keys, contexts, low = keys[order], contexts[order], low[order]
    new = np.append(True, keys[1:] != keys[:-1])
    begin = np.flatnonzero(new)
    texts = (np.maximum.reduceat(low, begin) != np.minimum.reduceat(low, begin)) | (np.maximum.reduceat(many[order], begin) > 0)
    use = np.repeat(texts, np.diff(np.append(begin, len(keys))))
    both = np.flatnonzero(new | np.append(True, (contexts[1:] != contexts[:-1]).any(axis=1)))
    least = np.repeat(np.minimum.reduceat(low, both), np.diff(np.append(both, len(keys))))
    index, least = order[use], least[use]
    back = np.argsort(index)
    index, least = index[back], least[back]
    cut = np.searchsorted(of[index], np.arange(len(pdf) + 1))
    full = np.flatnonzero(np.diff(cut))
    return pd.DataFrame(
        {
            "block": pdf["block"].to_numpy()[full],
            "numbers": [bs.packed(place[index[cut[b] : cut[b + 1]]].astype(np.int32)) for b in full],
            "masks": None,
            "low": [bs.packed(least[cut[b] : cut[b + 1]]) for b in full],
        }
    )


_NOTES_DDL = "block string, numbers binary, masks binary, low binary"
_CONTEXTS = ("bucket", "block", "numbers", "bytes", "ranges", "low")
_CONTEXTS_DDL = "bucket int, block string, numbers binary, bytes binary, ranges binary, low binary"


def _told(block: Block, notes: pd.DataFrame) -> np.ndarray:
    """The smallest id of each of the block's contexts, or the largest number where none was told."""
    least = np.full(len(block.keys), _NO_ID)
    if len(notes):
        least[np.frombuffer(b"".join(notes["numbers"]), np.int32)] = np.frombuffer(b"".join(notes["low"]), np.int64)
    return least


def _contexts(splitters):
    def run(blocks: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if blocks.empty or back.empty:
            return pd.DataFrame({c: pd.Series(dtype="object") for c in _CONTEXTS})
        row = blocks.iloc[0]
        block = Block(row)
        block.find_contexts()
        known = np.zeros(len(block.keys), bool)
        known[np.frombuffer(b"".join(back["numbers"]), np.int32)] = True
        number = np.flatnonzero(known & (block.low == _told(block, back)))
        one = block.one[number]
        anchor, first, last = block.anchor[one], block.first[one], block.last[one]
        context = np.zeros((len(anchor), BEFORE + SPAN), np.uint8)
        for a in range(0, len(anchor), 1 << 13):
            at = slice(a, a + (1 << 13))
            # Bytes outside the anchor's own strings are left out of its context.
            place = anchor[at, None] + np.arange(-BEFORE, SPAN)
            inside = (place >= first[at, None]) & (place < (last[at] + SPAN)[:, None])
            context[at] = np.where(inside, block.data[np.clip(place, 0, len(block.data) - 1)], 0)
        ranges = np.column_stack([anchor - last, anchor - first]).astype(np.uint8)
        rows = []
        lead = np.ascontiguousarray(context[:, BEFORE : BEFORE + GRAM]).view(f"S{GRAM}").ravel()
        to = np.searchsorted(splitters.value, lead, "right")
        order = np.argsort(to, kind="stable")
        cut = np.flatnonzero(np.append(True, to[order][1:] != to[order][:-1])) if len(to) else []
        for a, b in zip(cut, np.append(cut[1:], len(to)) if len(to) else [], strict=True):
            k = order[a:b]
            packed = pa.compress(bs.packed(context[k]), "zstd", asbytes=True)
            rows.append((int(to[k[0]]), row["block"], bs.packed(number[k].astype(np.int32)), packed, bs.packed(ranges[k]), bs.packed(block.low[number[k]])))
        return pd.DataFrame(rows, columns=list(_CONTEXTS))

    return run


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """Order of rows of 8-byte keys: sorts by the first, then only ties by the next, and so on."""
    order = np.argsort(keys[:, 0], kind="stable")
    for depth in range(1, keys.shape[1]):
        ordered = keys[order, :depth]
        same = (ordered[1:] == ordered[:-1]).all(axis=1)
        tied = np.append(same, False) | np.append(False, same)
        if not tied.any():
            break
        # Runs of equal keys so far are sorted by the next key within the run.
        run = np.cumsum(np.append(True, ~same))
        at = np.flatnonzero(tied)
        order[at] = order[at[np.lexsort((keys[order[at], depth], run[at]))]]
    return order


def smallest_ids(context: np.ndarray, ranges: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, distances, id): strings of a row at these distances start in a text with that smaller id."""
    n = len(context)
    right = np.zeros((n, 56), np.uint8)
    right[:, :SPAN] = context[:, BEFORE:]
    order = multikey_order(right.view(">u8").astype(np.uint64))
    context, ranges, low = context[order], ranges[order], low[order]
    suffix = context[:, BEFORE:]
    differs = suffix[1:] != suffix[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), SPAN)
    before = np.zeros(n, np.uint64)
    rows, masks, ids = [], [], []
    for distance in range(BEFORE + 1):
        if distance:
            before = before * np.uint64(0x100000001B3) + context[:, BEFORE - distance] + np.uint64(1)
        has = np.flatnonzero((ranges[:, 0] <= distance) & (distance <= ranges[:, 1]))
        if len(has) < 2:
            continue
        run = np.cumsum(np.append(True, common < SPAN - distance)).astype(np.uint64)[has]
        key = bs.mix(run * np.uint64(0x9E3779B97F4A7C15) ^ bs.mix(before[has]))
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        left = context[has[by], BEFORE - distance : BEFORE]
        differ = (run[by][1:] != run[by][:-1]) | (left[1:] != left[:-1]).any(axis=1)
        if (same & differ).any():
            # Two strings share a hash: their bytes are the key.
            by = np.lexsort((*left[np.argsort(by)].T, run))
            left = context[has[by], BEFORE - distance : BEFORE]
            same = (run[by][1:] == run[by][:-1]) & (left[1:] == left[:-1]).all(axis=1)
        begin = np.flatnonzero(np.append(True, ~same))
        least = np.repeat(np.minimum.reduceat(low[has][by], begin), np.diff(np.append(begin, len(by))))
        smaller = least < low[has][by]
        rows.append(order[has[by][smaller]])
        ids.append(least[smaller])
        masks.append(np.full(int(smaller.sum()), 1 << distance, np.uint32))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    rows, masks, ids = np.concatenate(rows), np.concatenate(masks), np.concatenate(ids)
    if not len(rows):
        return rows, masks, ids
    by = np.lexsort((ids, rows))
    rows, masks, ids = rows[by], masks[by], ids[by]
    begin = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])))
    return rows[begin], np.bitwise_or.reduceat(masks, begin), ids[begin]


def _sorted_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    sizes = pdf["numbers"].map(len).to_numpy() // 4
    context = np.concatenate(
        [np.frombuffer(pa.decompress(x, n * (BEFORE + SPAN), "zstd", asbytes=True), np.uint8) for x, n in zip(pdf["bytes"], sizes.tolist(), strict=True)]
    ).reshape(-1, BEFORE + SPAN)
    ranges = np.frombuffer(b"".join(pdf["ranges"]), np.uint8).reshape(-1, 2)
    low = np.frombuffer(b"".join(pdf["low"]), np.int64)
    numbers = np.frombuffer(b"".join(pdf["numbers"]), np.int32)
    of = np.repeat(np.arange(len(pdf)), sizes)
    rows, masks, ids = smallest_ids(context, ranges, low)
    by = np.argsort(of[rows], kind="stable")
    rows, masks, ids = rows[by], masks[by], ids[by]
    cut = np.searchsorted(of[rows], np.arange(len(pdf) + 1))
    full = np.flatnonzero(np.diff(cut))
    return pd.DataFrame(
        {
            "block": pdf["block"].to_numpy()[full],
            "numbers": [bs.packed(numbers[rows[cut[b] : cut[b + 1]]]) for b in full],
            "masks": [bs.packed(masks[cut[b] : cut[b + 1]]) for b in full],
            "low": [bs.packed(ids[cut[b] : cut[b + 1]]) for b in full],
        }
    )


def _starts(block: Block, notes: pd.DataFrame) -> np.ndarray:
    """The starts of strings that a text with a smaller id holds."""
    starts = np.zeros(len(block.data) + 1, bool)
    if notes.empty:
        return starts
    block.find_contexts()
    least = _told(block, notes[notes["masks"].isna()])
    number, mine = block.number, block.ids[block.owner]
    lowest, highest = block.anchor - block.last, block.anchor - block.first
    possible = (1 << (highest + 1)) - (1 << lowest)
    # Every string of a context starts in the context's smallest holder.
    mask = np.where(least[number] < mine, possible, 0)
    told = notes[notes["masks"].notna()]
    if len(told):
        to = np.frombuffer(b"".join(told["numbers"]), np.int32)
        masks = np.frombuffer(b"".join(told["masks"]), np.uint32).astype(np.int64)
        ids = np.frombuffer(b"".join(told["low"]), np.int64)
        order = np.argsort(to, kind="stable")
        to, masks, ids = to[order], masks[order], ids[order]
        begin, end = np.searchsorted(to, number, "left"), np.searchsorted(to, number, "right")
        n = end - begin
        which = np.repeat(np.arange(len(number)), n)
        entry = np.repeat(begin, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        counts = ids[entry] < mine[which]
        np.bitwise_or.at(mask, which[counts], masks[entry[counts]])
    for distance in range(BEFORE + 1):
        starts[block.anchor[(mask >> distance) & 1 > 0] - distance] = True
    return starts


_OUT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")
_OUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"


def _cut(blocks: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for _, row in blocks.iterrows():
        block = Block(row)
        total = np.cumsum(_starts(block, notes))[: len(block.data)]
        covered = total.copy()
        covered[SPAN:] -= total[:-SPAN]
        covered = covered > 0
        for k, doc_id in enumerate(block.ids.tolist()):
            a, b = int(block.at[k]), int(block.at[k + 1])
            gone = covered[a:b]
            kept, spans = block.data[a:b], []
            if gone.any():
                kept = kept[~gone]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans = [{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)]
            doc_id = None if doc_id == _NO_ID else doc_id
            rows.append((doc_id, b - a, int(gone.sum()), len(spans), hashlib.sha256(kept.tobytes()).hexdigest(), spans))
    out = pd.DataFrame(rows, columns=list(_OUT))
    out["doc_id"] = pd.array([r[0] for r in rows], "Int64")
    return out


def repeated_strings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) of every row of `docs` (doc_id, text).

    `removed` lists the maximal removed byte ranges.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = stored(docs.mapInArrow(_pack, _BLOCKS_DDL), "blocks", "none")
    texts = blocks.drop("sample")
    volume = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(64, volume // (12 << 20))
    offers = texts.mapInArrow(_offer(buckets), _OFFER_DDL)
    back = stored(offers.groupBy("bucket").applyInPandas(_shared, _NOTES_DDL), "grams")

    some = blocks.select(F.explode("sample").alias("lead")).orderBy(F.xxhash64("lead"), "lead").limit(SAMPLE)
    leads = np.sort(np.array([bytes(r["lead"]) for r in some.collect()], f"S{GRAM}"))
    ranges = min(buckets, len(leads))
    chosen = np.unique(leads[np.linspace(0, len(leads) - 1, ranges + 1).astype(int)[1:-1]]) if ranges > 1 else leads[:0]
    splitters = spark.sparkContext.broadcast(chosen)
    # The blocks are dealt out once: both cogroups read the same exchange.
    dealt = texts.groupBy("block")
    contexts = dealt.cogroup(back.groupBy("block")).applyInPandas(_contexts(splitters), _CONTEXTS_DDL)
    verdicts = contexts.groupBy("bucket").applyInPandas(_sorted_bucket, _NOTES_DDL)
    return dealt.cogroup(back.union(verdicts).groupBy("block")).applyInPandas(_cut, _OUT_DDL)
