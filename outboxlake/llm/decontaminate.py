"""Benchmark decontamination on template windows.

Words become template codes: digits are numbers, a run of capitalised words inside a
sentence is a name, a known unit after a number is a unit, anything else is itself in lower
case. Windows of eight template words are looked up in a hash table of the benchmark's
windows. Windows of one text and one item that lie on the same diagonal form a match; its
slots must be consistent: the same value of the item always stands for the same value of the
text. So a question whose numbers or names were replaced is found, and two texts that only
share a mould with clashing values are not.

A text leaks an item when a consistent match covers at least 13 template words, or all words
(but the first, which may read as a name elsewhere) of an item of fewer; the share of the item that is covered is returned too.

The benchmark is sent to the tasks in blocks of at most `BLOCK_WINDOWS` windows, whole items
at a time, and the texts are scanned once per block; nothing is shuffled. Null or empty
texts and items match nothing; items of fewer than `WINDOW` template words are looked up as
a whole window of their own length if they have five words or more. Rows with a repeated id
are matched each for itself. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outboxlake.llm import bytescan as bs
from outboxlake.llm.store import prepare

WINDOW = 8
SHORTEST = 5
COVER = 13
#: Plain words a window must hold, so that bare moulds do not match everything.
LITERALS = 4
BLOCK_WINDOWS = 1 << 20
BLOCK_ITEMS = 20_000

#: Units that follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s ms min mins h hr hrs day days week weeks month months year years "
    "second seconds minute minutes hour hours meter meters metre metres kilometer kilometers kilometre kilometres mile miles "
    "inch inches foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres "
    "dollar dollars euro euros cent cents percent degree degrees usd eur"
).split()

_BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\n"]] = True

PLAIN, NUMBER, NAME, UNIT = 0, 1, 2, 3
_SLOT_CODES = bs.mix(np.arange(1, 4, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _unit_codes() -> np.ndarray:
    data, at = bs.flat(pa.array(UNITS))
    start, end, _ = bs.words(data, at, _BREAKS)
    return np.sort(bs.word_codes(data, start, end))


_UNIT_CODES = _unit_codes()


@dataclass
class Templates:
    """The template words of some texts, each with its bytes and, for slots, a value code."""

    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    code: np.ndarray
    kind: np.ndarray
    value: np.ndarray


def templates(texts: pa.Array) -> Templates:
    raw, at = bs.flat(texts)
    data = bs.LOWER[raw]
    start, end, owner = bs.words(data, at, _BREAKS)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Templates(none, none, none, np.zeros(0, np.uint64), none, np.zeros(0, np.uint64))
    value = bs.word_codes(data, start, end)
    kind = np.zeros(len(start), np.int64)
    kind[_DIGIT[raw[start]]] = NUMBER
    new_text = np.append(True, owner[1:] != owner[:-1])
    # A capital counts as a name only where no sentence begins.
    stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
    previous = np.append(0, end[:-1])
    opens = new_text | (stops[start] > stops[previous])
    kind[_UPPER[raw[start]] & ~opens] = NAME
    after_number = np.append(False, kind[:-1] == NUMBER) & ~new_text
    place = np.minimum(np.searchsorted(_UNIT_CODES, value), len(_UNIT_CODES) - 1)
    kind[after_number & (_UNIT_CODES[place] == value) & (kind == PLAIN)] = UNIT
    # A number with separators, and a run of names, is one slot.
    gap = np.append(0, start[1:] - end[:-1])
    goes_on = np.append(False, (kind[1:] == kind[:-1]) & (owner[1:] == owner[:-1]))
    goes_on &= ((kind == NUMBER) & (gap == 1) & ~bs.SPACES[data[np.maximum(start - 1, 0)]]) | ((kind == NAME) & (gap == 1))
    first = np.flatnonzero(~goes_on)
    last = np.append(first[1:], len(start)) - 1
    many = last > first
    merged = value[first]
    if many.any():
        merged = merged.copy()
        merged[many] = bs.word_codes(data, start[first[many]], end[last[many]])
    kind = kind[first]
    code = np.where(kind > 0, _SLOT_CODES[np.maximum(kind - 1, 0)], merged)
    return Templates(start[first], end[last], owner[first], code, kind, merged)


def _useful(t: Templates, first: np.ndarray, size: int) -> np.ndarray:
    plain = np.concatenate([[0], np.cumsum(t.kind == PLAIN)])
    return plain[first + size] - plain[first] >= min(LITERALS, size)


class Index:
    """The windows of a block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        self.ids = ids
        self.words = templates(pa.array(texts, pa.string()))
        bounds = bs.group_starts(self.words.owner, len(ids))
        self.bounds = bounds
        self.counts = np.diff(bounds)
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        hashes, first = bs.windows(self.words.code, self.words.owner, WINDOW)
        keep = _useful(self.words, first, WINDOW)
        found[WINDOW].append((hashes[keep], first[keep]))
        for size in range(SHORTEST, WINDOW):
            hashes, first = bs.windows(self.words.code, self.words.owner, size)
            keep = (self.counts[self.words.owner[first]] == size) & _useful(self.words, first, size)
            if keep.any():
                found[size].append((hashes[keep], first[keep]))
        self.tables = {}
        for size, parts in found.items():
            hashes, first = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            order = np.argsort(hashes, kind="stable")
            near = np.zeros(1 << 20, bool)
            near[hashes & np.uint64(0xFFFFF)] = True
            self.tables[size] = (hashes[order], first[order], near)

    def hits(self, t: Templates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word number in the texts, word number in the items and size of every equal window."""
        out = []
        for size, (keys, where, near) in self.tables.items():
            hashes, first = bs.windows(t.code, t.owner, size)
            maybe = np.flatnonzero(near[hashes & np.uint64(0xFFFFF)])
            hashes, first = hashes[maybe], first[maybe]
            low, high = np.searchsorted(keys, hashes, "left"), np.searchsorted(keys, hashes, "right")
            n = high - low
            total = int(n.sum())
            step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            out.append((np.repeat(first, n), where[np.repeat(low, n) + step], np.full(total, size)))
        return tuple(np.concatenate([o[k] for o in out]) for k in range(3)) if out else (np.zeros(0, np.int64),) * 3


def matches(t: Templates, index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, covered words, first word, last word, replaced slots) of consistent matches."""
    at, of, size = index.hits(t)
    groups: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
    items = index.words.owner[of]
    for a, b, item, text, n in zip(at.tolist(), of.tolist(), items.tolist(), t.owner[at].tolist(), size.tolist(), strict=True):
        groups[(text, item, a - b)].append((b, n))
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for (text, item, shift), found in groups.items():
        covered = sorted({b + j for b, n in found for j in range(n)})
        # The first word may read as a name inside another sentence.
        whole = int(index.counts[item])
        enough = min(COVER, whole - 1 if whole > WINDOW else whole)
        if len(covered) < enough:
            continue
        stands_for: dict[tuple[int, int], int] = {}
        replaced, consistent = set(), True
        for b in covered:
            if kind := int(index.words.kind[b]):
                own, other = int(index.words.value[b]), int(t.value[b + shift])
                consistent &= stands_for.setdefault((kind, own), other) == other
                if own != other:
                    replaced.add((kind, own))
        if consistent:
            row = (len(covered), covered[0] + shift, covered[-1] + shift, len(replaced))
            best[(text, item)] = max(best.get((text, item), row), row)
    return [(text, item, *row) for (text, item), row in sorted(best.items())]


_OUT = pa.schema(
    [(k, pa.int64()) for k in ("doc_id", "item_id", "matched_words", "item_words", "replaced_slots", "start_byte", "end_byte")]
)
_OUT_DDL = ", ".join(f"{f.name} long" for f in _OUT)


def _scan(index):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = index.value
        for piece in bs.pieces(batches):
            t = templates(piece.column("text"))
            found = matches(t, table)
            if found:
                at = bs.flat(piece.column("text"))[1]
                ids = piece.column("doc_id").to_pylist()
                rows = [
                    (ids[d], table.ids[i], n, int(table.counts[i]), r, int(t.start[a] - at[d]), int(t.end[b] - at[d]))
                    for d, i, n, a, b, r in found
                ]
                yield bs.batch_of(_OUT, *([r[k] for r in rows] for k in range(len(_OUT))))

    return scan


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    ids, texts, words = [], [], 0
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        words += len(row["text"].split())
        if words >= BLOCK_WINDOWS or len(ids) >= BLOCK_ITEMS:
            yield Index(ids, texts)
            ids, texts, words = [], [], 0
    if ids:
        yield Index(ids, texts)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per text and item of `benchmark` (item_id, text) that it leaks.

    matched_words of item_words template words were found; replaced_slots counts values that
    differ from the item's; start_byte and end_byte give the place in the text.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for index in _blocks(benchmark):
        found = texts.mapInArrow(_scan(spark.sparkContext.broadcast(index)), _OUT_DDL)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], _OUT_DDL) if out is None else out


def _keep(index):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in bs.pieces(batches):
            clean = np.ones(piece.num_rows, bool)
            clean[[m[0] for m in matches(templates(piece.column("text")), index.value)]] = False
            yield piece.filter(pa.array(clean))

    return scan


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that leak no item."""
    spark = prepare(docs.sparkSession)
    for index in _blocks(benchmark):
        docs = docs.mapInArrow(_keep(spark.sparkContext.broadcast(index)), docs.schema)
    return docs
