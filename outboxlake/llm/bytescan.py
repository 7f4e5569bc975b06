"""Whole-text scans with numpy: many texts at once, as one run of bytes.

The functions take Arrow batches inside a task. A batch is cut into pieces of about a
megabyte of text (never through a text), so memory does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
PIECE_TEXTS = 256

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)

#: Bytes that end a word: space and 09-0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of the hash base and of its inverse, modulo 2 ** 64."""
    global _powers, _inverse
    if len(_powers) <= n:
        size = max(n + 1, 1 << 16)
        for_base = np.full(size, _BASE, np.uint64)
        for_base[0] = 1
        for_inverse = np.full(size, _BASE_INVERSE, np.uint64)
        for_inverse[0] = 1
        _powers, _inverse = np.cumprod(for_base), np.cumprod(for_inverse)
    return _powers, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES, most: int = PIECE_TEXTS
) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about `limit` bytes of text and at most `most` rows."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = int(np.searchsorted(total, before + limit, "right"))
            end = min(max(end, start + 1), start + most)
            yield batch.slice(start, end - start)
            start = end


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running hash sums, one longer than the data; see `span_hash`."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return (sums[end] - sums[start]) * down[start]


def words(data: np.ndarray, at: np.ndarray, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; words do not cross texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~spaces[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def group_starts(ids: np.ndarray, n: int) -> np.ndarray:
    """Offsets (n + 1) of the runs of each number below n in sorted ids."""
    return np.searchsorted(ids, np.arange(n + 1), "left")


_STEPS = mix(np.arange(1, 65, dtype=np.uint64) * _U(0xD1342543DE82EF95)) | _U(1)


def windows(codes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` codes in a row of one owner, and where each starts."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = codes[:n] * _STEPS[0]
    for j in range(1, size):
        total += codes[j : j + n] * _STEPS[j]
    start = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return mix(total[start]), start


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(span_hash(prefix_hash(data), start, end))


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def squeezed(values: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of each 64-bit word."""
    return packed(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size])


def widened(values: list[bytes], size: int) -> np.ndarray:
    few = np.frombuffer(b"".join(values), np.uint8).reshape(-1, size)
    out = np.zeros((len(few), 8), np.uint8)
    out[:, :size] = few
    return out.view("<u8").ravel().astype(np.uint64)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
