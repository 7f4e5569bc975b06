"""Secret scan with one combined automaton.

Every rule is compiled to an NFA; all of them together become one DFA by subset
construction, which is minimised and stored as a transition array over byte classes. The
scan steps that array over thousands of stretches of text at once, one byte each, and marks
the stretches in which some rule accepts. Stretches start at bytes after which the automaton
is always back at its start, so no match crosses them.

In marked stretches the rule's own pattern gives the exact ends: leftmost, not overlapping,
each kind for itself; matches that are too short are then dropped. Null is empty text.
Offsets are code points, ends exclusive. Rows are scanned each for itself, with or without
an id. Extra columns are kept by `redacted`, ignored by `spans`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as rc
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outboxlake.llm import bytescan as bs
from outboxlake.llm.store import prepare


@dataclass(frozen=True)
class Rule:
    """`trigger` is what the automaton looks for: a part of every accepted match, without long
    counted repeats, which would multiply the states."""

    kind: str
    pattern: str
    shortest: int = 0
    group: int = 0
    any_case: bool = False
    trigger: str = ""

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The rules, in the order in which kinds are listed. The first three are the base.
RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
        2,
        True,
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 18, trigger=r"AKIA[A-Z0-9]{2}"),
    Rule("hex", r"[0-9a-f]+", 16, trigger=r"[0-9a-f]{10}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", trigger=r"-----BEGIN [A-Z ]"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 24, trigger=r"gh[pousr]_[A-Za-z0-9]"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20, trigger=r"xox[abprs]-[A-Za-z0-9-]"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", trigger=r"eyJ[A-Za-z0-9_-]+\.eyJ"),
)
BASE = 3


class Automaton:
    """Transition array, accepted rules per state, and the bytes that lead every state home."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []
        start, accepts = self._state(), {}
        for k, rule in enumerate(rules):
            tree = _parser.parse(rule.trigger or rule.pattern, re.ASCII)
            first = self._state()
            self.empty[start].append(first)
            accepts[self._build(tree, first, rule.any_case)] = 1 << k
        self._determine(start, accepts)
        self._minimise()
        self.resets = (self.next == 0).all(axis=0)[self.classes]

    def _state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def _build(self, tree, at: int, any_case: bool) -> int:
        """Adds the parsed pattern behind state `at`; returns the state behind it."""
        for op, arg in tree:
            if op in (rc.LITERAL, rc.IN):
                to = self._state()
                self.edges[at].append((_bytes(op, arg, any_case), to))
                at = to
            elif op is rc.SUBPATTERN:
                at = self._build(arg[3], at, any_case)
            elif op is rc.BRANCH:
                to = self._state()
                for branch in arg[1]:
                    first = self._state()
                    self.empty[at].append(first)
                    self.empty[self._build(branch, first, any_case)].append(to)
                at = to
            elif op is rc.MAX_REPEAT:
                low, high, body = arg
                for _ in range(low):
                    at = self._build(body, at, any_case)
                if high is rc.MAXREPEAT:
                    loop = self._state()
                    self.empty[at].append(loop)
                    self.empty[self._build(body, loop, any_case)].append(loop)
                    at = loop
                else:
                    end = self._state()
                    for _ in range(high - low):
                        self.empty[at].append(end)
                        at = self._build(body, at, any_case)
                    self.empty[at].append(end)
                    at = end
            else:
                raise ValueError(f"rules must not use {op}")
        return at

    def _closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def _determine(self, start: int, accepts: dict[int, int]) -> None:
        # Bytes that no rule tells apart share a class.
        sets = {chars for out in self.edges for chars, _ in out}
        signs: dict[tuple, int] = {}
        self.classes = np.array([signs.setdefault(tuple(b in s for s in sets), len(signs)) for b in range(256)])
        one_of = {c: b for b, c in reversed(list(enumerate(self.classes.tolist())))}
        home = self._closure([start])
        number, rows, masks, todo = {home: 0}, [], [], [home]
        while todo:
            state = todo.pop(0)
            masks.append(sum(accepts.get(x, 0) for x in state))
            row = []
            for c in range(len(signs)):
                # A search: every byte may also be the first one of a match.
                to = self._closure({x for s in state for chars, x in self.edges[s] if one_of[c] in chars} | {start})
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows.append(row)
        self.next, self.accepts = np.array(rows, np.int32), np.array(masks, np.int32)

    def _minimise(self) -> None:
        """Splits classes of states until equal states are those that lead to equal ones."""
        part = np.unique(self.accepts, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([part, part[self.next]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == part.max():
                break
            part = finer
        # The start keeps number 0.
        _, first = np.unique(part, return_index=True)
        order = np.argsort(first)
        rank = np.empty(len(first), np.int64)
        rank[order] = np.arange(len(first))
        first = first[order]
        kind = np.uint16 if len(first) < 1 << 16 else np.int32
        self.next, self.accepts = rank[part[self.next[first]]].astype(kind), self.accepts[first]


def _bytes(op, arg, any_case: bool) -> frozenset[int]:
    chars: set[int] = set()
    for what, x in [(op, arg)] if op is rc.LITERAL else arg:
        if what is rc.LITERAL:
            chars.add(x)
        elif what is rc.RANGE:
            chars.update(range(x[0], x[1] + 1))
        else:
            raise ValueError(f"rules must not use {what} in a set")
    if any_case:
        chars |= {ord(c) for b in chars for c in (chr(b).lower(), chr(b).upper()) if b < 128}
    if max(chars) > 127:
        raise ValueError("rules must be ASCII")
    return frozenset(chars)


#: Bytes after which a stretch may end, and the end of a stretch without a reset.
STRETCH = 512


def stretches(data: np.ndarray, at: np.ndarray, resets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of stretches of about `STRETCH` bytes that begin after a reset or a text's start."""
    possible = np.flatnonzero(resets[data]) + 1
    # Not inside a character.
    possible = possible[(data[np.minimum(possible, len(data) - 1)] & 0xC0) != 0x80]
    possible = np.union1d(possible, at)
    slot = possible // STRETCH
    first = np.append(True, slot[1:] != slot[:-1])
    begin = np.union1d(possible[first], at)
    begin = begin[begin < len(data)]
    return begin, np.append(begin[1:], len(data)).astype(np.int64)


def scan(auto: Automaton, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The rules that accept somewhere in each stretch, as bits."""
    order = np.argsort(begin - end, kind="stable")  # longest first
    start, length = begin[order], (end - begin)[order]
    kinds = auto.classes.astype(np.uint8)[data]
    width = auto.next.shape[1]
    # States are stored as the offset of their row.
    table = auto.next.ravel().astype(np.int32) * np.int32(width)
    accepts = np.repeat(auto.accepts, width)
    found = np.zeros(len(start), np.int32)
    state = np.zeros(len(start), np.int32)
    steps = int(length[0]) if len(length) else 0
    running = np.searchsorted(-length, -np.arange(1, steps + 1), "right")
    place = start.copy()
    for step in range(steps):
        n = int(running[step])
        now = table[state[:n] + kinds[place[:n]]]
        state[:n] = now
        found[:n] |= accepts[now]
        place[:n] += 1
    out = np.zeros(len(start), np.int32)
    out[order] = found
    return out


def find_spans(rules: tuple[Rule, ...], text: str, marked: int) -> list[tuple[int, int, int]]:
    """(start, rule, end) of accepted matches of the marked rules in one stretch."""
    out = []
    for k, rule in enumerate(rules):
        if marked >> k & 1:
            for m in rule.compiled().finditer(text):
                if m.end(rule.group) - m.start(rule.group) >= rule.shortest:
                    out.append((m.start(), k, m.end()))
    return out


def batch_spans(auto: Automaton, rules: tuple[Rule, ...], texts: pa.Array) -> list[list[tuple[int, int, int]]]:
    """Sorted (start, rule, end) in code points of each text."""
    data, at = bs.flat(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    if not len(data):
        return out
    begin, end = stretches(data, at, auto.resets)
    marks = scan(auto, data, begin, end)
    hit = np.flatnonzero(marks)
    if len(hit):
        letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        owner = np.searchsorted(at, begin[hit], "right") - 1
        for k, text in zip(hit.tolist(), owner.tolist(), strict=True):
            shift = int(letters[begin[k]] - letters[at[text]])
            part = data[begin[k] : end[k]].tobytes().decode("utf-8", "replace")
            out[text] += [(a + shift, r, b + shift) for a, r, b in find_spans(rules, part, int(marks[k]))]
    return [sorted(x) for x in out]


_OUT = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def _scanner(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, rules = held.value
        for piece in bs.pieces(batches, limit=4 << 20, most=4096):
            found = [
                [{"kind": rules[r].kind, "start": a, "end": b} for a, r, b in x] for x in batch_spans(auto, rules, piece.column("text"))
            ]
            yield bs.batch_of(_OUT, piece.column("doc_id").to_pylist(), found)

    return run


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found): the secrets of every row of `docs` (doc_id, text), sorted by start and rule."""
    spark = prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast((Automaton(rules), rules))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(_scanner(held), "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def joined(found: str, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the given kinds, comma-joined."""
    part = F.filter(found, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(part, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _is_kind(kind: str):
    return lambda x: x["kind"] == kind


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digests of the base rules, and all spans as text."""
    base = tuple(r.kind for r in rules[:BASE])
    counts = [F.size(F.filter("found", _is_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    return found.select(
        "doc_id", *counts, F.sha2(joined("found", base), 256).alias("base_sha256"), joined("found", tuple(r.kind for r in rules)).alias("spans")
    )


MASK = "[SECRET]"


def _redactor(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, rules = held.value
        for piece in bs.pieces(batches, limit=4 << 20, most=4096):
            at = piece.schema.get_field_index("text")
            texts = piece.column("text")
            found = batch_spans(auto, rules, texts)
            if any(found):
                clean = [_masked(t, x) if x else t for t, x in zip(texts.to_pylist(), found, strict=True)]
                piece = piece.set_column(at, piece.schema.field(at), pa.array(clean, piece.schema.field(at).type))
            yield piece

    return run


def _masked(text: str, found: list[tuple[int, int, int]]) -> str:
    out, done = [], 0
    for a, _, b in found:
        if b > done:
            if a >= done:
                out += [text[done:a], MASK]
            done = b
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs` with their columns; every secret in `text` is replaced by `MASK`."""
    spark = prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast((Automaton(rules), rules))
    return docs.mapInArrow(_redactor(held), docs.schema)
