"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

The merge list fixes how far to the right of a place the text can still change what happens
there (`MergeList.lookahead`). The encoder keeps that many symbols, emits a token once it lies
further back, and so needs constant memory for a word of any length; texts are taken a chunk
at a time. The decoder is a state machine that keeps at most three bytes of an unfinished
character.

Why the lookahead suffices. Merges are applied in order of rank, leftmost first, and a merge
list is proper: a rule ranks after those that form its two sides. Let two texts share a prefix,
and let the boundary at m be removed by a rule (u, v) in one and not in the other. Then the
bytes under v, up to len(v) to the right of m, were cut differently before, by a rule of lower
rank whose left side is a node of v's derivation; its own boundary lies at that node's end. The
chain goes on with falling ranks until it reaches the end of the prefix, so the longest chain
over the merge list bounds the distance. `MergeList` computes it by dynamic programming over
the rules in order of rank. Restarting behind an emitted token is exact, as no merge crosses
a boundary that stays.

The vocabulary file is a parameter; it is read by the driver and sent to tasks (its size does
not depend on the data). Supported are files of kind BPE with byte-level symbols, a word end
suffix, NFC, white space folding and lower case; others raise ValueError.

Null text is empty and gives no tokens; null ids stay null; repeated rows give repeated rows;
an empty table gives no rows; other columns are ignored, whatever their names. Strings of the
special tokens in a text become those tokens, as the file's library does it. A text is never
cut inside a run of combining marks, which is the one thing the buffer can grow with.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outboxlake.llm import bytescan as bs
from outboxlake.llm.store import prepare

#: Characters of a text taken at a time.
CHUNK = 1 << 15
#: Words whose tokens a worker remembers, twice this many at most.
REMEMBERED = 1 << 17
#: Longer words are not remembered.
LONGEST_REMEMBERED = 48

# The file's way to split normalised text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FOLDED = r"\s+"
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    code = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(rest)}
    return [chr(code[b]) for b in range(256)]


@cache
def letters_and_numbers() -> tuple[str, str]:
    """Ranges of characters of the categories L and N, for use between brackets.

    They come from one table, that of `unicodedata`, so characters newer than that table count
    as neither; pattern libraries go by versions of the standard of their own.
    """
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000))
    runs = [[f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in re.finditer(f"{kind}+", kinds)] for kind in "LN"]
    return "".join(runs[0]), "".join(runs[1])


class MergeList:
    """Ranks of pairs, and the lookahead that suffices for them."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.suffix = suffix
        symbols = byte_symbols()
        missing = [s for s in symbols if s not in vocabulary or s + suffix not in vocabulary]
        if missing:
            raise ValueError(f"no token for symbols {missing}")
        self.inner = {b: vocabulary[s] for b, s in enumerate(symbols)}
        self.final = {b: vocabulary[s + suffix] for b, s in enumerate(symbols)}
        self.length = dict.fromkeys([*self.inner.values(), *self.final.values()], 1)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        formed: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            u, v, both = vocabulary[left], vocabulary[right], vocabulary[left + right]
            if u not in self.length or v not in self.length or both in self.length:
                raise ValueError(f"merge {rank} is not formed after its sides, or is formed twice")
            self.pairs[u, v] = (rank, both)
            self.length[both] = self.length[u] + self.length[v]
            formed[both] = (rank, u, v)
        self.none = len(merges) << 32
        self.rules = {u << 32 | v: rank << 32 | both for (u, v), (rank, both) in self.pairs.items()}
        self.lookahead = self._lookahead(formed)

    def _lookahead(self, formed: dict[int, tuple[int, int, int]]) -> int:
        """Longest chain of rules of falling rank; see the module."""
        ranks: dict[int, list[int]] = {}
        reach: dict[int, list[int]] = {}
        most = 1
        for (u, v), (rank, _) in self.pairs.items():
            far = self.length[v]
            # Nodes of the derivation of v: (token, place of its end, rank of the rule that used it).
            nodes = [(v, self.length[v], rank)]
            while nodes:
                token, end, used = nodes.pop()
                if token in ranks and (k := bisect_left(ranks[token], used)):
                    far = max(far, end + reach[token][k - 1])
                if token in formed:
                    own, left, right = formed[token]
                    nodes += [(left, end - self.length[right], own), (right, end, own)]
            # Rules come in order of rank, so the running maximum is kept per left side.
            ranks.setdefault(u, []).append(rank)
            reach.setdefault(u, []).append(max(far, reach[u][-1] if reach.get(u) else 0))
            most = max(most, far)
        return most

    def word(self, data: bytes | list[int]) -> list[int]:
        """The tokens of a whole word."""
        if not data:
            return []
        return self.merged([*map(self.inner.__getitem__, data[:-1]), self.final[data[-1]]])

    def merged(self, ids: list[int]) -> list[int]:
        """The tokens of a run of symbols: pairs merge in order of rank, leftmost first."""
        rules, least = self.rules, self.none
        # The rule of each neighbouring pair: its rank and its token in one number.
        next_rules = [rules.get(a << 32 | b, least) for a, b in zip(ids, ids[1:], strict=False)]
        while next_rules and (best := min(next_rules)) != least:
            k = next_rules.index(best)
            token = best & 0xFFFFFFFF
            ids[k : k + 2] = [token]
            del next_rules[k]
            if k:
                next_rules[k - 1] = rules.get(ids[k - 1] << 32 | token, least)
            if k < len(next_rules):
                next_rules[k] = rules.get(token << 32 | ids[k + 1], least)
        return ids


class WordTransducer:
    """Tokens of one word whose bytes come in parts. Holds at most twice its window."""

    def __init__(self, merges: MergeList) -> None:
        self.merges = merges
        #: With more symbols than this, the first token lies beyond the lookahead.
        self.window = merges.lookahead + max(merges.length.values()) + 1
        self.held: list[int] = []

    def feed(self, data: bytes) -> Iterator[int]:
        """Tokens that no later byte can change."""
        window = self.window
        for at in range(0, len(data), window):
            self.held += data[at : at + window]
            # The last byte may be the word's end, which has a symbol of its own.
            while len(self.held) > window:
                inner = self.merges.inner
                tokens = self.merges.merged([inner[b] for b in self.held[:-1]])
                stable, end = len(self.held) - 1 - self.merges.lookahead, 0
                for token in tokens:
                    if end + self.merges.length[token] > stable:
                        break
                    end += self.merges.length[token]
                    yield token
                del self.held[:end]

    def finish(self) -> list[int]:
        """The remaining tokens; the transducer is ready for another word."""
        held, self.held = self.held, []
        return self.merges.word(held)


def normalised(text: str) -> str:
    """NFC and lower case letter by letter: sigma has one lower case, wherever it stands."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _joins_left(c: str) -> bool:
    """Whether a character may combine with those before it."""
    return unicodedata.category(c)[0] == "M" or "ᅠ" <= c <= "ᇿ"


def _shortens(text: str, at: int) -> bool:
    """Whether an apostrophe and up to two letters behind it may stand on both sides of a place."""
    return (text[at - 1] == "'" != text[at]) or (at > 1 and text[at - 2] == "'" != text[at - 1])


def chunks(text: str, start: int, end: int, size: int = CHUNK) -> Iterator[tuple[str, bool]]:
    """Parts of text[start:end] that may be normalised apart, and whether the next goes on without a space.

    A part ends behind white space where its second half has some, else before a character
    that combines with nothing and does not follow an apostrophe closely.
    """
    while start < end:
        stop = min(start + size, end)
        if stop < end:
            space = max(text.rfind(" ", start + size // 2, stop), text.rfind("\n", start + size // 2, stop))
            if space >= 0:
                yield text[start : space + 1], False
                start = space + 1
                continue
            while stop < end and (_joins_left(text[stop]) or _shortens(text, stop)):
                stop += 1
        yield text[start:stop], stop < end
        start = stop


class Encoder:
    """Token ids of texts, as the library of the vocabulary file gives them without special tokens added."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.merges = MergeList(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("|".join(map(re.escape, longest_first)) if self.special else r"(?!)")
        letters, numbers = letters_and_numbers()
        other = f"[^{WHITE_SPACE}{letters}{numbers}]+"
        own = SPLIT.replace(r"[^\s\p{L}\p{N}]+", other).replace(r"\p{L}", letters).replace(r"\p{N}", numbers)
        self.split = re.compile(own)
        self.folded = re.compile(f"[{WHITE_SPACE}]+")
        self.odd = re.compile("[\x1c-\x1f]")
        self.runs = {"letter": re.compile(f"[{letters}]+"), "other": re.compile(other)}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.word = WordTransducer(self.merges)

    def _tokens(self, part: str) -> tuple[int, ...]:
        """Tokens of one word."""
        data = part.encode()
        if len(part) > LONGEST_REMEMBERED:
            return (*self.word.feed(data), *self.word.finish())
        tokens = self.known.get(part) or self.older.get(part)
        return tokens or self._remember(part, tuple(self.merges.word(data)))

    def _remember(self, spaced: str, tokens: tuple[int, ...]) -> tuple[int, ...]:
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        self.known[spaced] = tokens
        return tokens

    def _whole(self, text: str) -> list[int]:
        """Tokens of normalised text that ends at a word's end."""
        out: list[int] = []
        for stretch in self.folded.split(text) if self.odd.search(text) else text.split():
            tokens = self.known.get(stretch)
            if tokens is not None:
                out += tokens
            elif len(stretch) > LONGEST_REMEMBERED:
                for part in self.split.findall(stretch):
                    out += self._tokens(part)
            else:
                tokens = self.older.get(stretch)
                if tokens is None:
                    parts = self.split.findall(stretch)
                    tokens = tuple(chain.from_iterable(map(self._tokens, parts)))
                out += self._remember(stretch, tokens)
        return out

    def _open(self, text: str, going: str | None) -> Iterator[int]:
        """Tokens of normalised text whose last word may go on in the next part.

        `going` is the kind of the word that the part before left open.
        """
        if going is not None and text:
            run = self.runs[going].match(text)
            k = run.end() if run else 0
            yield from self.word.feed(text[:k].encode())
            if k == len(text):
                self.going = going
                return
            yield from self.word.finish()
            text = text[k:]
        self.going = None
        for found in self.split.finditer(text):
            part = found.group()
            yield from self.word.feed(part.encode())
            if found.end() == len(text):
                self.going = next((kind for kind, run in self.runs.items() if run.fullmatch(part)), None)
                if self.going is not None:
                    return
            yield from self.word.finish()

    def parts(self, text: str, size: int = CHUNK) -> Iterator[list[int]]:
        """Token ids in order, a chunk's at a time; memory does not grow with the text."""
        at = 0
        for mark in chain(self.marks.finditer(text), [None]):
            self.going = None
            for part, more in chunks(text, at, mark.start() if mark else len(text), size):
                part = normalised(part)
                yield list(self._open(part, self.going)) if more or self.going is not None else self._whole(part)
                if not more and self.going is not None:
                    yield self.word.finish()
                    self.going = None
            if mark:
                yield [self.special[mark.group()]]
                at = mark.end()

    def ids(self, text: str, size: int = CHUNK) -> list[int]:
        return list(chain.from_iterable(self.parts(text, size)))


class Surface:
    """What each token shows, and its bytes."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        suffix, byte = model["end_of_word_suffix"], {s: b for b, s in enumerate(byte_symbols())}
        self.shown = {i: s for s, i in model["vocab"].items()}
        self.bytes = {i: bytes(byte[c] for c in s.removesuffix(suffix)) + b" " * s.endswith(suffix) for i, s in self.shown.items()}
        for token in spec["added_tokens"]:
            self.shown[token["id"]] = token["content"]
            self.bytes[token["id"]] = token["content"].encode()


class Decoder:
    """Text of token ids that come in parts.

    `feed` gives the vocabulary's strings with a space between, as the file's library does for
    files that name no decoder. `text` maps symbols to bytes and word ends to spaces; an
    unfinished character waits for the next part.
    """

    def __init__(self, tables: "Surface") -> None:
        self.tables = tables
        self.first, self.tail = True, b""

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        shown = " ".join(map(self.tables.shown.__getitem__, ids))
        shown, self.first = (shown if self.first else " " + shown), False
        return shown

    def text(self, ids: list[int], last: bool = False) -> str:
        data = self.tail + b"".join(map(self.tables.bytes.__getitem__, ids))
        held = 0
        if not last:
            # States of the machine: bytes that the last lead byte still asks for.
            for back in range(1, min(3, len(data)) + 1):
                b = data[-back]
                if b >= 0xC0:
                    held = back if (2 if b < 0xE0 else 3 if b < 0xF0 else 4) > back else 0
                    break
                if b < 0x80:
                    break
        self.tail = data[len(data) - held :]
        return data[: len(data) - held].decode("utf-8", "replace")


_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
_OUT_DDL = "doc_id long, ids array<int>, decoded string"
#: The encoder of a task's vocabulary, built once per worker.
_built: dict[int, tuple[Encoder, Surface]] = {}


def _encode(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(vocabulary.value)
        if key not in _built:
            spec = json.loads(vocabulary.value)
            _built[key] = Encoder(spec), Surface(spec)
        encoder, surface = _built[key]
        for batch in bs.pieces(batches):
            ends, ids, shown = array("i", [0]), array("i"), []
            for text in batch.column("text").to_pylist():
                decoder, parts = Decoder(surface), []
                for part in encoder.parts(text or ""):
                    ids.extend(part)
                    parts.append(decoder.feed(part))
                ends.append(len(ids))
                shown.append("".join(parts))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(shown, pa.string())], schema=_OUT)

    return run


def encoded(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row of `docs` (doc_id, text)."""
    spark = prepare(docs.sparkSession)
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    _check(json.loads(vocabulary.value))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(vocabulary), _OUT_DDL)


def _check(spec: dict) -> None:
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = splits[0].get("pattern", {}).get("Regex") if splits else None
    plain = all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec["added_tokens"])
    if steps != ["NFC", "Replace", "Lowercase"] or pattern != SPLIT or not spec["model"].get("end_of_word_suffix") or not plain:
        raise ValueError("not a vocabulary of the supported kind")


def digest(rows: DataFrame) -> DataFrame:
    """Counts and hashes of `encoded` rows."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
