import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from outboxlake.llm import transducer  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
SPEC = json.load(open(PATH, encoding="utf-8"))
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
ENCODER = transducer.Encoder(SPEC)
SURFACE = transducer.Surface(SPEC)
ODD = "abcthein AEΣİé'’“.!?<|>/w0٣ \n\t\x1c\x1f\x85\xa0　́̈각한日本‍\U0001f600ﬁßẞ각st'red"


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(ODD), max_size=80), st.sampled_from([3, 8, 17, transducer.CHUNK]))
def test_chunks_of_any_size_give_the_librarys_tokens(text, size):
    assert ENCODER.ids(text, size) == library(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_any_text(text):
    assert ENCODER.ids(text, 16) == library(text)


@pytest.mark.parametrize("letters", ["a", "ab", "thein", ".!-=", "日本語", "abcdefghijklmnopqrstuvwxyz"])
def test_words_longer_than_the_lookahead(letters):
    word = "".join(letters[(k * k + k // 7) % len(letters)] for k in range(3000))
    assert ENCODER.ids(word, 200) == library(word)
    held = transducer.WordTransducer(ENCODER.merges)
    tokens, most = [], 0
    for k in range(0, len(word), 50):
        tokens += held.feed(word[k : k + 50].encode())
        most = max(most, len(held.held))
    assert most <= held.window
    assert tokens + held.finish() == library(word)


def small(merges):
    symbols = transducer.byte_symbols()
    vocabulary = {s: k for k, s in enumerate([*symbols, *(s + "$" for s in symbols)])}
    for left, right in merges:
        vocabulary[left + right] = len(vocabulary)
    return transducer.MergeList(vocabulary, merges, "$")


def test_lookahead_follows_chains_of_falling_rank():
    assert small([]).lookahead == 1
    assert small([("a", "b")]).lookahead == 1
    # a|b waits for b|c, which waits for c|d.
    assert small([("c", "d"), ("b", "c"), ("a", "b")]).lookahead == 3
    with pytest.raises(ValueError):
        small([("ab", "c"), ("a", "b")])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=12), st.text("abcd", max_size=60))
def test_stable_tokens_of_any_merge_list(choices, text):
    tokens, merges = list("abcd"), []
    for left, right in choices:
        pair = tokens[left % len(tokens)], tokens[right % len(tokens)]
        if "".join(pair) not in tokens:
            merges.append(pair)
            tokens.append("".join(pair))
    rules = small(merges)
    held = transducer.WordTransducer(rules)
    streamed = [t for c in text for t in held.feed(c.encode())] + held.finish()
    assert streamed == rules.word(text.encode())


def test_decoder_takes_ids_in_parts():
    text = "Éa 日本 <|endoftext|>it's \U0001f600"
    ids = library(text)
    for step in (1, 2, len(ids)):
        shown, plain = transducer.Decoder(SURFACE), transducer.Decoder(SURFACE)
        parts = [ids[k : k + step] for k in range(0, len(ids), step)]
        assert "".join(map(shown.feed, parts)) == LIBRARY.decode(ids, skip_special_tokens=False)
        assert "".join(map(plain.text, parts)) + plain.text([], True) == "éa 日本 <|endoftext|>it 's \U0001f600 "


def test_rows_match_the_library(spark):
    long = "word " * 20000 + "x" * 70000 + "日" * 40000
    rows = [(1, "Hello World"), (1, "Hello World"), (2, None), (3, ""), (None, "a'b"), (4, long), (5, "  "), (6, "é" * 5)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, decoded int")
    got = sorted(transducer.digest(transducer.encoded(docs, PATH)).collect(), key=str)
    want = []
    for doc_id, text in rows:
        ids = library(text or "")
        sums = [hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False))]
        want.append((doc_id, len(ids), *sums))
    assert [tuple(r) for r in got] == [t for _, t in sorted((str(r), tuple(r)) for r in map(_row(got[0]), want))]
    assert transducer.encoded(docs.limit(0), PATH).count() == 0


def _row(like):
    from pyspark.sql import Row

    return lambda values: Row(**dict(zip(like.__fields__, values, strict=True)))


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        transducer._check(json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8")))
