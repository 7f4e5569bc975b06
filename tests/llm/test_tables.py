import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from outboxlake.llm import chat, crosspolytope, mixing, warc

from . import brute


def _fill(budget, children):
    """Weighted shares of a budget below capacities, by repeated passes."""
    got, open_ = {}, dict(children)
    while open_:
        level = budget / sum(w for w, _ in open_.values())
        full = {k for k, (w, c) in open_.items() if c <= w * level}
        if not full:
            return got | {k: int(w * level) for k, (w, _) in open_.items()}
        for k in full:
            got[k] = open_.pop(k)[1]
            budget -= got[k]
    return got


def _mix(rows, share, epochs, seed, weights=None):
    key = lambda e, d: int(hashlib.md5(f"{seed}:{e}:{'' if d is None else d}".encode()).hexdigest()[:15], 16)
    leaves = defaultdict(list)
    for doc, text, lang, source, domain in rows:
        leaves[(domain, lang, source)].append((doc, len((text or "").split())))
    have = {k: sum(n for _, n in v) for k, v in leaves.items()}

    def down(path, budget):
        if len(path) == 3:
            return {path: budget}
        kids = {k[: len(path) + 1] for k in have if k[: len(path)] == path}
        sizes = {k: ((weights or {}).get(k, 1.0), epochs * sum(n for x, n in have.items() if x[: len(k)] == k)) for k in kids}
        out = {}
        for k, b in _fill(budget, sizes).items():
            out |= down(k, b)
        return out

    copies = {}
    for leaf, budget in down((), int(sum(have.values()) * share)).items():
        full = budget // have[leaf] if have[leaf] else 0
        rest, total, by_key = budget - full * have[leaf], 0, defaultdict(list)
        for d, n in leaves[leaf]:
            by_key[key(full, d)].append((d, n))
        for k in sorted(by_key):
            total += sum(n for _, n in by_key[k])
            for d, _ in by_key[k]:
                copies[d] = full + int(rest > 0 and total <= rest)
    return {d: n for d, n in copies.items() if n}


MIX = "doc_id long, text string, lang string, source string, domain string, tokens string"


@pytest.mark.parametrize(("share", "epochs"), [(0.4, 1), (0.9, 2), (3.0, 2)])
def test_mix_matches_plain_allocation(spark, share, epochs):
    rng = random.Random(2)
    rows = []
    for d in range(300):
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(6)}"
        domain = rng.choice(["web", "web", "books"])
        rows.append((d, " ".join("w" * rng.randint(0, 40)), rng.choice(["en", "de", None]), source, domain))
    rows += [(901, None, "en", "s1", "web"), (902, "", "en", "s2", "web"), (903, "x " * 5000, "fr", None, "books")]
    docs = spark.createDataFrame([(*r, "t") for r in rows], MIX).repartition(4)
    got = mixing.mixed(docs, share=share, max_epochs=epochs)
    assert {r.doc_id: r.copies for r in got.collect()} == _mix(rows, share, epochs, mixing.SEED)
    assert set(got.columns) == {*docs.columns, "copies"}


def test_mix_follows_weights_of_every_level(spark):
    rng = random.Random(4)
    weights = {("web",): 3.0, ("books",): 0.5, ("web", "en"): 4.0, ("web", "de"): 0.25, ("books", "de"): 2.0}
    weights |= {("web", "en", "hot"): 0.5, ("web", "en", "s1"): 8.0, ("books", "de", "s2"): 0.0}
    rows = []
    for d in range(400):
        place = (rng.choice(["hot", "s1", "s2", "s3"]), rng.choice(["web", "web", "books", "code"]))
        rows.append((d, " ".join("w" * rng.randint(1, 40)), rng.choice(["en", "de", None]), *place))
    docs = spark.createDataFrame([(*r, "t") for r in rows], MIX).repartition(4)
    asked = [((*k, None, None)[:3], w) for k, w in weights.items()]
    asked = spark.createDataFrame([(*k, w) for k, w in asked], "domain string, lang string, source string, weight double")
    got = mixing.mixed(docs, asked, share=0.5, max_epochs=2)
    rows = [r for r in rows if (r[4], r[2], r[3]) != ("books", "de", "s2")]
    total = sum(len(r[1].split()) for r in docs.select("doc_id", "text").collect())
    have = sum(len(r[1].split()) for r in rows)
    assert {r.doc_id: r.copies for r in got.collect()} == _mix(rows, 0.5 * total / have, 2, mixing.SEED, weights)
    assert mixing.target_weights(spark).where("weight <= 0").count() == 0


def test_mix_weights_and_empty_table(spark):
    rows = [(d, "a b c d", "en", "s1" if d % 2 else "s2", "web", "") for d in range(100)]
    docs = spark.createDataFrame(rows, MIX)
    weights = spark.createDataFrame([("web", "en", "s1", 3.0), ("web", "en", "s2", 1.0)], "domain string, lang string, source string, weight double")
    chosen = mixing.mixed(docs, weights, share=0.25, max_epochs=1).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in chosen} == {"s1": 18, "s2": 6}
    assert mixing.mixed(docs.limit(0)).collect() == []


LOG = "conv_id long, turn long, role string, text string, hash string"


def test_snapshots_collapse(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), (None, None)]
    rows = []
    for conv, n in ((1, 1), (2, 2), (3, 4), (4, 4), (5, 3)):
        rows += [(conv, k, *talk[k]) for k in range(n)]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (7, 0, "user", "hi"), (7, 0, "user", "hi")]
    rows += [(None, 0, "user", "lost"), (8, None, "user", "<|im_end|> x"), (9, 0, "system", "x" * 100_000)]
    log = spark.createDataFrame([(*r, "h") for r in rows], LOG).repartition(4)
    got = {r.conv_id: r for r in chat.maximal(log).collect()}
    assert {k: r.n_copies for k, r in got.items()} == brute.snapshots(rows) == {3: 2, 6: 1, 8: 1, 9: 1}
    assert got[8].text == "<|im_start|>user\n<| im_end |> x<|im_end|>\n"
    assert got[3].text.endswith("<|im_start|>unknown\n<|im_end|>\n") and got[3].n_turns == 4
    assert chat.maximal(log.limit(0)).collect() == []


def _links(rows):
    from outboxlake.llm.components import Forest

    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    forest, counts = Forest(), {}
    for size in {len(v) for _, v in good}:
        ids = [i for i, v in good if len(v) == size]
        x = np.stack([v / np.linalg.norm(v) for _, v in good if len(v) == size])
        near = x @ x.T >= 0.95
        np.fill_diagonal(near, False)
        for i, j in zip(*np.nonzero(near), strict=True):
            forest.join(ids[i], ids[j])
        counts |= dict(zip(ids, near.sum(1).tolist(), strict=True))
    return {i: (counts.get(i, 0), forest.find(i), forest.find(i) == i) for i, _ in rows}


VECTORS = "vec_id long, embedding array<double>, label int, bucket string"


def test_near_vectors_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=16).tolist()) for k in range(200)]
    for k in range(200, 900):
        of = np.array(rows[int(rng.integers(0, 12))][1])
        rows.append((k, (of + 0.05 * rng.normal(size=16)).tolist()))
    rows += [(1000 + k, rows[3][1]) for k in range(40)] + [(1100, [2 * v for v in rows[3][1]])]
    # Other lengths link among themselves.
    few = rng.normal(size=(30, 5))
    rows += [(3000 + i, (few[i % 30] + 0.02 * rng.normal(size=5)).tolist()) for i in range(60)]
    rows += [(3100, [2.0]), (3101, [0.5]), (3102, [-1.0]), (3103, [1.0, 1.0]), (3104, [1.0, 1.1])]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, []), (2005, [1.0] * 3)]
    frame = spark.createDataFrame([(i, v, 0, "b") for i, v in rows], VECTORS).repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in crosspolytope.near_vectors(frame).collect()}
    want = _links(rows)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and len(got) == len(want)
    assert sum(got[i][1:] != want[i][1:] for i in want) <= 2
    assert crosspolytope.near_vectors(frame.limit(0)).collect() == []


def test_tables_keep_recall_where_the_vectors_grow():
    rng = np.random.default_rng(8)
    for n in (50_000, 10**9, 10**11):
        flips = crosspolytope.flips_for(64, n)
        a = rng.normal(size=(400, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.normal(size=(400, 64))
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = 0.952 * a + np.sqrt(1 - 0.952**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        (home_a, visit_a), (home_b, visit_b) = crosspolytope.hashed(a, flips), crosspolytope.hashed(b, flips)
        met = (home_a == home_b) | (visit_a == home_b[:, :, None]).any(2) | (visit_b == home_a[:, :, None]).any(2)
        assert met.any(axis=1).mean() >= 0.95


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64))
    y = crosspolytope.hadamard(x)
    assert np.allclose((x * x).sum(1), (y * y).sum(1)) and np.allclose(crosspolytope.hadamard(y), x)


PAGES = "page_id long, url string, html string, kind string, payload string"


def test_archives_round_trip(spark):
    large = "<p>é " + "z" * 1200
    pages = [(k, f"http://a.example/{k}", f"page {k}") for k in range(20)]
    pages += [(101, None, large), (102, "http://a b\n", large), (103, "", large), (None, "n", large), (104, "u", None), (105, "u", "")]
    pages += [(106, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (107, "u", "s"), (108, "u", "s"), (103, "again", large), (109, "long", "日" * 200_000)]
    frame = spark.createDataFrame([(*p, "k", "p") for p in pages], PAGES).repartition(3)
    got = sorted((tuple(r)[:5] for r in warc.round_trip(frame).collect()), key=str)
    want = []
    for i, _, html in pages:
        body = (html or "").encode()
        revisit = html == large and i != 103
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", 103 if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(frame.limit(0)).collect() == []


def test_archive_versions_and_declared_lengths():
    import io

    about = b"2 0 pages\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    head = b"filedesc://x 0.0.0.0 20240101000000 text/plain %d\n" % len(about)
    data = head + about + b"\nhttp://a 1.2.3.4 20240102030405 text/html 200 - - 0 x 5\nhe\nlo\n"
    stream = lambda raw: io.BufferedReader(io.BytesIO(raw))
    records = list(warc.arc_records(stream(data), "x"))
    assert records[1][0]["Result-code"] == "200" and records[1][1] == b"he\nlo"
    with pytest.raises(ValueError, match="declares"):
        list(warc.arc_records(stream(data[:-4]), "x"))


def test_foreign_archives_with_bytes_spaces_and_broken_records(spark, tmp_path):
    import gzip

    def record(url, payload, kind="image/png", date="20010203040506", length=None):
        block = b"HTTP/1.0 200 OK\r\nContent-Type: x\r\n\r\n" + payload
        return b"%s 1.2.3.4 %s %s %d\n%s\n" % (url, date.encode(), kind.encode(), len(block) if length is None else length, block)

    about = b"1 0 crawler\nURL IP-address Archive-date Content-type Archive-length\n"
    first = b"filedesc://x.arc 0.0.0.0 20010101000000 text/plain %d\n%s\n" % (len(about), about)
    image = bytes(range(256)) * 8
    good = [record(b"http://a/b c.png", image), record(b"http://a/\xff", b"\x89PNG\r\n\r\n"), record(b"http://a/t", b"x y", "text/html; charset=x")]
    bad = [b"no header here\n", record(b"http://a/d", b"d", date="20011303040506"), record(b"http://a/z", b"cut", length=999)]
    folder = tmp_path / "arc"
    folder.mkdir()
    # Records of one file are compressed together or one by one.
    (folder / "one.arc.gz").write_bytes(b"".join(gzip.compress(x) for x in [first, *good[:2], *bad[:2], good[2], bad[2]]))
    (folder / "two.arc").write_bytes(first + good[0])
    (folder / "three.arc.gz").write_bytes(gzip.compress(first + record(b"http://a/v", b"v"))[:-9])
    warc.to_warc(spark, str(folder), str(tmp_path / "warc"), str(tmp_path / "rejects"))
    got = sorted((r.uri, r.payload_bytes, r.payload_digest) for r in warc.read_warc(spark, str(tmp_path / "warc")).collect())
    sha1 = lambda x: hashlib.sha1(x).hexdigest()
    kept = [("http://a/b%20c.png", image), ("http://a/\ufffd", b"\x89PNG\r\n\r\n"), ("http://a/t", b"x y"), ("http://a/b%20c.png", image)]
    assert [g for g in got if g[0] != "http://a/v"] == sorted((u, len(p), sha1(p)) for u, p in kept)
    rejects = {(r.archive.rsplit("/", 1)[-1], r.problem[:12]): r.offset for r in spark.read.parquet(str(tmp_path / "rejects")).collect()}
    at = len(first + b"".join(good[:2]))
    assert rejects.pop(("three.arc.gz", "broken compr")) >= 0
    assert rejects == {
        ("one.arc.gz", "a line that "): at,
        ("one.arc.gz", "the date 200"): at + len(bad[0]),
        ("one.arc.gz", "a record dec"): at + len(bad[0] + bad[1] + good[2]),
    }
    with pytest.raises(Exception, match="no header|broken compression"):
        warc.read_arc(spark, str(folder)).collect()
