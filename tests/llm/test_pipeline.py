import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from outboxlake.llm import labelled, secrets, toxicity  # noqa: F401

from . import brute

ITEM = "Nobody in the quiet valley had ever counted all of the wooden bridges that cross its seven narrow rivers"


def test_stages_take_effect(spark, tmp_path):
    import random

    rng = random.Random(8)
    words = ["".join(rng.choice("aeioubcdrst") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    docs, labels = [], []
    for d in range(240):
        text = " ".join(rng.choice(words) for _ in range(60))
        if d % 3 == 0:
            text += " idiot scum"
        labels.append((d, 1, int(d % 3 == 0)))
        docs.append((d, text, "en", f"s{d % 2}", len(text)))
    docs += [(1000 + k, docs[k][1] + " end", "en", "s0", 1) for k in range(1, 60, 3)]
    docs += [(2000, f"Read this: {ITEM} today", "en", "s1", 1), (2001, "token = abcdefghijklmnop", "de", None, 1), (2002, None, None, None, None)]
    for name, rows, ddl in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, ITEM)], "item_id long, text string"),
    ):
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, known = frame, {r[0]: r for r in docs}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in kept.collect()}
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(f"{tmp_path}/out-{name}")
        kept = spark.read.parquet(f"{tmp_path}/out-{name}")
        after = {r.doc_id: r for r in kept.collect()}
        gone = set(before) - set(after)
        if name == "toxicity":
            toxic = {d for d, _, t in labels if t}
            assert len(gone & toxic) >= 0.9 * len(toxic) and not gone - toxic
        elif name == "ngram_jaccard_join":
            classes = brute.classes([(d, r.text) for d, r in before.items()])
            assert gone == {d for d, (_, c) in classes.items() if c != d} and gone
        elif name == "benchmark_decontamination":
            assert gone == {2000}
        elif name == "secret_scan":
            assert not gone and after[2001].text == secrets.MASK and after[2001].n_chars == len(secrets.MASK)
        else:
            assert {"copies", "tokens", "domain"} <= set(kept.columns) and set(after) <= set(known)
            continue
        assert kept.columns == frame.columns


def test_every_stage_takes_an_empty_table(spark, tmp_path):
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


CLASHING = ["tokens", "copies", "full", "last", "_leaf", "leaf", "doc", "document", "score", "predicted", "key", "mark", "component_id", "node"]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, tmp_path, stage):
    long = "valley bridge river " * 20_000
    rows = [(1, "a plain text of a few words", "en", "s"), (1, "a plain text of a few words", "en", "s"), (2, long, "en", "s"), (3, "", None, None), (None, None, "en", None)]
    ddl = "doc_id long, text string, lang string, source string"
    more = [F.lit(f"own {c}").alias(c) for c in CLASHING]
    docs = spark.createDataFrame(rows, ddl).select("*", *more)
    spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame, kept in ((docs, True), (docs.limit(0), False)):
        out = stage(spark, frame, str(tmp_path))
        replaced = {"tokens", "copies"} if "domain" in out.columns else set()
        assert set(docs.columns) <= set(out.columns) and len(out.columns) == len(set(out.columns))
        got = out.collect()
        # The mix may take none of so few.
        assert bool(got) == kept or replaced
        for row in got:
            assert all(row[c] == f"own {c}" for c in CLASHING if c not in replaced)
