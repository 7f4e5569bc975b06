"""A corpus run: each stage is written as Parquet and read again as the next one's documents.

Every stage takes any table of documents: null ids and texts, empty and very long texts,
repeated rows, empty tables and columns of any name. Columns of a document come out as they
went in, but for the masked text and its n_chars; the last stage replaces `tokens` and
`copies`, and adds `domain` where there is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outboxlake.llm import decontaminate, jaccard, mixing, secrets, toxicity
from outboxlake.llm.store import stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, rejects go. Repeated rows go or
    stay together; without labels of both classes, or without text, all stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("document"))
    return toxicity.score(rows, model).where("predicted = 0").select("document.*")


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of linked documents stays, with all rows of
    that id. Documents without words or without an id stay."""
    classes = jaccard.shingle_classes(docs)
    gone = classes.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go; without items all stay."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in place; n_chars follows the text. All documents stay."""
    masked = secrets.redacted(docs)
    if "n_chars" not in docs.columns:
        return masked
    changed = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen for the mix, with the passes over each. Ties of the seeded order stay together."""
    own = [c for c in docs.columns if c not in ("domain", "tokens", "copies")]
    return mixing.mixed(docs, mixing.target_weights(spark)).select(*own, "domain", "tokens", "copies")


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_each_class),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("mixing", to_target_weights),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Training, components and the automaton have no SQL form; tests compare with brute force.
ORACLE_SQL = None
