"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Most rows of each class in a training sample, and most text bytes of the whole sample.
CLASS_ROWS = 2000
SAMPLE_BYTES = 24 << 20


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part, F.lit(False))


def sample(
    docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, class_rows: int = CLASS_ROWS, sample_bytes: int = SAMPLE_BYTES
) -> DataFrame:
    """(key, label, text) of labelled documents that are not held out.

    Bounded: of each class at most `class_rows` documents, the first by a hash of the id, and
    of those as many as fit into half of `sample_bytes`: a text that does not fit is passed
    over, the next one is tried. A class of which none fits gives its smallest text. Texts are
    taken whole and read only once they are chosen. An id with several labels counts as 1 if
    one is 1; an id with several texts gives one of them.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"), parts, part)).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.withColumn("key", F.xxhash64(F.col("doc_id"), F.lit("sample")))
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    mark, size = F.xxhash64("text").alias("mark"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    chosen = []
    for value in (0, 1):
        ids = known.where(F.col("label") == value).orderBy("key", "doc_id").limit(class_rows)
        # At most `class_rows` ids of 24 bytes: a proven bound for the broadcast.
        rows = docs.select("doc_id", mark, size).join(F.broadcast(ids), "doc_id").groupBy("key", "doc_id").agg(F.min(F.struct("mark", "size")).alias("one"))
        # As many numbers come to the driver, no text.
        sized = [(r["key"], r["doc_id"], r["one"]["mark"], r["one"]["size"]) for r in rows.collect()]
        chosen += [(*r[:3], value) for r in _fitting(sorted(sized), sample_bytes // 2)]
    picked = spark.createDataFrame(chosen, StructType([*ids.select("key", "doc_id").schema.fields, *_PICKED.fields]))
    rows = docs.withColumn("mark", mark).join(F.broadcast(picked), ["doc_id", "mark"])
    return rows.dropDuplicates(["doc_id", "mark"]).orderBy("key", "doc_id").select("key", "label", "text")


_PICKED = StructType([StructField("mark", LongType()), StructField("label", IntegerType())])


def _fitting(rows: list[tuple], budget: int) -> list[tuple]:
    """In order, the rows whose last field still fits into the budget; else the smallest one."""
    kept, left = [], budget
    for row in rows:
        if row[-1] <= left:
            kept.append(row)
            left -= row[-1]
    return kept or sorted(rows, key=lambda r: (r[-1], r))[:1]
