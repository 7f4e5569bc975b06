"""The first row of every callback name of an event, within a micro-batch and across them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANDIDATES = T.StructType(
    [
        T.StructField("id", T.LongType(), True),
        T.StructField("event_id", T.StringType(), True),
        T.StructField("label", T.StringType(), True),
        T.StructField("pos", T.IntegerType(), True),
        T.StructField("dead_letter", T.BooleanType(), True),
    ]
)
NAME = ["event_id", "label"]
#: Groups that the rows of one micro-batch are sorted in, whole events each.
GROUPS = 4096


def best_of_batch(rows: pa.Table) -> pa.Table:
    """Of the rows of a micro-batch one per name: a valid one, else the first by event number and place."""
    rows = rows.sort_by([(c, "ascending") for c in ("id", "dead_letter", "pos")])
    names = rows.group_by(NAME, use_threads=False).aggregate([(c, "first") for c in ("id", "pos", "dead_letter")])
    names = names.rename_columns([c.removesuffix("_first") for c in names.column_names])
    return names.select(CANDIDATES.fieldNames())


def first_names(candidates: DataFrame, keep: int) -> DataFrame:
    """Lets the first row of every name of an event through. Names are forgotten ``keep`` seconds
    after they were seen, by the clock of the micro-batches: no row is late for that."""
    best = (
        candidates.groupBy(F.pmod(F.xxhash64("event_id"), F.lit(GROUPS)))
        .applyInArrow(lambda rows: best_of_batch(rows.select(CANDIDATES.fieldNames())), CANDIDATES)
    )
    # Forgotten when the watermark, half of it behind the clock, is half of it behind the row.
    seen = best.withColumn("seen", F.current_timestamp()).withWatermark("seen", f"{keep // 2} seconds")
    return seen.dropDuplicatesWithinWatermark(NAME).select(*CANDIDATES.fieldNames())
