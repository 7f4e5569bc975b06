"""Typed scans with constraint checks, and table writers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outboxlake.functions import variant as vj
from outboxlake.operators.joins import measured
from outboxlake.schemas import COMPLETION_MODES, DELIVERIES, EVENTS

EMPTY_CALLBACKS = "callbacks_not_a_nonempty_array"
DUPLICATE = "duplicate_key"
BAD_MODE = "completion_mode_invalid"
ORPHAN = "event_missing"


@dataclass(frozen=True)
class Checked:
    """``rows`` that meet every constraint; ``rejected`` carries ``reason`` and the number
    of ``copies`` of that row that were refused."""

    rows: DataFrame
    rejected: DataFrame


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options
) -> DataFrame:
    """Scan of a landed table. Text formats need the schema; parquet brings its own."""
    if fmt == "parquet":
        return spark.read.options(**options).parquet(path).select(*schema.fieldNames())
    if fmt == "csv":
        options = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", **options}
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    return spark.read.format(fmt).schema(nullable).options(**options).load(path)


def spread(df: DataFrame) -> DataFrame:
    """Gives an input of fewer splits than cores to all cores, by one shuffle.

    For work that is heavy per row, such as validation, on few or single-row-group files.
    Inputs with enough splits are returned as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def jdbc_options(
    url: str, query_table: str, schema: T.StructType, low: int, high: int, partitions: int
) -> dict[str, str]:
    """Options of a partitioned JDBC scan by id; UUID and JSON columns arrive as text."""
    text = {"event_id", "aggregate_id", "payload", "metadata", "callbacks"}
    text |= {"actor_id", "correlation_id", "causation_id"}
    columns = ", ".join(f"{n}::text AS {n}" if n in text else n for n in schema.fieldNames())
    return {
        "url": url,
        "dbtable": f"(SELECT {columns} FROM {query_table}) AS t",
        "partitionColumn": "id",
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(partitions),
        "fetchsize": "10000",
    }


def read_jdbc(spark: SparkSession, options: dict[str, str], **extra: str) -> DataFrame:
    return spark.read.format("jdbc").options(**options, **extra).load()


def _missing(schema: T.StructType) -> Column:
    """Reason for the first NULL in a required column."""
    reasons = [
        F.when(F.col(f.name).isNull(), f"null_{f.name}") for f in schema.fields if not f.nullable
    ]
    return F.coalesce(*reasons)


def _split(
    df: DataFrame, reason: Column, keys: list[str], order: str, landed: DataFrame
) -> Checked:
    """Row checks first; among passing rows the lowest ``order`` per key is kept.

    Only keys that occur more than once are looked at again. They are found on the key
    columns of the landed table alone, by a count that combines before the shuffle, so
    neither a hot key nor a block of copies ends up in one task, and all other rows pass
    by without moving.
    """
    judged = df.withColumn("reason", reason)
    passing = judged.filter(F.col("reason").isNull()).drop("reason")
    failing = judged.filter(F.col("reason").isNotNull()).withColumn(
        "copies", F.lit(1).cast("bigint")
    )
    repeated = measured(
        landed.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)
    )
    single = passing.join(repeated, keys, "left_anti").select(*df.columns)
    copies = (
        passing.join(repeated, keys, "left_semi")
        .groupBy(*df.columns)
        .agg(F.count("*").alias("copies"))
    )
    # The lowest number first, then the rows that have it: a hot key's rows meet in no task.
    lowest = copies.groupBy(*keys).agg(F.min(order).alias(order))
    rest = F.struct(*[n for n in df.columns if n not in (*keys, order)])
    first = (
        copies.join(lowest, [*keys, order], "left_semi")
        .groupBy(*keys, order)
        .agg(F.min(rest).alias("r"))
        .select(*keys, order, "r.*")
        .select(*df.columns)
    )
    # Copies less the one kept, by whole rows: these spread, however hot their key.
    refused = (
        copies.unionByName(first.withColumn("copies", F.lit(-1).cast("bigint")))
        .groupBy(*df.columns)
        .agg(F.sum("copies").alias("copies"))
        .filter("copies > 0")
        .select(*df.columns, F.lit(DUPLICATE).alias("reason"), "copies")
    )
    return Checked(
        single.unionByName(first),
        failing.select(*df.columns, "reason", "copies").unionByName(refused),
    )


def check_events(events: DataFrame) -> Checked:
    """Required columns, unique event id, callbacks a non-empty array."""
    array = vj.elements(vj.parse(F.col("callbacks")))
    empty = F.coalesce(F.size(array), F.lit(0)) <= 0
    reason = F.coalesce(_missing(EVENTS), F.when(empty, EMPTY_CALLBACKS))
    return _split(events.select(*EVENTS.fieldNames()), reason, ["event_id"], "id", events)


def check_deliveries(deliveries: DataFrame, events: DataFrame) -> Checked:
    """Required columns, mode domain, existing event, unique (event, callback)."""
    rows = deliveries.select(*DELIVERIES.fieldNames())
    bad_mode = F.when(~F.col("completion_mode").isin(*COMPLETION_MODES), BAD_MODE)
    known = events.select("event_id").withColumn("_known", F.lit(True))
    joined = rows.join(known, "event_id", "left").select(*rows.columns, "_known")
    reason = F.coalesce(
        _missing(DELIVERIES), bad_mode, F.when(F.col("_known").isNull(), ORPHAN)
    )
    checked = _split(joined, reason, ["event_id", "callback_name"], "id", deliveries)
    return Checked(checked.rows.drop("_known"), checked.rejected.drop("_known"))


def load_events(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> Checked:
    return check_events(read_table(spark, path, EVENTS, fmt, **options))


def load_deliveries(
    spark: SparkSession, path: str, events: DataFrame, fmt: str = "parquet", **options
) -> Checked:
    return check_deliveries(read_table(spark, path, DELIVERIES, fmt, **options), events)


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "event_id") -> None:
    """Bucketed and sorted by the join key: joins of such tables do not shuffle."""
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table)


def write_by_kind(events: DataFrame, path: str) -> None:
    """Partitioned by kind and day, for reads of one kind in a time range."""
    events.withColumn("day", F.to_date("created_at")).write.partitionBy("kind", "day").mode(
        "overwrite"
    ).parquet(path)
