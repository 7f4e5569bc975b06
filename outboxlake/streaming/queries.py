"""Structured Streaming forms of scheduling, deduplication, counters and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from outboxlake.functions import times
from outboxlake.operators import alerts, fanout, schedule
from outboxlake.options import Options, RetentionOptions
from outboxlake.session import fresh_path
from outboxlake.sources import tables
from outboxlake.streaming.first_names import first_names
from outboxlake.streaming.sinks import CountSink, DeliverySink, writer_of

AVAILABLE_NOW = {"availableNow": True}
IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
STATE_PARTITIONS = "spark.sql.shuffle.partitions"
STATE_CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
METRICS = "kind string, branch string, minute timestamp, value long"
ALERTS = "alert string, window_start timestamp, window_end timestamp, occurrences long"


def every(opts: Options) -> dict[str, str]:
    return {"processingTime": f"{opts.poll_interval_seconds} seconds"}


def run_to_table(stream: DataFrame, label: str, mode: str = "append", idle_batches: bool = True) -> DataFrame:
    """Runs a stream over everything available and returns what it wrote.

    Without ``idle_batches`` it stops with the last data: state kept by wall clock asks for
    another micro-batch for ever.
    """
    spark = stream.sparkSession
    out, state = fresh_path(spark, label), fresh_path(spark, f"{label}-state")
    # Every micro-batch opens and commits every state store, and starts Python for it, whatever
    # it holds: one store per core. They keep their rows on disk and write what changed only.
    wanted = {
        IDLE_BATCHES: str(idle_batches).lower(),
        STATE_PARTITIONS: str(spark.sparkContext.defaultParallelism),
        STATE_CHANGELOG: "true",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .format("parquet")
            .option("path", out)
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(stream.schema).parquet(out)


def stream_schedule(
    events: DataFrame, sink: DeliverySink, opts: Options, as_of: times.AsOf | None = None
) -> DataStreamWriter:
    """Fans new events out as they arrive. The checkpoint takes the place of the cursor.

    Without ``as_of`` each batch is stamped with its own time.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        now = as_of or batch.sparkSession.sql("SELECT current_timestamp()").head()[0]
        writer = writer_of(batch)
        # A batch of few splits is judged by all cores.
        batch = tables.spread(batch).persist()
        try:
            held = sink.rows_of(batch, writer, batch_id)
            highest = sink.highest(writer, batch_id)
            result = schedule.schedule_deliveries(batch, held, opts, now, highest=highest)
            sink.write(result.new_rows, writer, batch_id)
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(one_batch)


def run_schedule(
    events: DataFrame, sink: DeliverySink, opts: Options, checkpoint: str, as_of=None, trigger=None
) -> StreamingQuery:
    writer = stream_schedule(events, sink, opts, as_of).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or AVAILABLE_NOW)).start()


def stream_dedupe(
    events: DataFrame, opts: Options, retention: RetentionOptions = RetentionOptions()
) -> DataFrame:
    """Delivery candidates without replays, however late those come.

    One row per (event, callback): of the first micro-batch that has the event, the valid
    element, else the one that comes first. The names given out are kept per event until it
    falls under retention; replays after that are dropped by the insert itself. The RocksDB
    state store (see session) keeps them on disk.
    """
    candidates = fanout.judge_callbacks(events, opts, mark_duplicates=False).select(
        "id",
        "event_id",
        "label",
        F.col("pos").cast("int").alias("pos"),
        (~F.col("valid")).alias("dead_letter"),
    )
    return first_names(candidates, retention.longest_seconds)


def count_stream(rows: DataFrame, sink: CountSink) -> DataStreamWriter:
    """Adds the counts of each micro-batch of ``rows`` (the sink's keys) to a sink."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        sink.write(batch.groupBy(*sink.keys).agg(F.count("*").alias(sink.value)), writer_of(batch), batch_id)

    return rows.writeStream.foreachBatch(one_batch)


def run_counts(
    rows: DataFrame, sink: CountSink, checkpoint: str, trigger: dict | None = None, name: str | None = None
) -> StreamingQuery:
    writer = count_stream(rows, sink).option("checkpointLocation", checkpoint)
    if name is not None:
        writer = writer.queryName(name)
    return writer.trigger(**(trigger or AVAILABLE_NOW)).start()


def metrics_sink(spark: SparkSession, path: str) -> CountSink:
    return CountSink(spark, path, ["kind", "branch", "minute"], METRICS)


def stream_metrics(events: DataFrame, opts: Options) -> DataFrame:
    """(kind, branch, minute) of every event, to be counted in tumbling minutes by `run_counts`."""
    minute = F.date_trunc("minute", F.col("created_at").cast("timestamp"))
    return fanout.classify_events(events, opts).select("kind", "branch", minute.alias("minute"))


def alerts_sink(spark: SparkSession, path: str) -> CountSink:
    return CountSink(spark, path, ["alert", "window_start", "window_end"], ALERTS, "occurrences")


def stream_alerts(occurrences: DataFrame) -> DataFrame:
    """The sliding windows that each row of (alert, at) falls in, to be counted by `run_counts`."""
    windows = F.window(F.col("at").cast("timestamp"), alerts.SPAN, alerts.SLIDE)
    return occurrences.select("alert", windows.alias("w")).select(
        "alert", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end")
    )


def stream_rescan(
    events: DataFrame, sink: DeliverySink, opts: Options, as_of: times.AsOf, since: times.AsOf, run: str = "rescan"
) -> DataFrame:
    """Batch backfill into the sink of a stream: inserts what is absent of the events behind the
    cursor of ``since`` and returns the rows it wrote. A run of the same name replaces its rows."""
    held, highest = sink.rows(run, 0), sink.highest(run, 0)
    rows = schedule.rescan_since(events, held, opts, as_of, since, highest).new_rows
    part = sink.write(rows, run, 0)
    return sink.folders.read([part], sink.base.schema)
