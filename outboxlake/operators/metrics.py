"""Metric roll-ups: counters, gauges and histograms as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outboxlake.operators import fanout, schedule
from outboxlake.options import Options

# Histogram bucket bounds in seconds.
DURATION_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
AGE_BUCKETS = (
    5.0,
    30.0,
    60.0,
    300.0,
    900.0,
    3600.0,
    21600.0,
    86400.0,
    259200.0,
    604800.0,
)

# Stages of the corrupted-rows counter.
STAGE_SCHEDULE = "schedule"
STAGE_RETENTION = "retention"
ALL = "_all"


def _label(bound: float) -> str:
    return f"{bound:g}"


def histogram(
    df: DataFrame, value: str, by: Sequence[str], bounds: Sequence[float]
) -> DataFrame:
    """Cumulative buckets per label set: by, le, cumulative_count, sum, count.

    All buckets are counted in one pass and turned into rows after the aggregation, so
    the input is not multiplied. The sum is taken in microseconds, hence exact.
    """
    seen = F.col(value)
    counts = [F.count_if(seen <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    micros = F.sum(F.round(seen * 1e6).cast("bigint"))
    grouped = df.groupBy(*by).agg(
        *counts, F.count(value).alias("count"), (micros / 1e6).alias("sum")
    )
    rows = [
        F.struct(F.lit(_label(b)).alias("le"), F.col(f"_b{i}").alias("cumulative_count"))
        for i, b in enumerate(bounds)
    ]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("cumulative_count")))
    return grouped.select(*by, F.inline(F.array(*rows)), "sum", "count")


def _count(df: DataFrame, *labels, name: str = "value") -> DataFrame:
    return df.groupBy(*labels).agg(F.count("*").alias(name))


def m_events_total(events: DataFrame, opts: Options) -> DataFrame:
    return _count(schedule.accepted_events(events, opts), "kind")


def m_deliveries_total(log: DataFrame) -> DataFrame:
    return _count(
        log,
        F.col("callback_name").alias("callback"),
        F.col("completion_mode").alias("mode"),
        "result",
    )


def m_dispatch_duration(log: DataFrame) -> DataFrame:
    labelled = log.select(
        F.col("callback_name").alias("callback"),
        F.col("completion_mode").alias("mode"),
        "duration_seconds",
    )
    return histogram(labelled, "duration_seconds", ["callback", "mode"], DURATION_BUCKETS)


def m_lag_seconds(totals: DataFrame) -> DataFrame:
    """NaN when nothing is pending, so that it differs from an age of 0."""
    return totals.select(
        F.coalesce(F.col("oldest_pending_age_seconds"), F.lit(float("nan"))).alias("value")
    )


def m_pending(by_callback: DataFrame) -> DataFrame:
    rows = F.array(
        F.struct(F.lit("managed").alias("mode"), F.col("pending_managed").alias("value")),
        F.struct(F.lit("external").alias("mode"), F.col("pending_external").alias("value")),
    )
    return by_callback.select(F.col("callback_name").alias("callback"), F.inline(rows))


def m_external_pending(by_callback: DataFrame) -> DataFrame:
    return by_callback.select(
        F.col("callback_name").alias("callback"), F.col("external_pending").alias("value")
    )


def m_external_pending_seconds(ages: DataFrame) -> DataFrame:
    labelled = ages.select(F.col("callback_name").alias("callback"), "age_seconds")
    return histogram(labelled, "age_seconds", ["callback"], AGE_BUCKETS)


def m_dead_letters_total(log: DataFrame) -> DataFrame:
    return _count(log.filter("dead_letter"), F.col("callback_name").alias("callback"))


def _with_total(report: DataFrame, column: str) -> DataFrame:
    """Per callback and, as callback ``_all``, the total."""
    return report.cube("callback_name").agg(
        F.sum(column).cast("bigint").alias("value"), F.grouping("callback_name").alias("_total")
    ).select(
        F.when(F.col("_total") == 1, ALL).otherwise(F.col("callback_name")).alias("callback"),
        "value",
    )


def m_timeout_resets_total(sweep_report: DataFrame) -> DataFrame:
    return _with_total(sweep_report, "reset")


def m_cycles_exhausted_total(sweep_report: DataFrame) -> DataFrame:
    return _with_total(sweep_report, "exhausted")


def m_signing_key_failures(signed: DataFrame) -> DataFrame:
    return _count(
        signed.filter(F.col("send_error").isNotNull()),
        "signing_key_id",
        F.col("callback_name").alias("callback"),
    )


def m_invalid_callbacks_total(rejects: DataFrame) -> DataFrame:
    return _count(rejects.filter(F.col("reason").isNotNull()), "reason")


def m_payload_rejections_total(events: DataFrame, opts: Options) -> DataFrame:
    big = fanout.with_payload_size(events).filter(
        F.col("payload_size_bytes") > opts.payload_size_limit
    )
    return _count(big, "kind")


def m_retention_deletions_total(report: DataFrame) -> DataFrame:
    return report.select("reason", F.col("deleted").alias("value"))


def m_oldest_retention_age(age: DataFrame) -> DataFrame:
    return age.select(F.coalesce(F.col("age_seconds"), F.lit(float("nan"))).alias("value"))


def m_corrupted_rows_total(corrupt: DataFrame, stage: str = STAGE_SCHEDULE) -> DataFrame:
    return corrupt.agg(F.count("*").alias("value")).select(F.lit(stage).alias("stage"), "value")


def m_cycle_duration(run_log: DataFrame) -> DataFrame:
    return histogram(run_log, "duration_seconds", ["worker"], DURATION_BUCKETS)


def zero_fill_gauges(previous: DataFrame, current: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Current gauge values, with 0 for label sets that were seen before and are gone."""
    gone = previous.select(*labels).join(current.select(*labels), list(labels), "left_anti")
    kind = current.schema["value"].dataType
    return current.select(*labels, "value").unionByName(
        gone.distinct().withColumn("value", F.lit(0).cast(kind))
    )
