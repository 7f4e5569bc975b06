"""Alert conditions over logs, as sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outboxlake.functions import times

# Alert names and thresholds.
DEAD_LETTERS = "dead_letters_accumulating"
HIGH_LAG = "high_dispatch_lag"
KEY_DRIFT = "signing_key_drift"
CORRUPT_ROWS = "corrupted_rows"
STALLED = "scheduler_stalled"
LAG_THRESHOLD_SECONDS = 300
SPAN, SLIDE = "5 minutes", "1 minute"


def occurrences(rows: DataFrame, alert: str, when: Column) -> DataFrame:
    """(alert, at) log rows, the input of the rate alerts."""
    return rows.select(F.lit(alert).alias("alert"), when.alias("at"))


def rate_alerts(log: DataFrame) -> DataFrame:
    """Windows in which an occurrence was logged.

    Counted per minute first, so only minute totals are spread over the five windows
    each of them falls in.
    """
    minutes = (
        log.groupBy("alert", F.window("at", SLIDE).alias("m"))
        .agg(F.count("*").alias("n"))
        .select("alert", F.col("m.start").alias("at"), "n")
    )
    return (
        minutes.groupBy("alert", F.window("at", SPAN, SLIDE).alias("w"))
        .agg(F.sum("n").alias("occurrences"))
        .select(
            "alert",
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            F.col("occurrences").cast("bigint").alias("occurrences"),
        )
    )


def lag_alert(totals: DataFrame) -> DataFrame:
    """One row if the oldest pending event is older than the threshold."""
    lag = F.col("oldest_pending_age_seconds")
    return totals.filter(lag > LAG_THRESHOLD_SECONDS).select(
        F.lit(HIGH_LAG).alias("alert"), lag.alias("lag_seconds")
    )


def stalled_windows(
    run_log: DataFrame, start: times.AsOf, end: times.AsOf, window_seconds: int = 60
) -> DataFrame:
    """Windows between start and end in which no cycle finished."""
    spark = run_log.sparkSession
    origin = times.as_datetime("1970-01-01")
    first = int((times.as_datetime(start) - origin).total_seconds()) // window_seconds
    last = int((times.as_datetime(end) - origin).total_seconds()) // window_seconds
    kind = run_log.schema["started_at"].dataType.simpleString()
    zero = times.instant(origin, kind)
    finished = times.plus_seconds(F.col("started_at"), F.col("duration_seconds"))
    slot = F.floor(times.seconds_between(zero, finished) / window_seconds)
    busy = run_log.select(slot.alias("id")).distinct()
    return (
        spark.range(first, last)
        .join(busy, "id", "left_anti")
        .select(
            F.lit(STALLED).alias("alert"),
            times.plus_seconds(zero, F.col("id") * window_seconds).alias("window_start"),
            times.plus_seconds(zero, (F.col("id") + 1) * window_seconds).alias("window_end"),
        )
    )
