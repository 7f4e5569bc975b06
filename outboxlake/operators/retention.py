"""Retention of finished events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outboxlake.functions import states, times
from outboxlake.options import RetentionOptions

PROCESSED, DEAD_LETTER = "processed", "dead_letter"


@dataclass(frozen=True)
class Cutoffs:
    dead_letter: times.AsOf
    processed: times.AsOf

    @classmethod
    def of(cls, opts: RetentionOptions, as_of: times.AsOf) -> Cutoffs:
        return cls(
            times.shifted(as_of, days=-opts.dead_letter_days),
            times.shifted(as_of, days=-opts.processed_days),
        )


@dataclass(frozen=True)
class RetentionResult:
    deleted: DataFrame
    events: DataFrame
    deliveries: DataFrame
    report: DataFrame


def terminal_events(events: DataFrame, deliveries: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """Events past their window with no open delivery: id, event_id, created_at, reason.

    The deliveries are reduced to two flags per event before the join; both sides use
    the event id, so the table moves once.
    """
    created = F.col("created_at")
    dead_cut = times.like(events, "created_at", cutoffs.dead_letter)
    done_cut = times.like(events, "created_at", cutoffs.processed)
    flags = deliveries.groupBy("event_id").agg(
        F.max(states.is_open()).alias("open"), F.max("dead_letter").alias("dead")
    )
    old = events.filter(created < F.greatest(dead_cut, done_cut)).select(
        "id", "event_id", "created_at"
    )
    dead = F.coalesce(F.col("dead"), F.lit(False))
    return (
        old.join(flags, "event_id", "left")
        .filter(~F.coalesce(F.col("open"), F.lit(False)))
        .filter(created < F.when(dead, dead_cut).otherwise(done_cut))
        .select(
            "id",
            "event_id",
            "created_at",
            F.when(dead, DEAD_LETTER).otherwise(PROCESSED).alias("reason"),
        )
    )


def apply_retention(
    events: DataFrame,
    deliveries: DataFrame,
    cutoffs: Cutoffs,
    batch_limit: int | None = 1_000,
) -> RetentionResult:
    """Deletes the first ``batch_limit`` terminal events and their deliveries."""
    doomed = terminal_events(events, deliveries, cutoffs)
    if batch_limit is not None:
        doomed = doomed.orderBy("id").limit(batch_limit)
    keys = doomed.select("event_id")
    return RetentionResult(
        deleted=doomed,
        events=events.join(keys, "event_id", "left_anti").select(*events.columns),
        deliveries=deliveries.join(keys, "event_id", "left_anti").select(*deliveries.columns),
        report=doomed.groupBy("reason").agg(F.count("*").alias("deleted")),
    )


def oldest_terminal_age(
    events: DataFrame, deliveries: DataFrame, cutoffs: Cutoffs, as_of: times.AsOf
) -> DataFrame:
    """Age of the oldest event still eligible, NULL if none."""
    now = times.like(events, "created_at", as_of)
    return terminal_events(events, deliveries, cutoffs).agg(
        times.seconds_between(F.min("created_at"), now).alias("age_seconds")
    )
