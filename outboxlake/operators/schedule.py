"""Scheduling: new events, insert-if-absent of deliveries, cursor and rescan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outboxlake.functions import times
from outboxlake.functions import variant as vj
from outboxlake.functions.text import cut_utf8
from outboxlake.operators import fanout
from outboxlake.operators.numbering import dense_ids
from outboxlake.options import Options
from outboxlake.schemas import DELIVERY_COLUMNS


@dataclass(frozen=True)
class ScheduleResult:
    """``new_rows`` to append, ``rejects`` (every refused callback, also those whose row
    lost to an earlier one), ``corrupt`` events and the one-row ``cursor``.

    Each is planned on first use. ``highest`` is the highest delivery id given so far, by
    default the one in ``deliveries``.
    """

    batch: DataFrame
    deliveries: DataFrame
    opts: Options
    as_of: times.AsOf
    start: int | Column
    highest: int | None = None

    @cached_property
    def new_rows(self) -> DataFrame:
        judged = fanout.judge_callbacks(self.batch, self.opts, mark_duplicates=False)
        candidates = delivery_candidates(judged)
        return append_deliveries(candidates, self.deliveries, self.as_of, self.highest)

    @cached_property
    def rejects(self) -> DataFrame:
        return rejects(self.batch, self.opts)

    @cached_property
    def corrupt(self) -> DataFrame:
        return fanout.corrupt_events(self.batch, self.opts)

    @cached_property
    def cursor(self) -> DataFrame:
        start = self.start if isinstance(self.start, Column) else F.lit(self.start)
        highest = F.coalesce(F.max("id"), start.cast("bigint"))
        return self.batch.select("id").agg(highest.alias("cursor"))


def new_events(events: DataFrame, cursor: int | Column = 0, limit: int | None = None) -> DataFrame:
    """Events behind the cursor with their payload size.

    With a limit these are the first rows by id (a top-k, no full sort); without one the
    whole tail is returned unordered, so a backlog of any size stays a plain scan.
    """
    after = fanout.with_payload_size(events.filter(F.col("id") > cursor))
    return after if limit is None else after.orderBy("id").limit(limit)


def delivery_candidates(judged: DataFrame) -> DataFrame:
    """Rows to insert: valid callbacks first, then rejects, each in array order."""
    dead = ~F.col("valid")
    return judged.select(
        F.col("id").alias("event_seq"),
        "event_id",
        F.col("label").alias("callback_name"),
        F.when(dead, F.col("n_callbacks") + F.col("pos")).otherwise(F.col("pos")).alias("ordinal"),
        F.col("mode").alias("completion_mode"),
        dead.alias("dead_letter"),
        cut_utf8(F.col("message")).alias("last_error"),
    )


def append_deliveries(
    candidates: DataFrame,
    deliveries: DataFrame,
    as_of: times.AsOf,
    highest: int | None = None,
) -> DataFrame:
    """New delivery rows for the candidates whose (event, callback) is absent.

    The earliest candidate of a key wins; copies are combined before the shuffle. The
    anti-join uses the same keys as the aggregation, so candidates move once.

    Ids follow ``highest`` (by default the highest id of ``deliveries``) without gaps, in
    the order of events and of rows within an event; see ``numbering``. The rows to insert
    are worked out and written when this is called.
    """
    time_type = deliveries.schema["created_at"].dataType.simpleString()
    row = F.struct(
        "event_seq", "ordinal", "completion_mode", "dead_letter", "last_error"
    )
    first = candidates.groupBy("event_id", "callback_name").agg(F.min(row).alias("r"))
    fresh = first.join(
        deliveries.select("event_id", "callback_name"),
        ["event_id", "callback_name"],
        "left_anti",
    ).select("event_id", "callback_name", "r.*")
    if highest is None:
        highest = deliveries.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).first()["id"]
    order = ["event_seq", "ordinal", "event_id", "callback_name"]
    now = times.instant(as_of, time_type)
    empty_time = F.lit(None).cast(time_type)
    return dense_ids(fresh, order, highest).select(
        F.col("id").cast("bigint").alias("id"),
        "event_id",
        "callback_name",
        "completion_mode",
        F.lit(0).cast("int").alias("attempts"),
        "last_error",
        empty_time.alias("last_attempt_at"),
        now.alias("available_at"),
        empty_time.alias("locked_until"),
        empty_time.alias("dispatched_at"),
        empty_time.alias("processed_at"),
        F.lit(0).cast("int").alias("completion_cycles"),
        "dead_letter",
        now.alias("created_at"),
    ).select(*DELIVERY_COLUMNS)


def schedule_deliveries(
    events: DataFrame,
    deliveries: DataFrame,
    opts: Options,
    as_of: times.AsOf,
    cursor: int | Column = 0,
    limit: int | None = None,
    highest: int | None = None,
) -> ScheduleResult:
    """Fan new events out into pending and dead-lettered delivery rows."""
    batch = new_events(events, cursor, limit)
    return ScheduleResult(batch, deliveries, opts, as_of, cursor, highest)


def rejects(events: DataFrame, opts: Options) -> DataFrame:
    """Refused callbacks with their reason; oversized payloads have none."""
    judged = fanout.judge_callbacks(events, opts)
    return vj.filter_once(judged, ~F.col("valid")).select(
        "id",
        "event_id",
        "kind",
        "created_at",
        "branch",
        "pos",
        "label",
        "reason",
        "message",
    )


def accepted_events(events: DataFrame, opts: Options) -> DataFrame:
    """Events that reached the split into valid and invalid callbacks."""
    classified = fanout.classify_events(events, opts)
    return vj.filter_once(classified, F.col("branch") == fanout.CHECKED).select(*fanout.EVENT_KEYS)


def recover_cursor(events: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Id of the event behind the last inserted delivery, 0 if there is none."""
    last = deliveries.agg(F.max_by("event_id", "id").alias("event_id"))
    found = last.join(events.select("event_id", "id"), "event_id", "inner")
    return found.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("cursor"))


def rescan_cursor(events: DataFrame, since: times.AsOf) -> DataFrame:
    """Highest event id created before ``since``, 0 if there is none."""
    return events.filter(F.col("created_at") < times.like(events, "created_at", since)).agg(
        F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("cursor")
    )


def rescan_since(
    events: DataFrame,
    deliveries: DataFrame,
    opts: Options,
    as_of: times.AsOf,
    since: times.AsOf,
    highest: int | None = None,
) -> ScheduleResult:
    """Backfill in one pass: schedule everything behind the rescan cursor."""
    start = rescan_cursor(events, since).scalar()
    return schedule_deliveries(events, deliveries, opts, as_of, start, highest=highest)


