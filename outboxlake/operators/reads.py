"""Operator reads: pages, details, statistics and the indexed lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outboxlake.functions import states, times
from outboxlake.options import Options, Page
from outboxlake.schemas import DELIVERY_COLUMNS, EVENT_COLUMNS


def _page(deliveries: DataFrame, events: DataFrame, page: Page) -> DataFrame:
    """Newest rows of the page whose event exists, then their event kind.

    Chosen on narrow columns; the event is looked up for at most ``page.rows`` rows.
    """
    if page.before is not None:
        deliveries = deliveries.filter(F.col("id") < page.before)
    if page.callback_name is not None:
        deliveries = deliveries.filter(F.col("callback_name") == page.callback_name)
    chosen = (
        deliveries.join(events.select("event_id"), "event_id", "left_semi")
        .orderBy(F.desc("id"))
        .limit(page.rows)
    )
    kinds = events.select("event_id", F.col("kind").alias("event_kind"))
    return chosen.join(kinds, "event_id", "inner").withColumnRenamed("id", "delivery_id")


def dead_letters(events: DataFrame, deliveries: DataFrame, page: Page) -> DataFrame:
    rows = _page(deliveries.filter("dead_letter"), events, page)
    return rows.select(
        "delivery_id",
        "event_id",
        "event_kind",
        "callback_name",
        "completion_mode",
        "attempts",
        "last_error",
        "last_attempt_at",
        "created_at",
    ).orderBy(F.desc("delivery_id"))


def external_pending(
    events: DataFrame,
    deliveries: DataFrame,
    page: Page,
    as_of: times.AsOf,
    older_than_seconds: float | None = None,
) -> DataFrame:
    waiting = deliveries.filter(states.is_external_pending())
    if older_than_seconds is not None:
        age = times.seconds_between(
            F.col("dispatched_at"), times.like(deliveries, "dispatched_at", as_of)
        )
        waiting = waiting.filter(age > older_than_seconds)
    return (
        _page(waiting, events, page)
        .select(
            "delivery_id",
            "event_id",
            "event_kind",
            "callback_name",
            "attempts",
            "dispatched_at",
            "created_at",
        )
        .orderBy(F.desc("delivery_id"))
    )


def next_cursor(rows: DataFrame, page: Page) -> DataFrame:
    """Where the next page starts; NULL after the last one."""
    return rows.agg(
        F.when(F.count("*") == page.rows, F.min("delivery_id")).alias("next_cursor")
    )


def event_detail(
    events: DataFrame, deliveries: DataFrame, event_id: str | None = None
) -> DataFrame:
    """Event columns and its deliveries, one row per delivery; all events without an id."""
    if event_id is not None:
        events = events.filter(F.col("event_id") == event_id)
        deliveries = deliveries.filter(F.col("event_id") == event_id)
    renamed = deliveries.select(
        "event_id",
        *[
            F.col(n).alias(n if n == "callback_name" else f"delivery_{n}")
            for n in DELIVERY_COLUMNS
            if n != "event_id"
        ],
    )
    return events.select(*EVENT_COLUMNS).join(renamed, "event_id", "left")


def event_with_deliveries(events: DataFrame, deliveries: DataFrame, event_id: str) -> DataFrame:
    """One event with the array of its deliveries in id order; no row if it is unknown.

    A single event has at most one delivery per callback name, which bounds the array.
    """
    mine = deliveries.filter(F.col("event_id") == event_id)
    listed = mine.agg(
        F.sort_array(F.collect_list(F.struct(*DELIVERY_COLUMNS))).alias("deliveries")
    )
    event = events.filter(F.col("event_id") == event_id).select(*EVENT_COLUMNS)
    return event.withColumn("deliveries", listed.scalar())


def stats_totals(events: DataFrame, deliveries: DataFrame, as_of: times.AsOf) -> DataFrame:
    """Totals over all events. Settled deliveries are dropped before the join."""
    live = deliveries.filter(states.is_open() | F.col("dead_letter")).select(
        "event_id",
        states.is_pending().alias("pending"),
        states.is_external_pending().alias("waiting"),
        F.col("dead_letter").alias("dead"),
    )
    joined = live.join(events.select("event_id", "created_at"), "event_id", "inner")
    now = times.like(events, "created_at", as_of)
    oldest = F.min(F.when(F.col("pending"), F.col("created_at")))
    total = events.agg(F.count("*")).scalar()
    return joined.agg(
        F.count_if("pending").alias("deliveries_pending"),
        F.count_if("waiting").alias("deliveries_external_pending"),
        F.count_if("dead").alias("deliveries_dead_lettered"),
        times.seconds_between(oldest, now).alias("oldest_pending_age_seconds"),
    ).select(total.alias("events_total"), "*")


def stats_by_callback(deliveries: DataFrame) -> DataFrame:
    managed = F.col("completion_mode") == "managed"
    external = F.col("completion_mode") == "external"
    return deliveries.groupBy("callback_name").agg(
        F.count_if(managed & states.is_pending()).alias("pending_managed"),
        F.count_if(external & states.is_pending()).alias("pending_external"),
        F.count_if(states.is_external_pending()).alias("external_pending"),
        F.count_if("dead_letter").alias("dead_lettered"),
    )


def external_pending_ages(
    deliveries: DataFrame, opts: Options, as_of: times.AsOf
) -> DataFrame:
    """Age of each external-pending delivery; with a limit, the oldest ones."""
    waiting = deliveries.filter(states.is_external_pending())
    if opts.age_sample_limit is not None:
        waiting = waiting.orderBy("dispatched_at", "id").limit(opts.age_sample_limit)
    now = times.like(deliveries, "dispatched_at", as_of)
    return waiting.select(
        "callback_name", times.seconds_between(F.col("dispatched_at"), now).alias("age_seconds")
    )


def sample_truncated(ages: DataFrame, opts: Options) -> DataFrame:
    """Whether the age sample hit its limit."""
    limit = opts.age_sample_limit
    return ages.agg((F.count("*") == F.lit(-1 if limit is None else limit)).alias("truncated"))


def aggregate_history(events: DataFrame, aggregate_type: str, aggregate_id: str) -> DataFrame:
    """All events of one aggregate by id."""
    return events.filter(
        (F.col("aggregate_type") == aggregate_type) & (F.col("aggregate_id") == aggregate_id)
    ).orderBy("id")


def events_by_kind(
    events: DataFrame, kind: str, start: times.AsOf, end: times.AsOf
) -> DataFrame:
    """Events of a kind created in [start, end)."""
    created = F.col("created_at")
    return events.filter(
        (F.col("kind") == kind)
        & (created >= times.like(events, "created_at", start))
        & (created < times.like(events, "created_at", end))
    )


def correlation_trace(events: DataFrame, correlation_id: str | None = None) -> DataFrame:
    """Events that share a correlation id, in trace order.

    Flat rows sorted by (correlation_id, created_at, id): a range sort splits even a
    trace that holds most of the table.
    """
    traced = events.filter(F.col("correlation_id").isNotNull())
    if correlation_id is not None:
        traced = traced.filter(F.col("correlation_id") == correlation_id)
    return traced.orderBy("correlation_id", "created_at", "id")
