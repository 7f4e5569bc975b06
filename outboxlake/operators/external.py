"""External completion: hung deliveries and the timeout sweep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outboxlake.functions import rules, states, times
from outboxlake.operators.merge import changed_row
from outboxlake.options import Options
from outboxlake.schemas import DELIVERY_COLUMNS

EXHAUSTED_TEXT = "external_completion_cycles_exhausted"


@dataclass(frozen=True)
class SweepResult:
    changed: DataFrame
    report: DataFrame


def hung_external(
    events: DataFrame, deliveries: DataFrame, opts: Options, as_of: times.AsOf
) -> DataFrame:
    """External deliveries whose completion is overdue, with timeout and cycle limit.

    Both come from the first array element of that name; a missing or non-integer
    timeout never expires.
    """
    waiting = deliveries.filter(states.is_external_pending()).select(
        "event_id", F.struct(*DELIVERY_COLUMNS).alias("delivery")
    )
    joined = waiting.join(events.select("event_id", "callbacks"), "event_id", "inner")

    def as_text(element, field):
        return F.try_variant_get(element[field], "$", "string")

    named = joined.withColumn(
        "_element",
        F.get(
            F.filter(
                rules.callback_array(F.col("callbacks")),
                lambda e: as_text(e, "name") == F.col("delivery.callback_name"),
            ),
            F.lit(0),
        ),
    )
    limit = as_text(F.col("_element"), "max_completion_cycles").try_cast("int")
    timeout = as_text(F.col("_element"), "external_completion_timeout_seconds")
    timed = named.select(
        "event_id",
        "delivery",
        timeout.try_cast("int").alias("timeout_seconds"),
        F.coalesce(limit, F.lit(opts.max_completion_cycles)).alias("max_cycles"),
    )
    now = times.like(deliveries, "dispatched_at", as_of)
    expiry = times.plus_seconds(F.col("delivery.dispatched_at"), F.col("timeout_seconds"))
    return timed.filter(F.col("timeout_seconds").isNotNull() & (expiry < now))


def sweep_external(
    events: DataFrame, deliveries: DataFrame, opts: Options, as_of: times.AsOf
) -> SweepResult:
    """Redelivers hung rows, or dead-letters those out of cycles."""
    hung = hung_external(events, deliveries, opts, as_of).withColumn(
        "exhausted", F.col("delivery.completion_cycles") + 1 >= F.col("max_cycles")
    )
    kind = deliveries.schema["available_at"].dataType.simpleString()
    now, empty = times.instant(as_of, kind), F.lit(None).cast(kind)
    out = F.col("exhausted")

    def keep(name):
        return F.col(f"delivery.{name}")

    changed = hung.select(
        *changed_row(
            "delivery",
            {
                "completion_cycles": keep("completion_cycles") + 1,
                "dispatched_at": F.when(out, keep("dispatched_at")).otherwise(empty),
                "available_at": F.when(out, keep("available_at")).otherwise(now),
                "attempts": F.when(out, keep("attempts")).otherwise(F.lit(0)),
                "last_error": F.when(out, EXHAUSTED_TEXT),
                "dead_letter": out,
                "locked_until": empty,
            },
        )
    )
    report = hung.groupBy(F.col("delivery.callback_name").alias("callback_name")).agg(
        F.count_if(~out).alias("reset"), F.count_if(out).alias("exhausted")
    )
    return SweepResult(changed, report)
