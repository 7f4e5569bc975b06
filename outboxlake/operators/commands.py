"""Operator commands applied as a table: retry, complete, abandon.

All commands of a batch act at ``as_of``. A lock is released only by a retry, and a
retry needs the row unlocked, so whether retries take effect depends on the table row
alone. What remains of a sequence is then decided by the last position of each action:
three maxima per delivery, which combine before the shuffle. No command list is built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outboxlake.functions import states, times
from outboxlake.operators.merge import changed_row
from outboxlake.schemas import DELIVERY_COLUMNS

RETRY, COMPLETE, ABANDON = "retry", "complete", "abandon"
ABANDONED_TEXT = "abandoned by operator"


@dataclass(frozen=True)
class CommandResult:
    changed: DataFrame
    outcomes: DataFrame


def apply_commands(
    deliveries: DataFrame, commands: DataFrame, as_of: times.AsOf
) -> CommandResult:
    """Folds the commands of each delivery in ``seq`` order."""
    kind = deliveries.schema["available_at"].dataType.simpleString()
    now, empty = times.instant(as_of, kind), F.lit(None).cast(kind)
    unlocked = states.is_unlocked(now)

    def last(action: str) -> Column:
        return F.max(F.when(F.col("action") == action, F.col("seq"))).alias(action)

    folded = commands.groupBy("delivery_id").agg(last(RETRY), last(COMPLETE), last(ABANDON))
    current = deliveries.select(
        F.col("id").alias("delivery_id"),
        F.struct(*DELIVERY_COLUMNS).alias("delivery"),
        unlocked.alias("unlocked"),
    )
    rows = current.join(folded, "delivery_id", "inner")
    reset = F.col(RETRY).isNotNull() & F.col("unlocked")

    def after_reset(action: str) -> Column:
        done = F.col(action).isNotNull()
        return done & (~reset | (F.col(action) > F.col(RETRY)))

    def base(name: str, fresh: Column) -> Column:
        return F.when(reset, fresh).otherwise(F.col(f"delivery.{name}"))

    processed = base("processed_at", empty)
    changes = {
        "attempts": base("attempts", F.lit(0)),
        "available_at": base("available_at", now),
        "dispatched_at": base("dispatched_at", empty),
        "completion_cycles": base("completion_cycles", F.lit(0)),
        "locked_until": base("locked_until", empty),
        "processed_at": F.when(
            after_reset(COMPLETE), F.coalesce(processed, now)
        ).otherwise(processed),
        "dead_letter": after_reset(ABANDON) | base("dead_letter", F.lit(False)),
        "last_error": F.when(after_reset(ABANDON), ABANDONED_TEXT).otherwise(
            base("last_error", F.lit(None).cast("string"))
        ),
    }
    acts = reset | F.col(COMPLETE).isNotNull() | F.col(ABANDON).isNotNull()
    changed = rows.filter(acts).select(*changed_row("delivery", changes))

    locks = deliveries.select(F.col("id").alias("delivery_id"), unlocked.alias("unlocked"))
    outcome = (
        F.when(F.col("unlocked").isNull(), "not_found")
        .when(F.col("action") != RETRY, "ok")
        .when(F.col("unlocked"), "reset")
        .otherwise("locked")
    )
    outcomes = commands.join(locks, "delivery_id", "left").select(
        "delivery_id", "seq", "action", outcome.alias("outcome")
    )
    return CommandResult(changed, outcomes)


def _single(action: str):
    def apply(deliveries: DataFrame, delivery_ids: DataFrame, as_of: times.AsOf) -> CommandResult:
        commands = delivery_ids.select(
            "delivery_id", F.lit(0).cast("bigint").alias("seq"), F.lit(action).alias("action")
        )
        return apply_commands(deliveries, commands, as_of)

    return apply


retry_deliveries = _single(RETRY)
complete_deliveries = _single(COMPLETE)
abandon_deliveries = _single(ABANDON)
