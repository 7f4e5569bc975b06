"""Delivery state predicates over the columns of a deliveries table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_open(c=F.col) -> Column:
    """Neither processed nor dead."""
    return c("processed_at").isNull() & ~c("dead_letter")


def is_pending(c=F.col) -> Column:
    return c("dispatched_at").isNull() & is_open(c)


def is_unlocked(as_of: Column, c=F.col) -> Column:
    return c("locked_until").isNull() | (c("locked_until") < as_of)


def is_due(as_of: Column, c=F.col) -> Column:
    return is_pending(c) & (c("available_at") <= as_of) & is_unlocked(as_of, c)


def is_claimable(as_of: Column, c=F.col) -> Column:
    """What a claim checks: neither processed_at nor available_at."""
    return is_unlocked(as_of, c) & c("dispatched_at").isNull() & ~c("dead_letter")


def is_external_pending(c=F.col) -> Column:
    return (
        (c("completion_mode") == "external") & c("dispatched_at").isNotNull() & is_open(c)
    )
