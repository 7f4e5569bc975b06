"""Joins against key sets that are usually, but not provably, small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outboxlake.session import ensure_checkpoint_dir

BROADCAST_ROWS = 1_000_000


def measured(keys: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Computes a key set once and marks it for broadcast if it is small enough.

    The keys are checkpointed, so they are not computed again by the join; beyond
    ``max_rows`` the join shuffles and adaptive execution splits its skewed keys.
    """
    ensure_checkpoint_dir(keys.sparkSession)
    fixed = keys.checkpoint(eager=True)
    small = fixed.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(fixed) if small else fixed
