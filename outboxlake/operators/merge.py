"""Changed rows and snapshots.

State operators return only the rows they change, in the deliveries schema; this
module puts them back into the full table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outboxlake.schemas import DELIVERY_COLUMNS


def changed_row(row: str, changes: dict[str, Column]) -> list[Column]:
    """The delivery in struct column ``row`` with some fields replaced."""
    return [changes.get(n, F.col(f"{row}.{n}")).alias(n) for n in DELIVERY_COLUMNS]


def merge_deliveries(deliveries: DataFrame, changed: DataFrame) -> DataFrame:
    """Full table with the changed rows in place; one join on id.

    The changed side is small next to the table, so the planner may broadcast it.
    """
    new = changed.select(F.col("id").alias("_id"), F.struct(*DELIVERY_COLUMNS).alias("_new"))
    joined = deliveries.join(new, deliveries["id"] == new["_id"], "left")
    hit = F.col("_id").isNotNull()
    return joined.select(
        *[
            F.when(hit, F.col(f"_new.{n}")).otherwise(deliveries[n]).alias(n)
            for n in DELIVERY_COLUMNS
        ]
    )
