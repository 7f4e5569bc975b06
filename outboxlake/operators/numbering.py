"""Dense ids for new rows, in order, without one task seeing all of them."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outboxlake.session import written

#: Rows that one task numbers, and most parts that the rows are cut into.
PART_ROWS, MOST_PARTS = 250_000, 256


def dense_ids(
    rows: DataFrame, order: list[str], start: int, column: str = "id", part_rows: int = PART_ROWS
) -> DataFrame:
    """Adds ``column``: start + 1, start + 2, ... in the order of ``order``, without gaps.

    The rows are written once, so that all passes see the same ones. Quantiles of the first
    column of ``order`` (a number; its equal values stay together) cut them into ranges, the
    ranges are counted, and each numbers its rows behind those of the ranges before it. Only
    the counts of at most ``MOST_PARTS`` ranges pass the driver.
    """
    rows = written(rows, "numbered")
    total = rows.count()
    parts = min(MOST_PARTS, 1 + total // part_rows)
    lead = F.col(order[0])
    bounds: list[int] = []
    if parts > 1:
        shares = [k / parts for k in range(1, parts)]
        bounds = sorted(set(rows.agg(F.percentile_approx(lead, shares, 20 * parts)).first()[0]))
    part = F.lit(0)
    if bounds:
        limits = F.array(*[F.lit(b).cast("bigint") for b in bounds])
        part = F.size(F.filter(limits, lambda b: b < lead))
    cut = rows.withColumn("_part", part)
    counts = {r["_part"]: r["count"] for r in cut.groupBy("_part").count().collect()} if bounds else {}
    before = [0, *accumulate(counts.get(k, 0) for k in range(len(bounds)))]
    base = F.array(*[F.lit(start + b).cast("bigint") for b in before])
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return cut.withColumn(column, F.get(base, F.col("_part")) + place).drop("_part")
