"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outboxlake.options import ERROR_BYTES


def cut_utf8(text: Column, limit: int = ERROR_BYTES) -> Column:
    """Longest prefix of at most ``limit`` bytes that ends on a character boundary."""
    raw = text.cast("binary")
    prefixes = [
        F.try_validate_utf8(F.substring(raw, 1, limit - back).cast("string"))
        for back in range(min(4, limit + 1))
    ]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.coalesce(*prefixes))
