"""Flag operators on streams: the same column expressions, and first-seen rows within a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..operators import quality


def flagged_stream(rows: DataFrame, flags: dict[str, Column], *keep: str) -> DataFrame:
    """Stateless: rows with a flag, as they come."""
    return quality.flagged(rows, flags, *keep)


def first_seen(rows: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """One row a key; state older than the watermark is dropped."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
