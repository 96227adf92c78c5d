"""What must be decoded of each source, for all its uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan_sources(members: DataFrame, media: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, first (place of the first member), members, union_start and union_end.

    ``members``: keys, order, start and end (null: from the source's start, to its end); ``media``: keys, duration.
    """
    m = members.join(media.select(*keys, "duration"), keys)
    return m.groupBy(*keys).agg(
        F.min(order).alias("first"), F.count("*").alias("members"),
        F.min(F.coalesce("start", F.lit(0.0))).alias("union_start"), F.max(F.coalesce("end", "duration")).alias("union_end"),
    )


def assign_members(members: DataFrame, plans: DataFrame, keys: list[str]) -> DataFrame:
    """Every member with the window of its plan."""
    return members.join(plans.select(*keys, "union_start", "union_end"), keys)


def distinct_windows(windows: DataFrame) -> DataFrame:
    """Windows to decode once."""
    return windows.select("start", "end").distinct()
