"""Intervals indexed by aligned cells of powers of eight.

An interval lies in the cells of the least power of eight that is as long as it is, so it touches two of them at most (three
where the logarithm rounds down), however long it is; a moment looks up one cell for each power that its key's intervals have.
Of powers of two there would be three times as many to look up, for cells that are seldom much nearer to an interval's length.
Keys of few intervals need no index: each moment meets all of them in one join by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stash

#: Bits of a power, and powers that a key's intervals can have, as bits of a whole number
STEP, LEVELS = 3, 22
#: Rows of a key that meet all others of it; keys with more are crowded
FEW = 256


def level(start: Column, end: Column) -> Column:
    return F.least(F.lit(LEVELS - 1), F.ceil(F.log2(F.greatest(end - start, F.lit(1.0))))).cast("int")


def cell(t: Column, level: Column) -> Column:
    return F.floor(t / F.pow(F.lit(2.0), STEP * level))


def indexed(intervals: DataFrame) -> DataFrame:
    """``intervals`` (start <= end) with level and cell, a row for each cell that they touch."""
    rows = intervals.where("start <= end").withColumn("level", level(F.col("start"), F.col("end")))
    return rows.withColumn("cell", F.explode(F.sequence(cell(F.col("start"), F.col("level")), cell(F.col("end"), F.col("level")))))


def used_levels() -> Column:
    """An aggregate over intervals: the bits of their levels; null without any."""
    own = F.when(F.col("start") <= F.col("end"), level(F.col("start"), F.col("end")))
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), own))


def listed(bits: Column) -> Column:
    """The levels of such bits as an array."""
    return F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.call_function("shiftright", bits, k).bitwiseAND(1) == 1)


def covering(points: DataFrame, intervals: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each point (keys, t) with each interval of its keys that has start <= t <= end.

    Both sides go by key, level and cell, so a key with most of the rows is spread over its cells.
    """
    bits = intervals.groupBy(*keys).agg(used_levels().alias("__bits"))
    at = points.join(bits, list(keys)).withColumn("level", F.explode(listed(F.col("__bits")))).withColumn("cell", cell(F.col("t"), F.col("level")))
    return at.join(indexed(intervals), [*keys, "level", "cell"]).where("start <= t and t <= end").drop("level", "cell", "__bits")


def by_crowd(crowded: DataFrame, keys: tuple[str, ...], few: Callable[..., DataFrame], many: Callable[..., DataFrame], *tables: DataFrame) -> DataFrame:
    """``few`` of the tables' rows of most keys and ``many`` of those of the crowded keys: two ways to one result.

    The crowded keys are written down first; where there are none, only ``few`` is planned.
    """
    keyed = stash(crowded.select(*keys))
    if keyed.isEmpty():
        return few(*tables)
    part = lambda how: [t.join(keyed, list(keys), how).select(t.columns) for t in tables]
    return few(*part("left_anti")).unionByName(many(*part("left_semi")))


def crowded(rows: DataFrame, keys: tuple[str, ...], most: int = FEW) -> DataFrame:
    """The keys of over ``most`` rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(*keys)


#: Hashes of keys that crowds() counts first
BUCKETS = 1 << 16


def crowds(rows: DataFrame, keys: tuple[str, ...], most: int) -> DataFrame:
    """crowded() for a large ``most``: only keys whose hash has over ``most`` rows can be crowded, so the others aren't exchanged."""
    hashed = rows.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("__h"))
    full = hashed.groupBy("__h").agg(F.count("*").alias("__n")).where(F.col("__n") > most).select("__h")
    return crowded(hashed.join(F.broadcast(full), ["__h"], "left_semi"), keys, most)
