"""Synchronised neighbours in a grid rolled up into square blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def max_level(cols: int, rows: int, tile: int, max_pixels: int) -> int:
    """The largest k whose blocks of 2^k by 2^k tiles fit the grid and the pixel budget."""
    level = 0
    while (tile << (level + 1)) ** 2 <= max_pixels and 2 << level <= min(cols, rows):
        level += 1
    return level


def roll_up(cells: DataFrame, batch: list[str], levels: int) -> DataFrame:
    """batch, start, col, row, level of the largest aligned blocks whose cells all run from the same start.

    ``cells`` has the batch columns (what closed together), start, col, row; a cell at most once per batch.  Only whole
    cells with runs that may merge belong in it.  From the largest level down, a block of 4^k cells takes them all and
    the anti-join leaves the rest for the next level; what no block takes is level 0.
    """
    rest, found = cells.select(*batch, "start", "col", "row"), []
    for k in range(levels, 0, -1):
        block = [F.shiftright("col", k).alias("bc"), F.shiftright("row", k).alias("br")]
        full = rest.groupBy(*batch, "start", *block).agg(F.count("*").alias("n")).where(F.col("n") == 4**k).drop("n")
        found.append(full.select(*batch, "start", F.shiftleft("bc", k).alias("col"), F.shiftleft("br", k).alias("row"), F.lit(k).alias("level")))
        rest = rest.select("*", *block).join(full, [*batch, "start", "bc", "br"], "left_anti").select(*batch, "start", "col", "row")
    return reduce(DataFrame.unionByName, [*found, rest.withColumn("level", F.lit(0))])
