"""A quality-floored search for parameters, one axis after another."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed axes of the search, in order, their first values first.
AXES = {"tile": (64, 128, 256), "colors": (0, 32, 16), "quant": (32, 16, 8), "tolerance": (0, 4, 8, 16)}
FLOOR_LOSS = 1.0
COMMAND_COST = 100
BLOCK, CHUNKS, EVAL_CHUNK = 3000.0, 4, 2


@dataclass(frozen=True)
class Parameters:
    tile: int = 64
    colors: int = 0
    quant: int = 32
    tolerance: int = 8


@dataclass(frozen=True)
class Score:
    train: float
    evaluation: float
    bytes: float
    commands: float

    @property
    def cost(self) -> float:
        return self.bytes + COMMAND_COST * self.commands


def sample_windows(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, start, end and fold (train or eval) of each segment (start, duration, is_first).

    A segment of up to 3000 ms is train and eval as a whole; of a longer one a block of 3000 ms, in the middle of the first
    segment and at the start of others, is cut in four, of which the third is eval.
    """
    base = F.when(F.col("is_first"), F.col("start") + (F.col("duration") - BLOCK) / 2).otherwise(F.col("start"))
    size = BLOCK / CHUNKS
    parts = F.array(*[F.struct((base + i * size).alias("start"), (base + (i + 1) * size).alias("end"), F.lit("eval" if i == EVAL_CHUNK else "train").alias("fold")) for i in range(CHUNKS)])
    whole = F.array(*[F.struct(F.col("start").cast("double").alias("start"), (F.col("start") + F.col("duration")).cast("double").alias("end"), F.lit(f).alias("fold")) for f in ("train", "eval")])
    return segments.select(*keys, F.explode(F.when(F.col("duration") <= BLOCK, whole).otherwise(parts)).alias("w")).select(*keys, "w.*")


def fold_probes(probes: DataFrame, keys: list[str]) -> DataFrame:
    """A10: mean quality and sums of the rest over a candidate's windows."""
    return probes.groupBy(*keys).agg(F.avg("psnr").alias("psnr"), F.sum("bytes").alias("bytes"), F.sum("commands").alias("commands"))


def cost(bytes_: Column, commands: Column) -> Column:
    return bytes_ + COMMAND_COST * commands


def select_best(candidates: DataFrame, groups: list[str]) -> DataFrame:
    """Per group the cheapest candidate (ord, train, eval, floor, bytes, commands) at or over the floor in both folds.

    Where none passes, the one of best train quality; ties go to the lower ord.
    """
    passes = (F.col("train") >= F.col("floor")) & (F.col("eval") >= F.col("floor"))
    price = cost(F.col("bytes"), F.col("commands"))
    best = candidates.groupBy(*groups).agg(
        F.min_by("ord", F.when(passes, F.struct(price.alias("c"), F.col("ord").alias("o")))).alias("cheapest"), F.max_by("ord", F.struct("train", (-F.col("ord")).alias("o"))).alias("finest"), F.count_if(passes).alias("passing")
    )
    return best.select(*groups, "passing", F.when(F.col("passing") > 0, F.col("cheapest")).otherwise(F.col("finest")).alias("chosen"))


def tune(probe: Callable[[list[Parameters]], list[Score]], start: Parameters | None = None, axes: dict[str, tuple] = AXES) -> tuple[Parameters, int]:
    """H2, H3: the winner and how many candidates were probed.

    ``probe`` scores a list of candidates in one go, so that a Spark job can take an axis at once.  The value that the winner
    has already is not probed again.  If no value of the last axis meets the floor in both folds, the defaults are the answer.
    """
    best = start or Parameters()
    score = probe([best])[0]
    floor, probed = score.train - FLOOR_LOSS, 1
    for axis, values in axes.items():
        rest = [replace(best, **{axis: v}) for v in values if v != getattr(best, axis)]
        scored = [(best, score), *zip(rest, probe(rest), strict=True)]
        probed += len(rest)
        by_value = sorted(scored, key=lambda x: values.index(getattr(x[0], axis)))
        passing = [x for x in by_value if min(x[1].train, x[1].evaluation) >= floor]
        best, score = min(passing, key=lambda x: x[1].cost) if passing else max(by_value, key=lambda x: x[1].train)
    return best if passing else start or Parameters(), probed
