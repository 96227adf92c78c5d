"""How near a reconstruction is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PEAK = 255.0
C1, C2 = (0.01 * PEAK) ** 2, (0.03 * PEAK) ** 2


def psnr(mse: Column) -> Column:
    """A5: decibels; 100 for equal signals."""
    return F.when(mse <= 0, F.lit(100.0)).otherwise(10 * F.log10(PEAK * PEAK / mse))


def ssim(mean_a: Column, mean_b: Column, var_a: Column, var_b: Column, covar: Column) -> Column:
    """Of a whole frame, from population moments."""
    return (2 * mean_a * mean_b + C1) * (2 * covar + C2) / ((mean_a * mean_a + mean_b * mean_b + C1) * (var_a + var_b + C2))


def frame_scores(pairs: DataFrame, frame: list[str]) -> DataFrame:
    """frame, psnr and ssim from sample rows (a, b) of two signals, matched by place."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    moments = pairs.groupBy(*frame).agg(
        F.avg((a - b) * (a - b)).alias("mse"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.covar_pop(a, b).alias("cab")
    )
    return moments.select(*frame, psnr(F.col("mse")).alias("psnr"), ssim(*[F.col(c) for c in ("ma", "mb", "va", "vb", "cab")]).alias("ssim"))


def mean_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Means of the frames' decibels; 0 of none."""
    return scores.groupBy(*keys).agg(F.count("*").alias("frames"), F.coalesce(F.avg("psnr"), F.lit(0.0)).alias("psnr"), F.coalesce(F.avg("ssim"), F.lit(0.0)).alias("ssim"))
