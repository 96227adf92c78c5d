"""Runs of unchanged content in many keyed series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold_sorted


def change_runs(df: DataFrame, keys: list[str], order: list[str], time: str, content: str, bucket: Column) -> DataFrame:
    """keys, start, end, n and content of every maximal run of equal content.

    A run ends where the next one of its key starts, the last one at the key's last time (it may have no length).
    ``bucket`` is a column that never falls along ``order``, such as the week of ``time``: rows are windowed by key and
    bucket, and only one row per key and bucket is windowed by key to join runs across buckets, so one key with most of
    the rows is still spread over tasks.  Null content is a content like any other.
    """
    rows = df.select(*keys, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.col(time).alias("time"), F.col(content).alias("content"), bucket.alias("__b"))
    by = Window.partitionBy(*keys, "__b").orderBy(*[f"__o{i}" for i in range(len(order))])
    first = F.row_number().over(by) == 1
    changed = first | ~F.col("content").eqNullSafe(F.lag("content").over(by))
    parts = (
        rows.withColumn("__new", changed).withColumn("__s", F.sum(F.col("__new").cast("int")).over(by))
        .groupBy(*keys, "__b", "__s")
        .agg(F.min("time").alias("start"), F.max("time").alias("last"), F.count("*").alias("n"), F.first("content").alias("content"))
    )
    within = Window.partitionBy(*keys, "__b").orderBy("__s")
    parts = parts.withColumn("next", F.lead("start").over(within))
    edges = parts.groupBy(*keys, "__b").agg(
        F.min("start").alias("opened"), F.max("last").alias("closed"), F.max("__s").alias("parts"),
        F.min_by(F.struct("content"), "__s").alias("head"), F.max_by(F.struct("content"), "__s").alias("tail"),
    )
    along = Window.partitionBy(*keys).orderBy("__b")
    joined = F.coalesce(F.col("head").eqNullSafe(F.lag("tail").over(along)), F.lit(False)) & F.lag("__b").over(along).isNotNull()
    edges = edges.withColumn("joined", joined)
    opening = F.when((F.col("parts") > 1) | ~F.col("joined"), F.struct(F.col("__b").alias("b"), F.col("parts").alias("s")))
    edges = edges.select(
        *keys, "__b", "joined", "parts",
        F.last(opening, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("from"),
        F.lead("opened").over(along).alias("after"),
        F.max("closed").over(Window.partitionBy(*keys)).alias("end_of_key"),
    )
    own = F.struct(F.col("__b").alias("b"), F.col("__s").alias("s"))
    run = F.when((F.col("__s") == 1) & F.col("joined"), F.col("from")).otherwise(own)
    return (
        parts.join(edges, [*keys, "__b"])
        .select(*keys, run.alias("__r"), "start", "n", "content", F.coalesce("next", "after", "end_of_key").alias("end"))
        .groupBy(*keys, "__r")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.first("content").alias("content"))
        .drop("__r")
    )


def mean_difference(a: Column, b: Column) -> Column:
    """mean absolute difference of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def fold_tolerant(values: np.ndarray, steps: np.ndarray, tolerance: float, opened: tuple[float, float] | None = None) -> np.ndarray:
    """Whether each row of one ordered series opens a run.

    A row goes on with the run while its step (quantised content) is the one last seen to open it, or its raw value is
    within ``tolerance`` of the value the run opened with.  ``opened`` has value and step of a run that is already open.
    """
    opens = np.zeros(len(values), bool)
    snapshot, step = opened or (np.nan, None)
    for i, (v, s) in enumerate(zip(values.tolist(), steps.tolist(), strict=True)):
        if s == step or abs(v - snapshot) <= tolerance:
            continue
        opens[i], snapshot, step = True, v, s
    return opens


def tolerant_runs(df: DataFrame, keys: list[str], order: str, value: str, step: Column, tolerance: float) -> DataFrame:
    """Runs whose values stay near the value they opened with; the fold compares with the run, not with the row before.

    A key's series passes through one task, which holds its open run and one batch.
    """
    rows = df.select(*keys, F.col(order).alias("at"), F.col(value).cast("double").alias("value"), step.cast("long").alias("step"))

    def run(state: tuple | None, piece: dict[str, list]) -> tuple[list[tuple], tuple]:
        at, value = piece["at"], piece["value"]
        values, steps = (np.array([np.nan if x is None else x for x in piece[c]]) for c in ("value", "step"))
        opens = np.flatnonzero(fold_tolerant(values, steps, tolerance, state and state[:2])).tolist()
        done, since = [], 0
        for i in opens:
            if state:
                done.append((state[2], at[i], state[4] + i - since, state[5]))
            state, since = (values[i], steps[i], at[i], at[i], 0, value[i]), i
        return done, (*state[:3], at[-1], state[4] + len(at) - since, state[5])

    def last(state: tuple) -> list[tuple]:
        return [(state[2], state[3], state[4], state[5])]

    along = [F.col(c).asc_nulls_last() for c in ("at", "value", "step")]
    return fold_sorted(rows, keys, along, run, last, {"start": "at", "end": "at", "n": "long", "value": "double"})


def closed_counts(runs: DataFrame, bucket: Column) -> DataFrame:
    """How many runs close in each bucket of their end."""
    return runs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("closed"))


