"""Keys with most of the rows: results as a sequential fold gives them, and plans that gather no key's rows."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from runloom import queries
from runloom.operators import bursts, dedupe, rewrite, runs
from runloom.session import BATCH
from runloom.streaming.runs import in_order

DIR = "/root/testdata/sf0.001"
GATHERING = ("FlatMapGroups", "collect_list", "array_sort", "concat(")


@pytest.fixture
def small_batches(spark):
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "7")
    yield
    spark.conf.set(BATCH, before)


def keyed(seed: int, n: int = 400) -> list[tuple]:
    """Three fourths of the rows have key 1; a few have none."""
    rng = random.Random(seed)
    return [(rng.choice([1] * 9 + [2, 3, None]), t, rng.uniform(0, 100)) for t in range(n)]


@pytest.mark.parametrize("name", ["tolerant_segmentation", "merged_commands", "scene_cuts"])
def test_plans_gather_no_key(spark, name):
    plan = queries.QUERIES[name](spark, DIR)._jdf.queryExecution().toString()
    assert not [x for x in GATHERING if x in plan]


@pytest.mark.parametrize("name", ["sequence_dedupe", "role_loops"])
def test_queries_gather_no_key(spark, monkeypatch, name):
    """These cut their lineage, so no plan shows all."""
    for f in ("collect_list", "array_sort"):
        monkeypatch.setattr(F, f, None)
    assert queries.QUERIES[name](spark, DIR).count() > 0


def test_tolerant_runs_across_batches(spark, small_batches):
    data = keyed(1)
    df = spark.createDataFrame(data, "k int, t long, v double")
    got = runs.tolerant_runs(df, ["k"], "t", "v", F.floor(F.col("v") / 32), 20.0).collect()
    want = []
    for k in (1, 2, 3, None):
        series = [(t, v) for kk, t, v in data if kk == k]
        values = np.array([v for _, v in series])
        at = [*np.flatnonzero(runs.fold_tolerant(values, values // 32, 20.0)).tolist(), len(series)]
        want += [(k, series[a][0], series[min(b, len(series) - 1)][0], b - a, series[a][1]) for a, b in zip(at[:-1], at[1:])]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_merge_across_batches(spark, small_batches):
    steps = [0.1 if (i // 23) % 2 else 0.2 for i in range(300)]
    data = [("o", "F", i, float(i), i + 1.0, 0, sum(steps[:i], 0.0), sum(steps[: i + 1])) for i in range(300)]
    got = rewrite.merge_adjacent(spark.createDataFrame(data, "object string, kind string, seq int, start double, end double, easing int, v_start double, v_end double")).collect()
    assert sorted((r.seq, r.start, r.end) for r in got) == [(i, float(i), min(i + 23.0, 300.0)) for i in range(0, 300, 23)]


def test_scenes_across_batches(spark, small_batches):
    data = [(k, float(t)) for k, t, _ in keyed(2) if k]
    df = spark.createDataFrame(data, "k int, t double")
    cuts = bursts.spaced_starts(df, ["k"], "t", 30.0)
    bounds = df.groupBy("k").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    want = bursts.scenes(bounds.join(bursts.spaced(df, ["k"], "t", 30.0), "k"), ["k"]).collect()
    assert sorted(bursts.scenes_between(bounds, cuts, ["k"]).collect()) == sorted(want)
    taken = []
    for t in sorted(t for k, t in data if k == 1):
        if not taken or t - taken[-1] >= 30:
            taken.append(t)
    assert sorted(r.cut for r in cuts.where("k = 1").collect()) == taken


def test_sequences_across_batches(spark, small_batches):
    data = [(k, t, f"é{v}") for k, t, v in keyed(3)]
    got = dedupe.assign_sequences(spark.createDataFrame(data, "k int, t int, c string"), ["k"], "t", F.col("c")).collect()
    want = {k: hashlib.sha256("\x1f".join(c for kk, _, c in data if kk == k).encode()).hexdigest() for k in (1, 2, 3, None)}
    assert {r.k: r.sequence_key for r in got} == want


def test_loop_periods_are_those_of_arrays(spark):
    bodies = ["aaaa", "ababab", "aabaabaab", "abab", "abcabcab", "a", "aabbaabbaabb" * 3, "ab" * 5 + "ba", "xyz" * 40, "nnnmnnnmnnnm"]
    data = [(k if k else None, 10.0 * i + (0.5 if k == 1 and i == 4 else 0), None if c == "n" else c) for k, body in enumerate(bodies) for i, c in enumerate(body)]
    df = spark.createDataFrame(data, "k int, t double, c string")
    arrays = df.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("t", "c"))).alias("items"))
    want = rewrite.extract_loops(arrays).select("k", F.size("items").alias("n"), "period", "count").collect()
    got = rewrite.loop_periods(df, ["k"], "t", "c").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want))) and sum(r.period is not None for r in got) >= 4


@pytest.mark.parametrize("held", [10, 64, 5000])
def test_stream_rows_come_in_order(held):
    rng = random.Random(4)
    data = pd.DataFrame({"time": pd.to_datetime([rng.randrange(200) for _ in range(1000)], unit="s"), "content": [None if i % 9 == 0 else str(i) for i in range(1000)]})
    batches = (data[i : i + 7] for i in range(0, 1000, 7))
    want = data.sort_values("time", kind="stable")
    assert list(in_order(batches, held)) == list(zip(want["time"], want["content"]))
    assert list(in_order(iter([]), held)) == [] and math.ceil(1000 / 10) > 32
