"""Keys of few commands meet their moments in one row, crowded ones by the index: the same results, and no exchange of cells where no key is crowded."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from runloom import queries
from runloom.operators import bake, loops, timeline

DIR = "/root/testdata/sf0.001"


def rows(df) -> list[str]:
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture
def commands(spark):
    rng = random.Random(7)
    data = [(o, rng.choice(["Fade", "MoveX", "FlipH"]), i, float(s := rng.randrange(200)), float(s + rng.choice([0, 5, 40])), 0, rng.random(), rng.random()) for i, o in enumerate([1] * 300 + [2] * 7 + [3])]
    return spark.createDataFrame(data, "object int, kind string, seq int, start double, end double, easing int, v_start double, v_end double").cache()


def test_crowded_and_other_keys_agree(spark, commands):
    moments = spark.createDataFrame([(o, k, float(t)) for o in (1, 2, 3, 4) for k in ("Fade", "FlipH") for t in range(-5, 250, 7)], "object int, kind string, t double")
    c = commands.select("object", "kind", "seq", F.struct("start", "end", "easing", F.col("v_start").alias("a"), F.col("v_end").alias("b")).alias("row"))
    keys = ("object", "kind")
    assert rows(timeline.holding(c, moments, keys)) == rows(timeline._holding_many(c, moments, keys))
    spans = commands.select("object", "start", "end")
    at = moments.select("object", "t")
    assert rows(timeline.flag_at(spans, at, ("object",))) == rows(timeline._flags_many(spans, at, ("object",)))
    samples = bake.sample_times(timeline.lifetimes(spans), ["object"], 3.0)
    want = bake.flag_windows(timeline._flags_many(spans, samples, ("object",)), ["object"], 30.0)
    assert rows(bake.flags_under_way(spans, ["object"], 3.0, 30.0)) == rows(want)


@pytest.mark.parametrize("name", ["flag_windows", "baked_segments", "timeline_values", "timeline_flags"])
def test_few_commands_need_no_cells(spark, name):
    assert "cell" not in queries.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()


def test_colours_are_rounded_before_they_are_cut(spark):
    c = spark.sql("select 1 as object, 'Colour' as kind, 1 as seq, 0.0D as start, 10.0D as end, 0 as easing, named_struct('r', 0, 'g', 0, 'b', 0) as c_start, named_struct('r', 100, 'g', 100, 'b', 100) as c_end")
    at = spark.createDataFrame([(1, 2.9)], "object int, t double")
    assert 100 * (2.9 / 10) < 29 and timeline.evaluate_colour(c, at, digits=9).first().g == 29


def test_frames_are_drawn_without_a_call_for_each(spark):
    plan = queries.QUERIES["rendered_frames"](spark, DIR)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan


def test_loops_write_compressed_tables(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "checkpoint", None)  # raw rows, four times the size
    c = spark.createDataFrame([(1, i, "Fade", i * 2.0, i * 2.0 + 2, 0, 0.0, 1.0) for i in range(4)], "object int, seq int, kind string, start double, end double, easing int, v_start double, v_end double")
    assert [r["count"] for r in loops.extract_command_loops(c).where("kind = 'Loop'").collect()] == [4]


def test_runs_baked_in_one_row_and_by_the_index_agree(spark, monkeypatch):
    rng = random.Random(3)
    kinds = ["MoveX", "MoveY", "Scale", "VectorScaleX", "Rotate", "Fade", "Colour", "FlipH", "Additive"]
    grey = lambda: (rng.randrange(256),) * 3
    data = [(o, i, None, rng.choice(kinds), float(s := rng.randrange(80)), float(s + rng.choice([0, 5, 40])), rng.randrange(3), rng.random(), rng.random(), grey(), grey(), None) for i, o in enumerate([1] * 12 + [2] * 4 + [3])]
    colour = "struct<r:int,g:int,b:int>"
    c = spark.createDataFrame(data, f"object int, seq int, parent int, kind string, start double, end double, easing int, v_start double, v_end double, c_start {colour}, c_end {colour}, trigger string").cache()
    pivots = spark.createDataFrame([(o, 320.0, 240.0) for o in (1, 2, 3, 4)], "object int, px double, py double")
    runs = spark.createDataFrame([(o, k, 10.0 * o, 7.0, 0.5, 30.0 * k, 30.0 * k + 25 * (k < 3)) for o in (1, 2, 3, 4) for k in range(4)], "object int, run int, x double, y double, scale double, start double, end double")
    rounded = lambda df: rows(df.select("object", "run", "kind", F.round("start", 6), F.round("end", 6), F.round("v_start", 6) + 0.0, F.round("v_end", 6) + 0.0, "c_start", "c_end"))
    want = rounded(bake._bake_many(c, pivots, runs, 7.0))
    monkeypatch.setattr(type(c), "checkpoint", None)  # few commands leave no raw rows behind
    assert len(want) > 100 and rounded(bake.bake_runs(c, pivots, runs, 7.0)) == want
