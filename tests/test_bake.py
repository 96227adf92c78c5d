"""Runs of a transformed group, baked into commands of their own."""

import math

import pytest

from runloom.operators import bake

COLUMNS = "object int, seq double, parent double, kind string, start double, end double, easing int, v_start double, v_end double, c_start struct<r:int,g:int,b:int>, c_end struct<r:int,g:int,b:int>, trigger string"


def value(seq, kind, start, end, a=None, b=None, parent=0.0, c=None, trigger=None):
    return (1, float(seq), parent, kind, float(start), float(end), 0, a, b, c, c, trigger)


def baked(spark, commands, *runs):
    df = spark.createDataFrame(commands, COLUMNS)
    pivots = spark.createDataFrame([(1, 320.0, 240.0)], "object int, px double, py double")
    rows = spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(runs)], "object int, run int, x double, y double, scale double, start double, end double")
    out = {}
    for r in bake.bake_runs(df, pivots, rows, 1000 / 30).collect():
        out.setdefault((r.run, r.kind), []).append(r)
    return {k: sorted(v, key=lambda r: r.start) for k, v in out.items()}


def test_what_stays_is_written_once(spark):
    got = baked(spark, [value(1, "Fade", 0, 2000, 0.0, 1.0)], (320, 240, 1, 3000, 4000), (420, 240, 0.5, 5000, 6000))
    assert set(got) == {(i, k) for i in (0, 1) for k in ("MoveX", "MoveY", "VectorScaleX", "VectorScaleY")}
    assert all(len(v) == 1 for v in got.values())
    assert [(got[i, k][0].v_start, got[i, k][0].v_end) for i, k in ((0, "MoveX"), (1, "MoveX"), (1, "MoveY"), (1, "VectorScaleX"))] == [(320, 320), (420, 420), (240, 240), (0.5, 0.5)]
    assert (got[0, "MoveX"][0].start, got[0, "MoveX"][0].end) == (3000, 4000)


def test_a_fade_is_sampled_by_frame(spark):
    got = baked(spark, [value(1, "Fade", 0, 2000, 0.0, 1.0)], (320, 240, 1, 0, 2000))
    fades = got[0, "Fade"]
    assert len(fades) == 60 and fades[0].v_start == 0 and fades[-1].v_end == 1 and fades[-1].end == 2000 and len(got[0, "MoveX"]) == 1
    assert all(a.end == b.start and a.v_end == b.v_start for a, b in zip(fades, fades[1:], strict=False))


def test_a_move_out_and_back_is_seen(spark):
    got = baked(spark, [value(1, "MoveX", 100, 200, 320.0, 400.0), value(2, "MoveX", 200, 300, 400.0, 320.0)], (320, 240, 1, 50, 1000))
    assert len(got[0, "MoveX"]) == 29 and max(r.v_end for r in got[0, "MoveX"]) > 380 and len(got[0, "Rotate"]) == 29


def test_flags_that_come_back(spark):
    got = baked(spark, [value(1, "Additive", 0, 500), value(2, "Additive", 1000, 1500)], (320, 240, 1, 0, 2000))
    spans = [(r.start, r.end) for r in got[0, "Additive"]]
    assert len(spans) == 2 and spans[0][0] == 0 and abs(spans[0][1] - 500) < 34 and abs(spans[1][0] - 1000) < 34 and spans[1][1] < 1534


def test_turn_and_mirror_carry_the_offset(spark):
    turn = baked(spark, [value(1, "Rotate", 0, 0, math.pi / 2, math.pi / 2)], (420, 240, 1, 1000, 2000))
    assert (round(turn[0, "MoveX"][0].v_start, 6), round(turn[0, "MoveY"][0].v_start, 6)) == (320, 340) and len(turn[0, "Rotate"]) == 1
    flip = baked(spark, [value(1, "FlipH", 0, 0)], (420, 240, 1, 1000, 2000))
    assert flip[0, "MoveX"][0].v_start == 220 and len(flip[0, "FlipH"]) == 1
    grey = baked(spark, [value(1, "Colour", 0, 100, c=(9, 8, 7))], (320, 240, 1, 1000, 2000))
    assert grey[0, "Colour"][0].c_start == (9, 8, 7)


def test_triggers_are_copied_or_refused(spark):
    held = [value(1, "Trigger", 0, 1000, trigger="HitSoundClap"), value(2, "Fade", 0, 500, 0.0, 1.0, parent=1.0)]
    got = baked(spark, held, (320, 240, 1, 0, 2000), (420, 300, 1, 0, 2000))
    for run in (0, 1):
        assert got[run, "Trigger"][0].trigger == "HitSoundClap" and [(r.v_start, r.v_end, r.parent) for r in got[run, "Fade"]] == [(0.0, 1.0, 1.0)]
    wrong = [value(1, "Trigger", 0, 1000, trigger="Passing"), value(2, "MoveX", 0, 500, 0.0, 1.0, parent=1.0)]
    with pytest.raises(Exception, match="Passing"):
        baked(spark, wrong, (320, 240, 1, 0, 2000))


def test_nothing_to_bake(spark):
    assert baked(spark, [value(1, "Fade", 0, 1, 0.0, 1.0)], (320, 240, 1, 5, 5))[0, "MoveX"][0].start == 5
    df = spark.createDataFrame([], COLUMNS)
    none = spark.createDataFrame([], "object int, run int, x double, y double, scale double, start double, end double")
    assert bake.bake_runs(df, spark.createDataFrame([(1, 0.0, 0.0)], "object int, px double, py double"), none, 10.0).count() == 0
