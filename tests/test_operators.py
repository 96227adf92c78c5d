"""Literal cases of each timeline operator."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.functions import scalar as X
from runloom.functions.easing import ease
from runloom.operators import bake, blocks, bursts, dedupe, fidelity, render, rewrite, runs, timeline
from runloom.plans import sources, tuning


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_runs_match_a_sequential_fold(spark):
    rng = random.Random(3)
    data = [(k, t, rng.choice("aab" if k else "ab") if rng.random() > 0.1 else None) for k in range(4) for t in range(60)]
    df = spark.createDataFrame(data, "k int, t long, c string")
    for width in (1000, 7, 1):
        got = rows(runs.change_runs(df, ["k"], ["t"], "t", "c", F.floor(F.col("t") / width)), "k", "start", "end", "n", "content")
        want = []
        for k in range(4):
            series = [(t, c) for kk, t, c in data if kk == k]
            heads = [i for i, (_, c) in enumerate(series) if i == 0 or series[i - 1][1] != c]
            for a, b in zip(heads, [*heads[1:], None]):
                want.append((k, series[a][0], series[b][0] if b is not None else series[-1][0], (b if b is not None else len(series)) - a, series[a][1]))
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_runs_of_nothing(spark):
    df = spark.createDataFrame([], "k int, t long, c string")
    assert runs.change_runs(df, ["k"], ["t"], "t", "c", F.col("t")).count() == 0


def test_tolerant_runs_compare_with_the_run_not_the_row_before(spark):
    df = spark.createDataFrame([(0, t, float(v)) for t, v in enumerate([0, 4, 8, 12, 16, 20])], "k int, t long, v double")
    got = rows(runs.tolerant_runs(df, ["k"], "t", "v", F.col("v"), 8.0), "start", "end", "n", "value")
    assert got == [(0, 3, 3, 0.0), (3, 5, 3, 12.0)]
    assert runs.fold_tolerant(np.array([0.0, 50.0, 0.0]), np.array([0, 6, 0]), 1.0).tolist() == [True, True, True]


def test_mean_difference(spark):
    df = spark.createDataFrame([([0, 10], [4, 10])], "a array<int>, b array<int>")
    assert df.select(runs.mean_difference(F.col("a"), F.col("b"))).first()[0] == 2.0


@pytest.mark.parametrize("cells, want", [([(0, c, r) for c in (0, 1) for r in (0, 1)], [(0, 0, 1)]), ([(0, 0, 0), (0, 0, 1), (0, 1, 0), (5, 1, 1)], [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 0)])])
def test_blocks(spark, cells, want):
    df = spark.createDataFrame([(1, *c) for c in cells], "batch int, start long, col int, row int")
    assert rows(blocks.roll_up(df, ["batch"], 1), "col", "row", "level") == want


def test_block_levels_take_the_largest_first(spark):
    df = spark.createDataFrame([(1, 0, c, r) for c in range(4) for r in range(4)] + [(1, 0, 4, 0)], "batch int, start long, col int, row int")
    assert rows(blocks.roll_up(df, ["batch"], 2), "col", "row", "level") == [(0, 0, 2), (4, 0, 0)]
    assert blocks.max_level(30, 17, 64, 256 * 256) == 2 and blocks.max_level(2, 2, 64, 1_000_000) == 1 and blocks.max_level(8, 8, 64, 1) == 0


def test_thrash_chains_break_at_gaps_and_at_the_cap(spark):
    data = [("k", float(i), float(i + 1), str(i)) for i in range(7)] + [("k", 10.0, 11.0, "x"), ("k", 11.0, 12.0, "x"), ("k", 12.0, 13.0, "x"), ("k", 13.0, 14.0, "x"), ("k", 20.0, 30.0, "long")]
    df = spark.createDataFrame(data, "k string, start double, end double, content string")
    got = rows(bursts.thrash_segments(df, ["k"], F.col("end") - F.col("start") <= 1, cap=5), "first", "n", "distinct_contents", "promoted")
    assert got == [(0.0, 5, 5, True), (5.0, 2, 2, False), (10.0, 4, 1, False)]


def test_bursts_and_cuts(spark):
    times = [0.0, 300.0, 601.0, 5000.0, 10000.0, 11633.0, 13167.0]
    df = spark.createDataFrame([(1, t) for t in times], "k int, t double")
    starts = bursts.burst_starts(df, ["k"], "t", 300)
    assert [r[1] for r in rows(starts, "k", "t")] == [0.0, 601.0, 5000.0, 10000.0, 11633.0, 13167.0]
    greedy = bursts.spaced(spark.createDataFrame([(1, float(t)) for t in (0, 400, 900, 1000, 1900)], "k int, t double"), ["k"], "t", 1000.0)
    assert greedy.first().cuts == [0.0, 1000.0]


def test_scenes_and_members(spark):
    bounds = spark.createDataFrame([(1, 0.0, 15000.0, [5000.0, 10000.0]), (2, 0.0, 10000.0, [])], "k int, start double, end double, cuts array<double>")
    s = bursts.scenes(bounds, ["k"])
    assert rows(s, "k", "scene", "start", "end") == [(1, 0, 0.0, 5000.0), (1, 1, 5000.0, 10000.0), (1, 2, 10000.0, 15000.0), (2, 0, 0.0, 10000.0)]
    m = spark.createDataFrame([(1, 4000.0, 6000.0)], "k int, start double, end double")
    assert rows(bursts.overlaps(m, s, ["k"]), "scene", "start", "end") == [(0, 4000.0, 5000.0), (1, 5000.0, 6000.0)]


def test_dedupe_keeps_shapes_apart(spark):
    df = spark.createDataFrame([(1, "x", 64, 32), (2, "x", 32, 64), (3, "x", 64, 32), (4, None, 1, 1)], "id int, c string, w int, h int")
    a = dedupe.assign_assets(df, [F.col("w"), F.col("h")], F.col("c"), "id", F.col("w") * F.col("h"))
    assert rows(a, "first_item", "uses") == [(1, 2), (2, 1), (4, 1)]
    assert dedupe.totals(dedupe.new_assets(a, a.where("first_item = 1"))).first().files == 2
    frames = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "b"), (2, 1, "a"), (3, 0, "a"), (3, 1, "b")], "k int, i int, c string")
    assert rows(dedupe.assign_sequences(frames, ["k"], "i", F.col("c")), "k", "uses", "first_k") == [(1, 2, 1), (2, 1, 2), (3, 2, 1)]


def test_fidelity(spark):
    df = spark.createDataFrame([(0, float(i), float(i)) for i in range(9)] + [(1, float(i), float(i + 2)) for i in range(9)], "f int, a double, b double")
    s = {r.f: r for r in fidelity.frame_scores(df, ["f"]).collect()}
    assert s[0].psnr == 100 and abs(s[0].ssim - 1) < 1e-12 and abs(s[1].psnr - 10 * math.log10(255**2 / 4)) < 1e-9
    assert fidelity.mean_scores(fidelity.frame_scores(df, ["f"]), []).first().frames == 2


def test_easing_ends_and_shape(spark):
    df = spark.range(35).select(F.col("id").cast("int").alias("e"), F.explode(F.array(F.lit(0.0), F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(1.0))).alias("t"))
    got = {(r.e, r.t): r.v for r in df.select("e", "t", ease(F.col("e"), F.col("t")).alias("v")).collect()}
    for e in range(35):
        assert abs(got[e, 0.0]) < 1e-9 and abs(got[e, 1.0] - 1) < (1e-2 if e in (26, 27) else 1e-9), e
    assert got[2, 0.5] == 0.25 and got[4, 0.5] == 0.75 and got[6, 0.5] == 0.125 and got[5, 0.25] == 0.125
    assert abs(got[18, 0.5] - 2**-5) < 1e-12 and abs(got[33, 0.5] - 0.765625) < 1e-12 and abs(got[29, 0.5] + 0.0876975) < 1e-9


def commands(spark, data):
    return spark.createDataFrame([("o", "F", *d) for d in data], "object string, kind string, seq int, start double, end double, easing int, v_start double, v_end double")


def test_evaluation_before_between_and_after(spark):
    c = commands(spark, [(0, 1000.0, 2000.0, 0, 0.0, 1.0), (1, 3000.0, 4000.0, 0, 5.0, 7.0), (2, 6000.0, 6000.0, 0, 1.0, 9.0)])
    at = spark.createDataFrame([("o", "F", float(t)) for t in (0, 1500, 2500, 3500, 6000, 9000)], "object string, kind string, t double")
    assert [r[1] for r in rows(timeline.evaluate(c, at), "t", "value")] == [0.0, 0.5, 9.0, 6.0, 9.0, 9.0]
    assert [r[1] for r in rows(timeline.evaluate(c, at, gap="preceding"), "t", "value")][2] == 1.0
    flags = spark.createDataFrame([("o", "A", 0, 0.0, 10.0), ("o", "H", 0, 5.0, 5.0)], "object string, kind string, seq int, start double, end double")
    at = spark.createDataFrame([("o", k, float(t)) for k in "AH" for t in (0, 5, 10)], "object string, kind string, t double")
    assert [r[2] for r in rows(timeline.flag_at(flags, at), "kind", "t", "flag")] == [True, True, False, False, True, True]


def test_lifetimes_count_loops(spark):
    c = spark.createDataFrame([("o", 5.0, 10.0, None, None), ("o", 20.0, 20.0, 3, 100.0)], "object string, start double, end double, count int, cycle double")
    life = timeline.lifetimes(c)
    assert rows(life, "start", "end") == [(5.0, 320.0)] and timeline.alive(life, F.lit(320)).count() == 1 and timeline.alive(life, F.lit(321)).count() == 0
    assert timeline.duration(life.where("false")).first().duration == 0


@pytest.mark.parametrize(
    "second, n",
    [((1, 1000.0, 2000.0, 0, 100.0, 200.0), 1), ((1, 1000.0, 2000.0, 0, 100.0, 300.0), 2), ((1, 1000.0, 2000.0, 0, 150.0, 250.0), 2), ((1, 1500.0, 2500.0, 0, 100.0, 200.0), 2), ((1, 1000.0, 2000.0, 1, 100.0, 200.0), 2)],
)
def test_merge(spark, second, n):
    got = rewrite.merge_adjacent(commands(spark, [(0, 0.0, 1000.0, 0, 0.0, 100.0), second]))
    assert got.count() == n
    if n == 1:
        assert rows(got, "start", "end", "v_start", "v_end") == [(0.0, 2000.0, 0.0, 200.0)]


def test_merge_compares_with_the_merged_slope(spark):
    data, at, value, slope = [], 0.0, 0.0, 1.0
    for k in range(40):
        data.append((k, at, at + 1, 0, value, value + slope))
        at, value, slope = at + 1, value + slope, slope + 0.00006
    got = rewrite.merge_adjacent(commands(spark, data)).count()
    n, acc = 1, data[0]
    for d in data[1:]:
        if abs((acc[5] - acc[4]) / (acc[2] - acc[1]) - (d[5] - d[4])) <= 1e-4:
            acc = (*acc[:2], d[2], 0, acc[4], d[5])
        else:
            n, acc = n + 1, d
    assert got == n and 1 < n < 40


def test_covered(spark):
    base = (0, 0.0, 1000.0, 0, 1.0, 1.0)
    for other, kept in [((1, 100.0, 200.0, 0, 1.0, 1.0), 1), (base[:0] + (1, *base[1:]), 1), ((1, 100.0, 200.0, 0, 2.0, 2.0), 2), ((1, 500.0, 1500.0, 0, 1.0, 1.0), 2), ((1, 100.0, 200.0, 0, 1.0, 2.0), 2)]:
        got = rewrite.drop_covered(commands(spark, [base, other]))
        assert got.count() == kept and (kept == 2 or got.first().seq == 0)


@pytest.mark.parametrize("starts, want", [([0, 500, 1000], (1, 3)), ([0, 500], (None, None)), ([0, 500, 1200], (None, None)), ([0, 250, 500, 750, 1000], (1, 5)), ([], (None, None))])
def test_loops_found(spark, starts, want):
    df = spark.createDataFrame([(1, [(float(s), "x") for s in starts])], "k int, items array<struct<at:double,c:string>>")
    r = rewrite.extract_loops(df).first()
    assert (r.period, r["count"]) == want


def test_loop_bodies(spark):
    df = spark.createDataFrame([(1, [(float(i), "ab"[i % 2]) for i in range(6)])], "k int, items array<struct<at:double,c:string>>")
    r = rewrite.extract_loops(df).first()
    assert (r.period, r["count"]) == (2, 3)


def test_loops_flattened(spark):
    loops = spark.createDataFrame([("o", 0, 60000.0, 3), ("o", 1, 5.0, 0)], "object string, loop int, start double, count int")
    children = spark.createDataFrame([("o", 0, 0, 0.0, 500.0), ("o", 1, 0, 0.0, 500.0)], "object string, loop int, seq int, start double, end double")
    assert rows(rewrite.flatten_loops(loops, children), "start") == [(5.0,), (60000.0,), (60500.0,), (61000.0,)]


def test_axes_paired(spark):
    one = spark.createDataFrame([(1, 0, 0.0, 1.0, 0), (1, 1, 0.0, 1.0, 0)], "k int, seq int, start double, end double, easing int")
    two = spark.createDataFrame([(1, 5, 0.0, 1.0, 0), (1, 6, 2.0, 3.0, 0)], "k int, seq int, start double, end double, easing int")
    got = {(r.x_seq, r.y_seq) for r in rewrite.pair_axes(one, two, ["k"]).collect()}
    assert got == {(0, 5), (1, None), (None, 6)}


def test_bake(spark):
    spans = spark.createDataFrame([(1, 0.0, 100.0)], "k int, start double, end double")
    assert [r[0] for r in rows(bake.sample_times(spans, ["k"], 40.0), "t")] == [0.0, 40.0, 80.0, 100.0]
    s = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0), (1, 2.0, 2.0), (2, 0.0, 5.0), (2, 9.0, 5.0)], "k int, t double, value double")
    assert rows(bake.segments(s, ["k"], 2.0), "k", "start", "end", "v_end") == [(1, 0.0, 1.0, 2.0), (1, 1.0, 2.0, 2.0), (2, 0.0, 9.0, 5.0)]
    f = spark.createDataFrame([(1, float(t), v) for t, v in enumerate([True, True, False, False, True])], "k int, t double, flag boolean")
    assert rows(bake.flag_windows(f, ["k"], 2.0), "start", "end") == [(0.0, 2.0), (4.0, 4.0)]


def test_source_plan(spark):
    m = spark.createDataFrame([("a", 0, 2000.0, 4000.0), ("a", 1, None, None), ("b", 2, 1.0, 2.0)], "path string, seq int, start double, end double")
    media = spark.createDataFrame([("a", 10000.0), ("b", 5000.0)], "path string, duration double")
    plan = sources.plan_sources(m, media, ["path"], "seq")
    assert rows(plan, "path", "first", "members", "union_start", "union_end") == [("a", 0, 2, 0.0, 10000.0), ("b", 2, 1, 1.0, 2.0)]
    assert sources.assign_members(m, plan, ["path"]).count() == 3 and sources.distinct_windows(m).count() == 3


def test_sample_windows(spark):
    s = spark.createDataFrame([(0, 0.0, 8000.0, True), (1, 2000.0, 8000.0, False), (2, 1000.0, 3000.0, False), (3, 0.0, 3001.0, False)], "k int, start double, duration double, is_first boolean")
    got = rows(tuning.sample_windows(s, ["k"]), "k", "fold", "start")
    assert [g[2] for g in got if g[0] == 0 and g[1] == "train"] == [2500.0, 3250.0, 4750.0]
    assert [g for g in got if g[0] == 1 and g[1] == "eval"] == [(1, "eval", 3500.0)]
    assert [g for g in got if g[0] == 2] == [(2, "eval", 1000.0), (2, "train", 1000.0)] and len([g for g in got if g[0] == 3]) == 4


def test_search(spark):
    calls = []

    def probe(candidates):
        calls.extend(candidates)
        return [tuning.Score(30, 30, 100_000, 500) if c == tuning.Parameters() else tuning.Score(25, 25, 200_000, 500) for c in candidates]

    assert tuning.tune(probe) == (tuning.Parameters(64, 0, 32, 8), 10) and len(calls) == len(set(calls)) == 10
    lossy = lambda cs: [tuning.Score(29.5, 29.5, 50_000, 500) if c.colors == 16 else tuning.Score(30, 30, 100_000, 500) for c in cs]
    assert tuning.tune(lossy)[0].colors == 16
    fooled = lambda cs: [tuning.Score(29.8, 20, 50_000, 500) if c.colors == 16 else tuning.Score(30, 30, 100_000, 500) for c in cs]
    assert tuning.tune(fooled)[0].colors == 0
    c = spark.createDataFrame([(1, 0, 30.0, 30.0, 29.0, 10.0, 1), (1, 1, 30.0, 20.0, 29.0, 5.0, 1), (2, 0, 1.0, 1.0, 29.0, 9.0, 0), (2, 1, 2.0, 1.0, 29.0, 9.0, 0)], "g int, ord int, train double, eval double, floor double, bytes double, commands int")
    assert rows(tuning.select_best(c, ["g"]), "g", "passing", "chosen") == [(1, 1, 0), (2, 0, 1)]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert tuple(value(X.tile_bounds(F.lit(2), F.lit(1), 64, 150, 100))) == (128, 64, 22, 36)
    assert value(X.quantize(F.lit(37), 32)) == 36 and value(X.quantize(F.lit(255), 32)) == 252 and value(X.quantize(F.lit(37), 0)) == 37
    assert value(X.frame_path(F.lit("a.b.png"), F.lit(7))) == "a7.b7.png"
    assert value(X.format_number(F.lit(2.0))) == "2" and value(X.format_number(F.lit(0.00001))) == "1E-05" and value(X.format_number(F.lit(0.5))) == "0.5"
    assert value(X.format_time(F.lit(-2.5))) == "-3" and value(X.format_bytes(F.lit(1536))) == "1.5 KB"
    assert value(X.parse_time(F.lit("1:02:03"))) == 3723.0 and value(X.parse_time(F.lit("x"))) is None and tuple(value(X.parse_size(F.lit("640x480")))) == (640, 480)
    assert value(X.flicker(F.lit(1.25))) == 0.25 and value(X.reduction(F.lit(1), F.lit(0))) == 0
    assert value(X.animation_frame(F.lit(95.0), F.lit(0.0), F.lit(10.0), F.lit(4), F.lit(True))) == 1 and value(X.animation_frame(F.lit(95.0), F.lit(0.0), F.lit(10.0), F.lit(4), F.lit(False))) == 3
    assert value(X.luma(F.lit(255), F.lit(0), F.lit(0))) == 76 and tuple(value(X.origin_fraction(F.lit("BottomRight")))) == (1.0, 1.0)
    assert value(X.canvas_mapping(F.lit(1440.0), F.lit(1080.0)))["scale"] == 480 / 1080


def test_render(spark):
    red = bytes([200, 0, 0]) * 4
    data = [(0, 0, 2, 2, bytearray(red), 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, False, 255, 255, 255), (0, 1, 2, 2, bytearray(red), 1.0, 1.0, 1.0, 1.0, 0.0, 0.5, True, 255, 255, 255)]
    df = spark.createDataFrame(data, "frame long, z int, w int, h int, rgb binary, x double, y double, sx double, sy double, angle double, alpha double, additive boolean, r int, g int, b int")
    image = np.frombuffer(render.render_frames(df, 4, 4).first().rgb, np.uint8).reshape(4, 4, 3)
    assert image[1:3, 1:3, 0].tolist() == [[255, 255], [255, 255]] and image.sum() == 4 * 255
    tiles = spark.createDataFrame([(7, c, r, bytearray([10 * r + c] * 3)) for c in (0, 1) for r in (0, 1)], "block long, col int, row int, rgb binary")
    assert list(render.join_tiles(tiles, 1).first().rgb)[::3] == [0, 1, 10, 11]


def test_render_turns_around_the_origin():
    image = np.arange(12, dtype=np.uint8).reshape(2, 2, 3) + 1
    canvas = np.zeros((4, 4, 3), np.uint8)
    render.blit(canvas, image, 2.0, 2.0, 1.0, 1.0, np.pi, 1.0, False, (255, 255, 255), (0.5, 0.5))
    want = np.zeros((4, 4, 3), np.uint8)
    want[1:3, 1:3] = image[::-1, ::-1]
    assert (canvas == want).all()


def test_loop_bodies_of_rows(spark):
    rows = [("a", 10.0 * i, "xy"[i % 2]) for i in range(6)] + [("b", float(i), c) for i, c in enumerate("xyz")] + [("c", 5.0 + i, "x") for i in range(4)]
    out = rewrite.apply_loops(spark.createDataFrame(rows, "k string, t double, c string"), ["k"], "t", "c")
    got = sorted((r.k, r.i, r.t, r.c, r.period, r["count"]) for r in out.collect())
    assert got == [("a", 0, 0.0, "x", 2, 3), ("a", 1, 10.0, "y", 2, 3), ("b", 0, 0.0, "x", None, None), ("b", 1, 1.0, "y", None, None), ("b", 2, 2.0, "z", None, None), ("c", 0, 0.0, "x", 1, 4)]
