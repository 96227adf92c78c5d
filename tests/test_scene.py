"""From commands to pixels by tiles, against a pixel at a time."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from runloom.operators import render

W, H, TILE = 50, 37, 16
OBJECT = "doc int, object int, type string, path string, origin string, x double, y double, z int, frame_count int, frame_delay double, loop_type string"
COMMAND = "object int, seq int, kind string, start double, end double, easing int, v_start double, v_end double, c_start struct<r:int,g:int,b:int>, c_end struct<r:int,g:int,b:int>"
ORIGIN = {"TopLeft": (0, 0), "Centre": (0.5, 0.5), "BottomRight": (1, 1), "CentreLeft": (0, 0.5)}


def draw(objects, commands, images, t):
    """The frame at t: every object over every pixel, by z."""
    frame = np.zeros((H, W, 3), np.uint8)
    zoom = H / 480
    for _, object_, type_, path, origin, x, y, _, count, delay, loop in sorted(objects, key=lambda o: o[7]):
        own = [c for c in commands if c[0] == object_]
        if not own or not min(c[3] for c in own) <= t <= max(c[4] for c in own):
            continue
        of = {}
        for _, _, kind, start, end, _, a, b, ca, _ in own:  # one command a kind
            p = min(1.0, max(0.0, (t - start) / (end - start)))
            of[kind] = ca if kind == "Colour" else start <= t < end if a is None else a + (b - a) * p
        if type_ == "Animation":
            k = int((t - min(c[3] for c in own)) / delay)
            path = path.replace(".", f"{k % count if loop == 'LoopForever' else min(k, count - 1)}.")
        image = images.get(path)
        if image is None:
            continue
        h, w = image.shape[:2]
        sx, sy = ((of.get("Scale", 1.0) * of.get(f"VectorScale{a}", 1.0)) * (-1.0 if of.get(f"Flip{f}") else 1.0) * zoom for a, f in (("X", "H"), ("Y", "V")))
        px, py = (of.get("MoveX", x) + (W / zoom - 640) / 2) * zoom, of.get("MoveY", y) * zoom
        angle, alpha, tint = of.get("Rotate", 0.0), of.get("Fade", 1.0), np.array(of.get("Colour", (255, 255, 255))) / 255
        for i in range(H):
            for j in range(W):
                dx, dy = j + 0.5 - px, i + 0.5 - py
                u = math.floor((dx * math.cos(angle) + dy * math.sin(angle)) / sx + ORIGIN[origin][0] * w)
                v = math.floor((dy * math.cos(angle) - dx * math.sin(angle)) / sy + ORIGIN[origin][1] * h)
                if alpha > 0 and 0 <= u < w and 0 <= v < h:
                    source, under = image[v, u] * tint, frame[i, j].astype(float)
                    frame[i, j] = np.clip(under + source * alpha if of.get("Additive") else under * (1 - alpha) + source * alpha, 0, 255).astype(np.uint8)
    return frame


def test_scene_equals_a_pixel_at_a_time(spark):
    rng = random.Random(12)
    noise = np.random.default_rng(12)
    images = {f"{n}.png": noise.integers(0, 256, (rng.randint(3, 200), rng.randint(3, 200), 3), dtype=np.uint8) for n in ["a", "b", *(f"m{k}" for k in range(3))]}
    objects, commands, seq = [], [], 0
    for k in range(14):
        name = rng.choice(["a.png", "b.png", "m.png", "gone.png"])
        objects.append((k % 2, k, "Animation" if name == "m.png" else "Sprite", name, rng.choice(list(ORIGIN)), rng.uniform(-100, 740), rng.uniform(-50, 530), rng.randint(0, 99) * 20 + k, 3, 25.0, rng.choice(["LoopForever", "LoopOnce"])))
        for kind in rng.sample(["Fade", "MoveX", "MoveY", "Scale", "VectorScaleX", "Rotate", "Colour", "Additive", "FlipH", "FlipV"], rng.randint(0, 6)):
            seq += 1
            a, b = {"MoveX": (0.0, 640.0), "MoveY": (400.0, 0.0), "Fade": (0.2, 0.9), "Rotate": (-3.0, 3.0)}.get(kind, (0.5, 2.5))
            rgb = (rng.randint(0, 255), rng.randint(0, 255), rng.randint(0, 255)) if kind == "Colour" else None
            value = (None, None) if rgb or kind in ("Additive", "FlipH", "FlipV") else (a, b)
            commands.append((k, seq, kind, float(rng.randint(0, 80)), float(rng.randint(90, 200)), 0, *value, rgb, rgb))
    moments = [(d, 10 * d + i, float(t)) for d in (0, 1) for i, t in enumerate((5, 60, 100, 170, 300))]
    placed = render.scene(spark.createDataFrame(objects, OBJECT), spark.createDataFrame(commands, COMMAND), spark.createDataFrame(moments, "doc int, frame long, t double"), W, H)
    assets = spark.createDataFrame([(p, x.shape[1], x.shape[0], bytearray(x.tobytes())) for p, x in images.items()], "path string, w int, h int, rgb binary")
    got = {f: np.zeros((H, W, 3), np.uint8) for _, f, _ in moments}
    tiles = render.draw_tiles(placed, assets, "path", W, H, TILE).collect()
    for r in tiles:
        got[r.frame][r.y : r.y + r.h, r.x : r.x + r.w] = np.frombuffer(r.rgb, np.uint8).reshape(r.h, r.w, 3)
    drawn = 0
    for d, f, t in moments:
        want = draw([o for o in objects if o[0] == d], commands, images, t)
        drawn += want.any()
        assert np.array_equal(got[f], want), (f, np.argwhere((got[f] != want).any(axis=2))[:3])
    assert drawn >= 6 and max(r.w for r in tiles) == TILE
    assert len({(r.frame, r.col, r.row) for r in tiles}) == len(tiles)
    assert render.draw_tiles(placed.where("false"), assets, "path", W, H, TILE).count() == 0
    whole = render.render_frames(render.with_assets(placed, assets, "path").where(F.col("frame") == 1), W, H).first()
    assert np.array_equal(np.frombuffer(whole.rgb, np.uint8).reshape(H, W, 3), got[1])


def test_tiles_are_drawn_row_by_row_not_by_a_pandas_call_for_each(spark):
    """A tile's objects come in batches, and one tile after another goes through a task."""
    columns = "frame long, z long, path string, x double, y double, sx double, sy double, angle double, alpha double, additive boolean, r int, g int, b int, ox double, oy double"
    rng = random.Random(5)
    rows = [(k % 3, k, "a", rng.uniform(-5, 40), rng.uniform(-5, 40), rng.uniform(0.5, 3), rng.uniform(0.5, 3), rng.uniform(-3, 3), rng.uniform(0.1, 1), k % 5 == 0, k % 256, 200, 99, 0.5, 0.5) for k in range(600)]
    placed = spark.createDataFrame(rows, columns)
    image = np.random.default_rng(5).integers(0, 256, (7, 5, 3), dtype=np.uint8)
    assets = spark.createDataFrame([("a", 5, 7, bytearray(image.tobytes()))], "path string, w int, h int, rgb binary")
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "11")
    try:
        tiles = render.draw_tiles(placed, assets, "path", W, H, TILE)
        assert "InPandas" not in tiles._jdf.queryExecution().toString() and "MapInArrow" in tiles._jdf.queryExecution().toString()
        got = {f: np.zeros((H, W, 3), np.uint8) for f in range(3)}
        for r in tiles.collect():
            got[r.frame][r.y : r.y + r.h, r.x : r.x + r.w] = np.frombuffer(r.rgb, np.uint8).reshape(r.h, r.w, 3)
    finally:
        spark.conf.set(key, before)
    for f, frame in got.items():
        want = np.zeros((H, W, 3), np.uint8)
        for _, _, _, x, y, sx, sy, angle, alpha, additive, r, g, b, ox, oy in (o for o in rows if o[0] == f):
            render.blit(want, image, x, y, sx, sy, angle, alpha, additive, (r, g, b), (ox, oy))
        assert np.array_equal(frame, want)
