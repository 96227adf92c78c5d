"""Frames rendered from commands or placed objects, in whole or by tiles, and tiles joined to blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import animation_frame, canvas_mapping, flicker, frame_path, origin_fraction, to_pixel
from . import timeline
from .folds import fold_sorted
from .intervals import covering


def blit(canvas: np.ndarray, image: np.ndarray, x: float, y: float, sx: float, sy: float, angle: float, alpha: float, additive: bool, tint: tuple[int, int, int], origin: tuple[float, float] = (0.0, 0.0), corner: tuple[int, int] = (0, 0)) -> None:
    """An image scaled, turned around its origin and mixed in; the nearest pixel at each pixel's centre.

    ``origin`` is the fraction of the image's width and height that lies at (x, y); ``corner`` is where in the frame the canvas lies.
    """
    if alpha <= 0 or not sx or not sy:
        return
    h, w = image.shape[:2]
    dx, dy = np.arange(canvas.shape[1]) + 0.5 + corner[0] - x, (np.arange(canvas.shape[0]) + 0.5 + corner[1] - y)[:, None]
    cos, sin = np.cos(angle), np.sin(angle)
    u = np.floor((dx * cos + dy * sin) / sx + origin[0] * w).astype(int)
    v = np.floor((dy * cos - dx * sin) / sy + origin[1] * h).astype(int)
    at = (u >= 0) & (u < w) & (v >= 0) & (v < h)
    if not at.any():
        return
    source = image[v[at], u[at]].astype(float) * (np.array(tint) / 255.0)
    under = canvas[at].astype(float)
    canvas[at] = np.clip(under + source * alpha if additive else under * (1 - alpha) + source * alpha, 0, 255).astype(np.uint8)


def render_frames(placed: DataFrame, width: int, height: int) -> DataFrame:
    """G1: one frame of each group of rows (frame, z, w, h, rgb, x, y, sx, sy, angle, alpha, additive, r, g, b), drawn by z on black.

    Rows may have ox and oy, the fractions of the image that lie at x and y; else these are its top left corner.
    A task draws one frame after another, from rows sorted by frame and z, and holds one canvas and one batch.
    """

    turned = {"ox", "oy"} <= set(placed.columns)

    def draw(canvas: np.ndarray | None, piece: dict[str, list]) -> tuple[list[tuple], np.ndarray]:
        canvas = np.zeros((height, width, 3), np.uint8) if canvas is None else canvas
        for k, rgb in enumerate(piece["rgb"]):
            o = {c: v[k] for c, v in piece.items()}
            image = np.frombuffer(rgb, np.uint8).reshape(o["h"], o["w"], 3)
            blit(canvas, image, o["x"], o["y"], o["sx"], o["sy"], o["angle"], o["alpha"], o["additive"], (o["r"], o["g"], o["b"]), (o["ox"], o["oy"]) if turned else (0.0, 0.0))
        return [], canvas

    columns = ["frame", "z", "w", "h", "rgb", "x", "y", "sx", "sy", "angle", "alpha", "additive", "r", "g", "b", *(("ox", "oy") if turned else ())]
    rows = placed.select(F.col("frame").cast("long").alias("frame"), *[F.col(c).cast("int").alias(c) if c in ("w", "h") else F.col(c) for c in columns[1:]])
    return fold_sorted(rows, ["frame"], ["z"], draw, lambda canvas: [(width, height, canvas.tobytes())], {"width": "w", "height": "h", "rgb": "rgb"})


def _cells(placed: DataFrame, width: int, height: int, tile: int) -> DataFrame:
    """The rows with col and row of each tile of the frame that the box around their turned image touches."""
    ends = {a: [(F.lit(k) - F.col(f"o{a}")) * F.col(size) * F.col(f"s{a}") for k in (0, 1)] for a, size in (("x", "w"), ("y", "h"))}
    cos, sin = F.cos("angle"), F.sin("angle")
    corners = [(F.col("x") + u * cos - v * sin, F.col("y") + u * sin + v * cos) for u in ends["x"] for v in ends["y"]]
    out = placed
    for name, k, size in (("col", 0, width), ("row", 1, height)):
        low, high = (f(*[c[k] for c in corners]) for f in (F.least, F.greatest))
        # a pixel more on each side, for what rounds the other way
        from_, to = (F.floor((v + d) / tile).cast("int") for v, d in ((low, -1), (high, 1)))
        last = (size - 1) // tile
        out = out.withColumn(f"__{name}", F.when((to >= 0) & (from_ <= last), F.sequence(F.greatest(from_, F.lit(0)), F.least(to, F.lit(last)))))
    return out.withColumn("col", F.explode("__col")).withColumn("row", F.explode("__row")).drop("__col", "__row")


def draw_tiles(placed: DataFrame, assets: DataFrame, key: str, width: int, height: int, tile: int) -> DataFrame:
    """Frame, col, row, x, y, w, h and rgb of each tile of a frame that something is drawn on, by z on black.

    ``placed`` as for render_frames() with ox and oy, without images; ``assets``: key, w, h, rgb.  Each object goes to the tiles that its
    turned box touches, so a frame is drawn by many tasks; a task draws one tile after another, from rows sorted by tile and z.
    """
    shown = placed.where("alpha > 0 and sx != 0 and sy != 0").join(assets.select(key, "w", "h"), key)
    dealt = _cells(shown, width, height, tile).join(assets.select(key, "rgb"), key)

    def draw(canvas: np.ndarray | None, piece: dict[str, list]) -> tuple[list[tuple], np.ndarray]:
        x, y = piece["col"][0] * tile, piece["row"][0] * tile
        canvas = np.zeros((min(tile, height - y), min(tile, width - x), 3), np.uint8) if canvas is None else canvas
        of = [piece[c] for c in ("rgb", "w", "h", "x", "y", "sx", "sy", "angle", "alpha", "additive", "r", "g", "b", "ox", "oy")]
        for rgb, w, h, at_x, at_y, sx, sy, angle, alpha, additive, r, g, b, ox, oy in zip(*of, strict=True):
            blit(canvas, np.frombuffer(rgb, np.uint8).reshape(h, w, 3), at_x, at_y, sx, sy, angle, alpha, additive, (r, g, b), (ox, oy), (x, y))
        return [], canvas

    columns = ["frame", "col", "row", "z", "w", "h", "x", "y", "sx", "sy", "angle", "alpha", "additive", "r", "g", "b", "ox", "oy", "rgb"]
    kinds = {"frame": "long", "w": "int", "h": "int"}
    rows = dealt.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in columns])
    drawn = fold_sorted(rows, ["frame", "col", "row"], ["z"], draw, lambda canvas: [(canvas.shape[1], canvas.shape[0], canvas.tobytes())], {"w": "w", "h": "h", "rgb": "rgb"})
    return drawn.select("frame", "col", "row", (F.col("col") * tile).alias("x"), (F.col("row") * tile).alias("y"), "w", "h", "rgb")


def scene(objects: DataFrame, commands: DataFrame, moments: DataFrame, width: int, height: int) -> DataFrame:
    """What is on screen at moments (doc, frame, t), placed on frames of so many pixels: the rows of draw_tiles().

    ``objects``: doc, object (unique), type, path, origin, x, y, z (a number by which they are drawn), frame_count, frame_delay and
    loop_type; ``commands``: of timeline.states(), loops expanded, without triggers.  An object is shown from its first command's
    start to its last one's end; one without commands never is.  An animation shows the image of its frame.
    """
    life = timeline.lifetimes(commands).join(objects.select("doc", "object"), "object")
    alive = covering(moments.select("doc", "frame", F.col("t").cast("double").alias("t")), life, ("doc",)).select("frame", "t", "object", F.col("start").alias("since"))
    state = timeline.states(commands, alive.select("object", "t").distinct())
    o = objects.select("object", "type", "path", "z", "frame_count", "frame_delay", "loop_type", F.col("x").alias("own_x"), F.col("y").alias("own_y"), origin_fraction(F.col("origin")).alias("at"))
    on = alive.join(state, ["object", "t"]).join(o, "object")
    mapping = canvas_mapping(F.lit(width), F.lit(height))
    shown = animation_frame(F.col("t"), F.col("since"), F.col("frame_delay"), F.col("frame_count"), F.col("loop_type") == "LoopForever")
    sign = lambda flag: F.when(F.col(flag), -1.0).otherwise(1.0)
    size = lambda axis: F.col("Scale") * F.col(f"VectorScale{axis}") * sign("FlipH" if axis == "X" else "FlipV") / mapping["scale"]
    return on.select(
        "frame", "object", "z", F.when(F.col("type") == "Animation", frame_path(F.col("path"), shown)).otherwise(F.col("path")).alias("path"),
        to_pixel(F.coalesce("MoveX", "own_x"), mapping["scale"], mapping["off_x"]).alias("x"), to_pixel(F.coalesce("MoveY", "own_y"), mapping["scale"], mapping["off_y"]).alias("y"),
        size("X").alias("sx"), size("Y").alias("sy"), F.col("Rotate").alias("angle"), flicker(F.col("Fade")).alias("alpha"), F.col("Additive").alias("additive"), "r", "g", "b", F.col("at.fx").alias("ox"), F.col("at.fy").alias("oy"),
    )


def with_assets(placed: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """The placed objects with w, h and rgb of their asset; objects without one aren't drawn."""
    return placed.join(assets.select(key, "w", "h", "rgb"), key)


def join_tiles(blocks: DataFrame, tile: int) -> DataFrame:
    """Block, w, h, rgb of blocks from their tiles (block, col, row, rgb), all of ``tile`` by ``tile``."""

    def splice(pdf: pd.DataFrame) -> pd.DataFrame:
        c0, r0 = pdf["col"].min(), pdf["row"].min()
        w, h = (pdf["col"].max() - c0 + 1) * tile, (pdf["row"].max() - r0 + 1) * tile
        out = np.zeros((h, w, 3), np.uint8)
        for t in pdf.itertuples():
            y, x = (t.row - r0) * tile, (t.col - c0) * tile
            out[y : y + tile, x : x + tile] = np.frombuffer(t.rgb, np.uint8).reshape(tile, tile, 3)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "w": [w], "h": [h], "rgb": [out.tobytes()]})

    return blocks.groupBy("block").applyInPandas(splice, "block long, w int, h int, rgb binary")
