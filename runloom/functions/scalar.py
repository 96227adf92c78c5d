"""Scalar expressions on tiles, coordinates, values and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON_DOUBLE, EPSILON_FLOAT = 1e-9, 1e-6
# Fixed names, in ordinal order.
LAYERS = ("Background", "Fail", "Pass", "Foreground", "Overlay")
ORIGINS = {"TopLeft": (0.0, 0.0), "TopCentre": (0.5, 0.0), "TopRight": (1.0, 0.0), "CentreLeft": (0.0, 0.5), "Centre": (0.5, 0.5), "CentreRight": (1.0, 0.5), "BottomLeft": (0.0, 1.0), "BottomCentre": (0.5, 1.0), "BottomRight": (1.0, 1.0), "Custom": (0.0, 0.0)}
UNITS = ("B", "KB", "MB", "GB", "TB")


def near(a: Column, b: Column, eps: float = EPSILON_DOUBLE) -> Column:
    """F8: equal up to ``eps``.  Not transitive, so no key of a group or join."""
    return F.abs(a - b) <= eps


def tile_bounds(col: Column, row: Column, tile: int, width: int, height: int) -> Column:
    """Place and size of a grid tile; edge tiles are cropped."""
    x, y = col * tile, row * tile
    return F.struct(x.alias("x"), y.alias("y"), F.least(F.lit(tile), width - x).alias("w"), F.least(F.lit(tile), height - y).alias("h"))


def is_full_tile(bounds: Column, tile: int) -> Column:
    """P2"""
    return (bounds["w"] == tile) & (bounds["h"] == tile)


def quantize(value: Column, levels: int) -> Column:
    """A byte value at the middle of its step; no change without 0 < levels < 256."""
    if levels <= 0 or levels >= 256:
        return value.cast("int")
    step = 256 // levels
    return F.least(F.lit(255), (F.floor(value / step) * step + step // 2)).cast("int")


def content_hash(*content: Column) -> Column:
    """P5: a digest for equality of contents."""
    return F.sha2(F.concat_ws("\x1f", *[c.cast("string") for c in content]), 256)


def canvas_mapping(width: Column, height: Column) -> Column:
    """Scale and offsets from pixels to a 640 by 480 canvas, by height."""
    return F.struct((480.0 / height).alias("scale"), ((width / (height / 480.0) - 640.0) / 2).alias("off_x"), F.lit(0.0).alias("off_y"))


def centred_mapping(width: Column, height: Column, cx: Column, cy: Column) -> Column:
    """The mapping that covers the canvas and puts the middle at (cx, cy)."""
    scale = F.greatest(640.0 / width, 480.0 / height)
    return F.struct(scale.alias("scale"), (width / 2 * scale - cx).alias("off_x"), (height / 2 * scale - cy).alias("off_y"))


def to_canvas(pixel: Column, scale: Column, offset: Column) -> Column:
    return pixel * scale - offset


def to_pixel(canvas: Column, scale: Column, offset: Column) -> Column:
    return (canvas + offset) / scale


def frame_path(base: Column, i: Column) -> Column:
    """The path of an animation's frame; every dot gets the number."""
    return F.replace(base, F.lit("."), F.concat(i.cast("string"), F.lit(".")))


def luma(r: Column, g: Column, b: Column) -> Column:
    """P8"""
    return (0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def parse_size(text: Column) -> Column:
    """``WxH``; null if it isn't one."""
    return F.when(text.rlike(r"^\d+x\d+$"), F.struct(F.split(text, "x")[0].cast("int").alias("w"), F.split(text, "x")[1].cast("int").alias("h")))


def parse_time(text: Column) -> Column:
    """Seconds, or [HH:]MM:SS; null if it isn't one."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p)
    return F.when(F.size(parts) <= 3, total)


def format_bytes(n: Column) -> Column:
    """P10: with the largest unit of 1024 under it, two places at most."""
    k = F.least(F.floor(F.log(1024.0, F.greatest(n, F.lit(1)))), F.lit(len(UNITS) - 1)).cast("int")
    value = F.round(n / F.pow(F.lit(1024.0), k), 2)
    return F.concat(format_number(value), F.lit(" "), F.get(F.array(*[F.lit(u) for u in UNITS]), k))


def format_number(x: Column) -> Column:
    """The shortest decimal text, without ``.0``."""
    s = x.cast("string")
    s = F.regexp_replace(F.regexp_replace(s, r"\.0$", ""), r"\.0E", "E")
    return F.regexp_replace(F.regexp_replace(s, r"E(\d)", "E+$1"), r"E([+-])(\d)$", "E$10$2")


def format_time(ms: Column) -> Column:
    """Whole milliseconds, halves away from zero."""
    return F.round(ms).cast("long").cast("string")


def reduction(part: Column, whole: Column) -> Column:
    """1 - part / whole; 0 of nothing."""
    return F.coalesce(1 - part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def origin_fraction(origin: Column) -> Column:
    """Where in an object its position is."""
    table = F.create_map(*[x for k, (fx, fy) in ORIGINS.items() for x in (F.lit(k), F.struct(F.lit(fx).alias("fx"), F.lit(fy).alias("fy")))])
    return table[origin]


def layer_ordinal(layer: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LAYERS]), layer) - 1


def source_key(path: Column, fps: Column, source_fps: Column) -> Column:
    """What two uses of one source share."""
    return F.struct(F.lower(path).alias("path"), F.coalesce(fps, source_fps).alias("fps"))


def flicker(alpha: Column) -> Column:
    """X4"""
    return F.when(alpha > 1, alpha % 1).otherwise(alpha)


def lerp(a: Column, b: Column, t: Column) -> Column:
    """X5, in single precision as values are."""
    a, b, t = (c.cast("float") for c in (a, b, t))
    return (a + (b - a) * t).cast("float")


def animation_frame(t: Column, start: Column, delay: Column, frames: Column, forever: Column) -> Column:
    """The number of the frame shown at t."""
    k = ((t - start) / delay).cast("long")
    return F.when(forever, F.pmod(k, frames)).otherwise(F.greatest(F.lit(0), F.least(k, frames - 1)))


def transform_point(base: Column, pivot: Column, scale: Column, flip: Column) -> Column:
    """X11, one axis before rotation: offset from the pivot, scaled and mirrored."""
    return (base - pivot) * scale * F.when(flip, -1.0).otherwise(1.0)
