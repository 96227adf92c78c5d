"""Timed commands evaluated at moments.

Commands are rows (object, kind, seq, start, end, easing, v_start, v_end); seq is the order of declaration.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.easing import ease
from ..functions.scalar import EPSILON_DOUBLE, flicker, transform_point
from .intervals import by_crowd, cell, covering, crowded, indexed, listed, used_levels


def progress(t: Column, start: Column, end: Column) -> Column:
    return F.when(end - start <= EPSILON_DOUBLE, F.lit(1.0)).otherwise((t - start) / (end - start))


def evaluate(commands: DataFrame, moments: DataFrame, gap: str = "reference", keys: tuple[str, ...] = ("object", "kind")) -> DataFrame:
    """keys, t and value of each moment (keys, t) of an object's kind that has commands.

    The last declared command with start <= t <= end is active; at its start and end it holds, one of no length gives its
    end value.  Where none is active: before the first declared command its start value, else the end value of the command
    that ends last (``gap="reference"``), or of the one that ended last before t (``gap="preceding"``).
    Moments meet the commands of their keys in one join by key, those of crowded keys through the index of intervals.
    """
    double = {"start": F.col("start").cast("double"), "end": F.col("end").cast("double"), "a": F.col("v_start").cast("double"), "b": F.col("v_end").cast("double")}
    c = commands.select(*keys, "seq", F.struct(double["start"].alias("start"), double["end"].alias("end"), "easing", double["a"].alias("a"), double["b"].alias("b")).alias("row"))
    points = moments.select(*keys, F.col("t").cast("double").alias("t"))
    found = holding(c, points, keys)
    if gap == "preceding":
        found = found.drop("last").join(_ended_before(points.distinct(), c.select(*keys, "seq", F.col("row.end").alias("end"), "row"), keys), [*keys, "t"])
    return found.select(*keys, "t", _value("a", "b").alias("value"))


def _value(a: str, b: str) -> Column:
    """The value at t of what holding() gives, from fields of its rows."""
    at = F.col("t")
    p = progress(at, F.col("active.start"), F.col("active.end"))
    inside = F.col(f"active.{a}") + (F.col(f"active.{b}") - F.col(f"active.{a}")) * ease(F.col("active.easing"), p)
    idle = F.when((at < F.col("first.start")) | F.col("last").isNull(), F.col(f"first.{a}")).otherwise(F.col(f"last.{b}"))
    return F.when(F.col("active").isNotNull(), inside).otherwise(idle)


def _ends() -> list[Column]:
    return [F.min_by("row", "seq").alias("first"), F.max_by("row", F.struct("row.end", "seq")).alias("last")]


def _active() -> Column:
    return F.max_by("row", F.when(F.col("t").between(F.col("row.start"), F.col("row.end")), F.col("seq"))).alias("active")


def holding(commands: DataFrame, points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, t, and the first, the last and the active one of the commands (keys, seq, row with start and end) of each point (keys, t)."""

    def few(c: DataFrame, p: DataFrame) -> DataFrame:
        return p.distinct().join(listed_commands(c, keys), list(keys)).select(*keys, "t", "first", "last", _listed_active())

    return by_crowd(crowded(commands, keys), keys, few, lambda c, p: _holding_many(c, p, keys), commands, points)


def listed_commands(c: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, the commands as an array from the last declared one back, and the first and the last to end; for keys of few commands."""
    rows = c.groupBy(*keys).agg(F.reverse(F.sort_array(F.collect_list(F.struct("seq", "row")))).alias("listed"))
    last = F.array_max(F.transform("listed", lambda x: F.struct(x["row"]["end"].alias("end"), x["seq"].alias("seq"), x["row"].alias("row"))))
    return rows.select(*keys, "listed", F.element_at("listed", -1)["row"].alias("first"), last["row"].alias("last"))


def _listed_active() -> Column:
    t = F.col("t")
    return F.get(F.filter("listed", lambda x: (x["row"]["start"] <= t) & (t <= x["row"]["end"])), F.lit(0))["row"].alias("active")


def _holding_many(commands: DataFrame, points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """First and last commands come from one aggregate over the commands, active ones from the index of intervals."""
    c = commands.withColumns({"start": F.col("row.start"), "end": F.col("row.end")})
    ends = c.groupBy(*keys).agg(*_ends(), used_levels().alias("bits"))
    looked = points.distinct().join(ends, list(keys)).withColumn("level", F.explode_outer(listed(F.col("bits")))).withColumn("cell", cell(F.col("t"), F.col("level"))).drop("bits")
    met = looked.join(indexed(c).select(*keys, "level", "cell", "seq", "row"), [*keys, "level", "cell"], "left")
    return met.groupBy(*keys, "t").agg(F.first("first").alias("first"), F.first("last").alias("last"), _active())


def _ended_before(points: DataFrame, commands: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each point with the row of the command that ended last before it: an as-of lookup in one window of each key."""
    none = F.lit(None)
    both = commands.select(*keys, F.col("end").alias("t"), F.lit(1).alias("__k"), "seq", "row").unionByName(points.select(*keys, "t", F.lit(0).alias("__k"), none.cast(commands.schema["seq"].dataType).alias("seq"), none.cast(commands.schema["row"].dataType).alias("row")))
    by = Window.partitionBy(*keys).orderBy("t", "__k", "seq")
    return both.withColumn("last", F.last("row", ignorenulls=True).over(by)).where("__k = 0").select(*keys, "t", "last")


def flag_at(commands: DataFrame, moments: DataFrame, keys: tuple[str, ...] = ("object", "kind")) -> DataFrame:
    """Whether a flag holds at t: in [start, end), or from start on if the command has no length."""
    c = commands.select(*keys, "start", "end")

    def few(c: DataFrame, p: DataFrame) -> DataFrame:
        own = c.groupBy(*keys).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        return p.distinct().join(own, list(keys)).select(*keys, "t", F.exists("spans", lambda x: holds(x["start"], x["end"], F.col("t"))).alias("flag"))

    return by_crowd(crowded(c, keys), keys, few, lambda c, p: _flags_many(c, p, keys), c, moments.select(*keys, "t"))


def holds(start: Column, end: Column, t: Column) -> Column:
    """Whether a command's flag holds at t."""
    return F.coalesce(F.when(end - start <= EPSILON_DOUBLE, start <= t).otherwise((start <= t) & (t < end)), F.lit(False))


def _flags_many(c: DataFrame, moments: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    short = F.col("end") - F.col("start") <= EPSILON_DOUBLE
    points = moments.distinct()
    always = c.groupBy(*keys).agg(F.min(F.when(short, F.col("start"))).alias("from"))
    on = covering(points, c.where(~short), keys).where("t < end").select(*keys, "t").distinct().withColumn("on", F.lit(True))
    found = points.join(always, list(keys)).join(on, [*keys, "t"], "left")
    return found.select(*keys, "t", (F.coalesce("on", F.lit(False)) | F.coalesce(F.col("from") <= F.col("t"), F.lit(False))).alias("flag"))


def colour(channels: Column) -> Column:
    """A byte; curves that overshoot are held to 0..255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), channels.cast("int")))


#: Values of an object without a command of the kind; a group's x and y default to its pivot
DEFAULTS = {"MoveX": 0.0, "MoveY": 0.0, "Scale": 1.0, "VectorScaleX": 1.0, "VectorScaleY": 1.0, "Rotate": 0.0, "Fade": 1.0}
FLAG_KINDS = ("FlipH", "FlipV", "Additive")


def _colour_rows(commands: DataFrame) -> DataFrame:
    fields = [F.col(f"{side}.{c}").cast("double").alias(f"{c}_{side}") for side in ("c_start", "c_end") for c in "rgb"]
    return commands.where("kind = 'Colour'").select("object", "seq", F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "easing", *fields).alias("row"))


def evaluate_colour(commands: DataFrame, moments: DataFrame, digits: int | None = None) -> DataFrame:
    """Object, t, r, g and b of each moment (object, t) of an object with colour commands (c_start, c_end), as evaluate().

    With ``digits`` values are rounded to these before they are cut to whole numbers, so that 41 stays 41 where it is a sum of fractions.
    """
    found = holding(_colour_rows(commands), moments.select("object", F.col("t").cast("double").alias("t")), ("object",))
    kept = (lambda v: v) if digits is None else (lambda v: F.round(v, digits))
    return found.select("object", "t", *[colour(kept(_value(f"{c}_c_start", f"{c}_c_end"))).alias(c) for c in "rgb"])


def states(commands: DataFrame, moments: DataFrame) -> DataFrame:
    """Every scalar, flag and colour of each moment (object, t), with defaults for what an object has no commands of."""
    at = moments.select("object", F.col("t").cast("double").alias("t"))
    out = by_crowd(crowded(commands, ("object",)), ("object",), _states_few, _states_many, commands, at)
    filled = {k: F.coalesce(k, F.lit(v)) for k, v in DEFAULTS.items() if not k.startswith("Move")} | {k: F.coalesce(k, F.lit(False)) for k in FLAG_KINDS} | {c: F.coalesce(c, F.lit(255)) for c in "rgb"}
    return out.withColumns(filled)


def _states_few(commands: DataFrame, at: DataFrame) -> DataFrame:
    """Moments and commands meet once, by object; the rest is grouped where they met."""
    double = lambda c, name: F.col(c).cast("double").alias(name)
    fields = [double(f"{side}.{c}", f"{c}_{side}") for side in ("c_start", "c_end") for c in "rgb"]
    row = F.struct(double("start", "start"), double("end", "end"), "easing", double("v_start", "a"), double("v_end", "b"), *fields).alias("row")
    c = commands.where(F.col("kind").isin(*DEFAULTS, *FLAG_KINDS, "Colour")).select("object", "kind", "seq", row).repartition("object")
    found = at.repartition("object").distinct().join(listed_commands(c, ("object", "kind")), ["object"], "left")
    on = F.exists("listed", lambda x: holds(x["row"]["start"], x["row"]["end"], F.col("t")))
    found = found.select("object", "t", "kind", "first", "last", _listed_active(), F.when(F.col("kind").isin(*FLAG_KINDS), on).alias("flag"))
    value, own = _value("a", "b"), F.col("kind")
    return found.groupBy("object", "t").agg(
        *[F.max(F.when(own == k, value)).alias(k) for k in DEFAULTS], *[F.max(F.when(own == k, F.col("flag"))).alias(k) for k in FLAG_KINDS],
        *[F.max(F.when(own == "Colour", colour(_value(f"{x}_c_start", f"{x}_c_end")))).alias(x) for x in "rgb"],
    )


CHANNELS = tuple("rgb")


def by_kind(commands: DataFrame) -> DataFrame:
    """object, bounds (starts and ends of all its commands), values (an element for each of DEFAULTS and CHANNELS) and flags (for each of FLAG_KINDS).

    One row an object, for objects of few commands; state_of() takes values and flags.
    """
    double = lambda c, name: F.col(c).cast("double").alias(name)
    is_colour = F.col("kind") == "Colour"
    sides = [F.when(is_colour, F.struct(*[double(f"{side}.{c}", c) for c in CHANNELS])).alias(side) for side in ("c_start", "c_end")]
    ends = [F.when(~is_colour, F.col(c).cast("double")).alias(c) for c in ("v_start", "v_end")]
    row = F.struct("seq", "kind", double("start", "start"), double("end", "end"), "easing", *ends, *sides).alias("row")
    rows = commands.repartition("object").groupBy("object").agg(F.collect_list(row).alias("rows"))
    rows = rows.select("object", F.reverse(F.sort_array("rows")).alias("rows"))

    def own(kind: str, a: Callable[[Column], Column], b: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter("rows", lambda x: x["kind"] == kind), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["easing"].alias("easing"), a(x).alias("a"), b(x).alias("b")))

    def with_ends(listed: Column) -> Column:
        last = F.array_max(F.transform(listed, lambda x, i: F.struct(x["end"].alias("end"), (-i).alias("i"), x["b"].alias("b"))))
        first = F.get(listed, F.size(listed) - 1)
        return F.when(F.size(listed) > 0, F.struct(listed.alias("listed"), first["start"].alias("from"), first["a"].alias("first"), last["b"].alias("last")))

    scalars = [own(k, lambda x: x["v_start"], lambda x: x["v_end"]) for k in DEFAULTS]
    channels = [own("Colour", lambda x, c=c: x["c_start"][c], lambda x, c=c: x["c_end"][c]) for c in CHANNELS]
    none = lambda x: F.lit(None).cast("double")
    flags = F.array(*[own(k, none, none) for k in FLAG_KINDS])
    bounds = F.array_distinct(F.flatten(F.transform("rows", lambda x: F.array(x["start"], x["end"]))))
    return rows.select("object", bounds.alias("bounds"), F.transform(F.array(*scalars, *channels), with_ends).alias("values"), flags.alias("flags"))


def state_of(t: Column) -> Column:
    """t, v and on: the values and the flags of by_kind() at t; null where an object has no command of the kind."""

    def value(k: Column) -> Column:
        active = F.slice(F.filter(k["listed"], lambda x: (x["start"] <= t) & (t <= x["end"])), 1, 1)
        inside = F.transform(active, lambda x: F.struct((x["a"] + (x["b"] - x["a"]) * ease(x["easing"], progress(t, x["start"], x["end"]))).alias("v")))
        idle = F.when(t < k["from"], k["first"]).otherwise(k["last"])
        return F.coalesce(F.get(inside, F.lit(0)), F.struct(idle.alias("v")))["v"]

    on = F.transform("flags", lambda spans: F.exists(spans, lambda x: holds(x["start"], x["end"], t)))
    return F.struct(t.alias("t"), F.transform("values", lambda k: F.when(k.isNotNull(), value(k))).alias("v"), on.alias("on"))


def named_state(x: Column) -> dict[str, Column]:
    """The values of states() in what state_of() gives; MoveX and MoveY are null for an object that doesn't move."""
    found = {k: F.get(x["v"], F.lit(i)) for i, k in enumerate(DEFAULTS)}
    out = {k: v if k.startswith("Move") else F.coalesce(v, F.lit(DEFAULTS[k])) for k, v in found.items()}
    out |= {k: F.coalesce(F.get(x["on"], F.lit(i)), F.lit(False)) for i, k in enumerate(FLAG_KINDS)}
    return out | {c: F.coalesce(colour(F.get(x["v"], F.lit(len(DEFAULTS) + i))), F.lit(255)) for i, c in enumerate(CHANNELS)}


def _states_many(commands: DataFrame, moments: DataFrame) -> DataFrame:
    at = moments.distinct()
    kinds = commands.select("object", "kind").distinct()
    scalars = commands.where(F.col("kind").isin(*DEFAULTS))
    flags = commands.where(F.col("kind").isin(*FLAG_KINDS))
    points = at.join(kinds, "object")
    values = evaluate(scalars, points.where(F.col("kind").isin(*DEFAULTS))).groupBy("object", "t").agg(*[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in DEFAULTS])
    on = flag_at(flags, points.where(F.col("kind").isin(*FLAG_KINDS))).groupBy("object", "t").agg(*[F.max(F.when(F.col("kind") == k, F.col("flag"))).alias(k) for k in FLAG_KINDS])
    return at.join(values, ["object", "t"], "left").join(on, ["object", "t"], "left").join(evaluate_colour(commands, at), ["object", "t"], "left")


def placed(states: DataFrame, base_x: Column, base_y: Column, pivot_x: Column, pivot_y: Column, base_scale: Column) -> DataFrame:
    """X11: where the states of a group put a point of it: x, y, sx, sy, angle and alpha.

    The offset from the pivot is scaled and mirrored, turned, and moved; a group that doesn't move stays at its pivot.
    """
    return states.withColumns(placing(F.col, base_x, base_y, pivot_x, pivot_y, base_scale))


def placing(of: Callable[[str], Column], base_x: Column, base_y: Column, pivot_x: Column, pivot_y: Column, base_scale: Column) -> dict[str, Column]:
    """The columns of placed() from the values that ``of`` names."""
    sx, sy = (of("Scale") * of(f"VectorScale{a}") for a in "XY")
    x = transform_point(base_x, pivot_x, sx, of("FlipH"))
    y = transform_point(base_y, pivot_y, sy, of("FlipV"))
    cos, sin = F.cos(of("Rotate")), F.sin(of("Rotate"))
    return {
        "x": F.coalesce(of("MoveX"), pivot_x) + x * cos - y * sin, "y": F.coalesce(of("MoveY"), pivot_y) + x * sin + y * cos,
        "sx": base_scale * sx, "sy": base_scale * sy, "angle": of("Rotate"), "alpha": flicker(of("Fade")),
    }


def lifetimes(commands: DataFrame, keys: tuple[str, ...] = ("object",)) -> DataFrame:
    """A4: first start and last end of each object's commands; a loop lasts as often as its cycle is repeated.

    ``commands`` may have count (loops, else null) and cycle (the end of a loop's children).  Triggers don't count (F1).
    """
    end = F.when(F.col("count").isNotNull(), F.col("start") + F.col("cycle") * (F.greatest(F.lit(0), F.col("count") - 1) + 1)).otherwise(F.col("end")) if "count" in commands.columns else F.col("end")
    return commands.groupBy(*keys).agg(F.min("start").alias("start"), F.max(end).alias("end"))


def alive(objects: DataFrame, t: Column) -> DataFrame:
    """the objects whose lifetime holds t, ends included."""
    return objects.where((F.col("start") <= t) & (t <= F.col("end")))


def duration(objects: DataFrame) -> DataFrame:
    """A17"""
    return objects.agg(F.coalesce(F.max("end"), F.lit(0)).alias("duration"))
