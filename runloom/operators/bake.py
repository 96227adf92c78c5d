"""The path of a transformed object baked into short linear commands."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, stash
from . import timeline
from .intervals import FEW, by_crowd, covering, crowded
from .runs import change_runs

#: Values within this are one value; a fade within FADED of 1 isn't written
EQUAL, FADED = 1e-6, 1e-4
#: What a baked run's place, size and orientation depend on; these change together or not at all
POSITION = ("MoveX", "MoveY", "Scale", "VectorScaleX", "VectorScaleY", "Rotate", "FlipH", "FlipV")
#: What can be in a trigger, whose time isn't known
TRIGGERED = ("Fade", "Colour", "Additive")
COLOUR = "struct<r:int,g:int,b:int>"
#: Samples of a run that are windowed together
SAMPLES = 4096


def sample_times(spans: DataFrame, keys: list[str], frame: float) -> DataFrame:
    """keys and t of every frame from start on and of the end itself."""
    return spans.select(*keys, F.explode(_times(frame)).alias("t"))


def _times(frame: float) -> Column:
    steps = F.greatest(F.ceil((F.col("end") - F.col("start")) / frame).cast("int") - 1, F.lit(0))
    inner = F.transform(F.sequence(F.lit(0), steps), lambda k: F.col("start") + k * frame)
    return F.array_distinct(F.concat(inner, F.array(F.col("end").cast("double"))))


def segments(samples: DataFrame, keys: list[str], width: float) -> DataFrame:
    """keys, start, end, v_start and v_end between successive samples (t, value); equal neighbours of a constant collapse.

    I7: a series of one value is a single segment from its first to its last sample.  Series are windowed by blocks of time,
    ``width`` long, and whole by one row a block only.
    """
    rows = samples.select(*keys, "t", "value", F.floor(F.col("t") / width).alias("__b"))
    by = Window.partitionBy(*keys, "__b").orderBy("t")
    at = F.struct("t", "value")
    blocks = rows.groupBy(*keys, "__b").agg(F.min_by(at, "t").alias("head"), F.min("value").alias("low"), F.max("value").alias("high"), F.min("t").alias("first"), F.max("t").alias("last"))
    along, whole = Window.partitionBy(*keys).orderBy("__b"), Window.partitionBy(*keys)
    blocks = blocks.select(*keys, "__b", F.lead("head").over(along).alias("after"), (F.max("high").over(whole) - F.min("low").over(whole) <= EQUAL).alias("constant"), F.min("first").over(whole).alias("first"), F.max("last").over(whole).alias("last"))
    rows = rows.withColumn("next", F.lead(at).over(by)).join(blocks, [*keys, "__b"]).withColumn("next", F.coalesce("next", "after"))
    moving = rows.where("not constant and next is not null").select(*keys, F.col("t").alias("start"), F.col("next.t").alias("end"), F.col("value").alias("v_start"), F.col("next.value").alias("v_end"))
    still = rows.where("constant and t = first").select(*keys, F.col("t").alias("start"), F.col("last").alias("end"), F.col("value").alias("v_start"), F.col("value").alias("v_end"))
    return moving.unionByName(still)


def flag_windows(samples: DataFrame, keys: list[str], width: float) -> DataFrame:
    """[start, end) of every run of true samples (t, flag); one that is still true at the last sample ends there.

    Windowed by blocks of time, ``width`` long.
    """
    return change_runs(samples, keys, ["t"], "t", "flag", F.floor(F.col("t") / width)).where("content").select(*keys, "start", "end")


def _crowded_series(commands: DataFrame, keys: list[str], frame: float) -> DataFrame:
    """Keys of over FEW commands, or over SAMPLES samples."""
    sizes = commands.groupBy(*keys).agg(F.count("*").alias("n"), (F.max("end") - F.min("start")).alias("length"))
    return sizes.where((F.col("n") > FEW) | (F.col("length") > SAMPLES * frame))


def _sampled_spans(c: DataFrame, keys: list[str], frame: float) -> DataFrame:
    """keys, the commands' spans and the times of sample_times() as arrays, for keys of few of both."""
    rows = c.groupBy(*keys).agg(F.collect_list(F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))).alias("spans"), F.min("start").alias("start"), F.max("end").alias("end"))
    return rows.where("start is not null and end is not null").select(*keys, "spans", F.array_sort(_times(frame)).alias("ts"))


def under_way(commands: DataFrame, keys: list[str], frame: float, width: float) -> DataFrame:
    """The number of commands under way (start <= t < end), sampled every ``frame``, as segments().

    A key's samples meet its commands in one row; crowded keys go by the index of intervals and by blocks of time, ``width`` long.
    """
    c = commands.select(*keys, "start", "end")

    def few(c: DataFrame) -> DataFrame:
        under = lambda t: F.size(F.filter("spans", lambda x: (x["start"] <= t) & (t < x["end"]))).cast("double")
        rows = _sampled_spans(c, keys, frame).select(*keys, F.transform("ts", lambda t: F.struct(t.alias("t"), under(t).alias("v"))).alias("values"))
        at = lambda k: F.get("values", k)
        piece = lambda a, b: F.struct(a["t"].alias("start"), b["t"].alias("end"), a["v"].alias("v_start"), b["v"].alias("v_end"))
        n, numbers = F.size("values"), F.transform("values", lambda x: x["v"])
        whole = F.struct(at(F.lit(0))["t"].alias("start"), at(n - 1)["t"].alias("end"), at(F.lit(0))["v"].alias("v_start"), at(F.lit(0))["v"].alias("v_end"))
        still = F.array_max(numbers) - F.array_min(numbers) <= EQUAL
        return rows.select(*keys, F.inline(F.when(still, F.array(whole)).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda k: piece(at(k - 1), at(k))))))

    def many(c: DataFrame) -> DataFrame:
        samples = sample_times(timeline.lifetimes(c, tuple(keys)), keys, frame)
        n = covering(samples, c, tuple(keys)).where("t < end").groupBy(*keys, "t").agg(F.count("*").alias("n"))
        return segments(samples.join(n, [*keys, "t"], "left").select(*keys, "t", F.coalesce("n", F.lit(0)).cast("double").alias("value")), keys, width)

    return by_crowd(_crowded_series(c, keys, frame), tuple(keys), few, many, c)


def flags_under_way(commands: DataFrame, keys: list[str], frame: float, width: float) -> DataFrame:
    """The windows in which a flag holds, sampled every ``frame``, as flag_windows() of timeline.flag_at()."""
    c = commands.select(*keys, "start", "end")

    def few(c: DataFrame) -> DataFrame:
        on = lambda t: F.exists("spans", lambda x: timeline.holds(x["start"], x["end"], t))
        rows = _sampled_spans(c, keys, frame).select(*keys, F.transform("ts", lambda t: F.struct(t.alias("t"), on(t).alias("on"))).alias("values"))
        turns = F.filter("values", lambda x, k: (k == 0) | (x["on"] != F.get("values", k - 1)["on"]))
        rows = rows.select(*keys, turns.alias("turns"), F.element_at("values", -1)["t"].alias("last"))
        spans = F.transform("turns", lambda x, k: F.struct(x["t"].alias("start"), F.coalesce(F.get("turns", k + 1)["t"], "last").alias("end"), x["on"].alias("on")))
        return rows.select(*keys, F.inline(spans)).where("on").drop("on")

    def many(c: DataFrame) -> DataFrame:
        samples = sample_times(timeline.lifetimes(c, tuple(keys)), keys, frame)
        return flag_windows(timeline.flag_at(c, samples, tuple(keys)), keys, width)

    return by_crowd(_crowded_series(c, keys, frame), tuple(keys), few, many, c)


def check_triggers(commands: DataFrame) -> DataFrame:
    """The triggers of groups and what is in them; anything but fades, colours and additive flags in one raises."""
    triggers = commands.where("kind = 'Trigger'")
    of = triggers.select("object", F.col("seq").alias("parent"), F.col("trigger").alias("__name"))
    inside = commands.join(of, ["object", "parent"])
    wrong = F.concat(F.lit("trigger "), F.coalesce("__name", F.lit("")), F.lit(": "), "kind", F.lit(" has no fixed time to bake at"))
    kind = F.when(F.col("kind").isin(*TRIGGERED), F.col("kind")).otherwise(F.raise_error(wrong))
    return triggers.unionByName(inside.withColumn("kind", kind).select(commands.columns))


RUN = ["object", "run"]


def _piece(kind: str, when: Column, a: Column | None = None, b: Column | None = None, c: Column | None = None, d: Column | None = None) -> Column:
    """A command of a kind with values a to b, or colours c to d, or neither; null unless ``when``."""
    of = lambda x, kind: (F.lit(None) if x is None else x).cast(kind)
    return F.when(when, F.struct(F.lit(kind).alias("kind"), of(a, "double").alias("v_start"), of(b, "double").alias("v_end"), of(c, COLOUR).alias("c_start"), of(d, COLOUR).alias("c_end")))


def _states(commands: DataFrame, moments: DataFrame, pivots: DataFrame) -> DataFrame:
    """object, t and the state of groups at moments (object, t) as a struct; a group that doesn't move is at its pivot."""
    found = timeline.states(commands, moments.distinct()).join(pivots, "object")
    rgb = F.struct(*[F.col(c).cast("int").alias(c) for c in "rgb"])
    found = found.withColumns({"MoveX": F.coalesce("MoveX", "px"), "MoveY": F.coalesce("MoveY", "py"), "Colour": rgb})
    return cut(found.select("object", "t", F.struct(*POSITION, "Fade", "Colour", "Additive").alias("state")))


def constancy(commands: DataFrame, pivots: DataFrame, spans: DataFrame) -> DataFrame:
    """object, run, start, end, the state at start, and keeps: which of a group's values are the same from start to end of a run (spans).

    Values are linear between the boundaries of commands, so those at the start, the end and the boundaries between tell.
    """
    bounds = commands.select("object", F.explode(F.array(F.col("start").cast("double"), F.col("end").cast("double"))).alias("t")).distinct()
    within = covering(bounds, spans, ("object",)).where("start < t and t < end").select(*RUN, "t")
    seen = within.unionByName(spans.select(*RUN, F.col("end").alias("t")))
    state = _states(commands, seen.select("object", "t").unionByName(spans.select("object", F.col("start").alias("t"))), pivots)
    first = spans.join(state.select("object", F.col("t").alias("start"), F.col("state").alias("a")), ["object", "start"])
    both = seen.join(state.select("object", "t", F.col("state").alias("b")), ["object", "t"]).join(first, RUN)

    same = lambda k: _same(F.col("a"), F.col("b"), k)
    position = reduce(Column.__and__, map(same, POSITION))
    keeps = [F.bool_and(position).alias("position"), *[F.bool_and(same(k)).alias(k) for k in ("Fade", "Colour", *timeline.FLAG_KINDS)]]
    found = both.groupBy(*RUN, "start", "end").agg(*keeps, F.first("a").alias("state"))
    return cut(found.select(*RUN, "start", "end", "state", F.struct("position", "Fade", "Colour", *timeline.FLAG_KINDS).alias("keeps")))


def _posed(rows: DataFrame, pivots: DataFrame, runs: DataFrame) -> DataFrame:
    """``rows`` (object, run, the state of the group) with x, y, sx, sy, angle, alpha, Colour and flags of the run then."""
    base = runs.select(*RUN, F.col("x").alias("base_x"), F.col("y").alias("base_y"), F.col("scale").alias("base_scale"))
    wide = rows.select("*", "state.*").drop("state").join(pivots, "object").join(base, RUN)
    return cut(timeline.placed(wide, *map(F.col, ("base_x", "base_y", "px", "py", "base_scale"))))


def _kept_pieces(of: Callable[[str], Column], keeps: Callable[[str], Column]) -> Column:
    """A command for each value that a run keeps from start to end, and needs."""
    position, white = keeps("position"), F.struct(*[F.lit(255).alias(c) for c in "rgb"])
    move = [_piece(kind, position, of(c), of(c)) for kind, c in (("MoveX", "x"), ("MoveY", "y"), ("VectorScaleX", "sx"), ("VectorScaleY", "sy"))]
    turn = _piece("Rotate", position & (F.abs(of("angle")) > EQUAL), of("angle"), of("angle"))
    fade = _piece("Fade", keeps("Fade") & (F.abs(of("alpha") - 1) > FADED), of("alpha"), of("alpha"))
    colour = _piece("Colour", keeps("Colour") & (of("Colour") != white), c=of("Colour"), d=of("Colour"))
    flags = [_piece(k, keeps(k) & of(k)) for k in timeline.FLAG_KINDS]
    return F.array_compact(F.array(*move, turn, fade, colour, *flags))


def _changing_pieces(a: Column, b: Column, keeps: Callable[[str], Column]) -> Column:
    """A command from one sample of a run to the next for each value that changes in it."""
    moves = (("MoveX", "x", "position"), ("MoveY", "y", "position"), ("VectorScaleX", "sx", "position"), ("VectorScaleY", "sy", "position"), ("Rotate", "angle", "position"), ("Fade", "alpha", "Fade"))
    made = [_piece(kind, ~keeps(kept), a[c], b[c]) for kind, c, kept in moves]
    made.append(_piece("Colour", ~keeps("Colour"), c=a["Colour"], d=b["Colour"]))
    return F.array_compact(F.array(*made))


def _same(a: Column, b: Column, k: str) -> Column:
    exact = k in timeline.FLAG_KINDS or k == "Colour"
    return a[k] == b[k] if exact else F.abs(a[k] - b[k]) <= EQUAL


def _keeps(k: str) -> Column:
    return F.col(f"keeps.{k}")


def _fixed(posed: DataFrame) -> DataFrame:
    """One command for what a run keeps from start to end, and needs."""
    return posed.select(*RUN, "start", "end", F.inline(_kept_pieces(F.col, _keeps)))


def _linear(samples: DataFrame) -> DataFrame:
    """A piece from each sample of a run to the next, for what changes in it."""
    value = F.struct("x", "y", "sx", "sy", "angle", "alpha", "Colour")
    later = samples.where("k > 0").select(*RUN, (F.col("k") - 1).alias("k"), F.col("t").alias("end"), value.alias("b"))
    pairs = samples.where("k < n").select(*RUN, "k", F.col("t").alias("start"), "keeps", value.alias("a")).join(later, [*RUN, "k"])
    return pairs.select(*RUN, "start", "end", F.inline(_changing_pieces(F.col("a"), F.col("b"), _keeps)))


def _flag_spans(samples: DataFrame, frame: float) -> DataFrame:
    """The spans in which flags hold that a run doesn't keep."""
    each = F.array_compact(F.array(*[F.when(~F.col(f"keeps.{k}"), F.struct(F.lit(k).alias("kind"), F.col(k).alias("flag"))) for k in timeline.FLAG_KINDS]))
    turning = samples.select(*RUN, "t", F.inline(each))
    spans = flag_windows(turning, [*RUN, "kind"], SAMPLES * frame).where("end > start")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    return spans.select(*RUN, "start", "end", "kind", none("v_start", "double"), none("v_end", "double"), none("c_start", COLOUR), none("c_end", COLOUR))


def bake_runs(commands: DataFrame, pivots: DataFrame, runs: DataFrame, frame: float) -> DataFrame:
    """The commands that each run (object, run, x, y, scale, start, end) of a group needs to move with it.

    ``commands``: object, seq, parent, kind, start, end, easing, v_start, v_end, c_start, c_end and trigger, of groups whose loops are
    expanded; ``pivots``: object, px, py.  x and y are the run's centre, scale its size, before the group's script.
    What a run keeps is written once; the rest is sampled every ``frame`` and written as linear pieces, flags as the spans in which
    they hold.  Triggers, with what is in them, are copied to every run.
    Result: object, run, kind, start, end, v_start, v_end, c_start, c_end, and of triggers seq, parent and trigger.
    """
    triggers = stash(commands.where("kind = 'Trigger'").select("object", "seq"))
    if triggers.isEmpty():  # then nothing is looked for in them
        return _with_script(_bake_plain(commands, pivots, runs, frame), commands)
    triggers = stash(check_triggers(commands))
    plain = stash(commands.join(triggers.select("object", "seq"), ["object", "seq"], "left_anti"))
    own = _with_script(_bake_plain(plain, pivots, runs, frame), commands)
    copied = runs.select(*RUN).join(triggers, "object").select(*[F.col(c).cast(own.schema[c].dataType).alias(c) for c in own.columns])
    return own.unionByName(copied)


def _with_script(own: DataFrame, commands: DataFrame) -> DataFrame:
    """With null seq, parent and trigger, which only triggers have."""
    return own.select("*", *[F.lit(None).cast(commands.schema[c].dataType).alias(c) for c in ("seq", "parent", "trigger")])


def _bake_plain(plain: DataFrame, pivots: DataFrame, runs: DataFrame, frame: float) -> DataFrame:
    """bake_runs() without triggers.

    The runs of objects with few commands meet these in one row, and leave it as commands; those of crowded objects, or of over
    SAMPLES samples, go by the index of intervals.
    """
    length = F.col("end") - F.col("start")
    long = runs.where((length > SAMPLES * frame) | (length < 0)).select("object")
    crowd = crowded(plain, ("object",)).unionByName(long).distinct()
    return by_crowd(crowd, ("object",), lambda c, p, r: _bake_few(c, p, r, frame), lambda c, p, r: _bake_many(c, p, r, frame), plain, pivots, runs)


def _bake_few(plain: DataFrame, pivots: DataFrame, runs: DataFrame, frame: float) -> DataFrame:
    spans = runs.select(*RUN, F.col("x").alias("base_x"), F.col("y").alias("base_y"), F.col("scale").alias("base_scale"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    rows = spans.where("start is not null and end is not null").join(pivots, "object").join(timeline.by_kind(plain), "object", "left")

    def state(x: Column) -> Column:
        found = timeline.named_state(x)
        found |= {"MoveX": F.coalesce(found["MoveX"], F.col("px")), "MoveY": F.coalesce(found["MoveY"], F.col("py")), "Colour": F.struct(*[found[c].alias(c) for c in "rgb"])}
        return F.struct(x["t"].alias("t"), *[found[k].alias(k) for k in (*POSITION, "Fade", "Colour", "Additive")])

    def pose(x: Column) -> Column:
        placed = timeline.placing(lambda k: x[k], *map(F.col, ("base_x", "base_y", "px", "py", "base_scale")))
        return F.struct(x["t"].alias("t"), *[c.alias(k) for k, c in placed.items()], *[x[k].alias(k) for k in ("Colour", *timeline.FLAG_KINDS)])

    states = lambda ts: F.transform(F.transform(ts, timeline.state_of), state)
    inner = F.filter("bounds", lambda t: (F.col("start") < t) & (t < F.col("end")))
    rows = rows.withColumn("seen", states(F.concat(F.array("start", "end"), F.coalesce(inner, F.array().cast("array<double>")))))
    first = F.get("seen", F.lit(0))
    all_of = lambda same: F.forall("seen", lambda b: same(F.col("first"), b))
    # what is made once for a run goes through inline(), as Spark would write it out in each of a lambda's turns otherwise
    rows = rows.select(*RUN, "start", "end", "base_x", "base_y", "base_scale", "px", "py", "values", "flags", "seen", F.inline(F.array(F.struct(first.alias("first")))))
    kept = [all_of(lambda a, b: reduce(Column.__and__, [_same(a, b, k) for k in POSITION])).alias("position"), *[all_of(partial(_same, k=k)).alias(k) for k in ("Fade", "Colour", *timeline.FLAG_KINDS)]]
    rows = rows.select(*RUN, "start", "end", "base_x", "base_y", "base_scale", "px", "py", "values", "flags", F.inline(F.array(F.struct(pose(F.col("first")).alias("at"), F.struct(*kept).alias("keeps")))))
    n = F.greatest(F.ceil((F.col("end") - F.col("start")) / frame).cast("int"), F.lit(1))
    ts = F.transform(F.sequence(F.lit(0), n), lambda k: F.when(k == n, F.col("end")).otherwise(F.col("start") + k * frame))
    changing = ~reduce(Column.__and__, map(_keeps, ("position", "Fade", "Colour", "Additive")))
    rows = rows.withColumn("samples", F.when(changing, F.transform(states(ts), pose)))

    last = F.get("samples", F.size("samples") - 1)
    spanned = lambda at, p: F.struct(at[0].alias("start"), at[1].alias("end"), p["kind"].alias("kind"), *[p[c].alias(c) for c in ("v_start", "v_end", "c_start", "c_end")])
    still = F.transform(_kept_pieces(lambda k: F.col(f"at.{k}"), _keeps), lambda p: spanned((F.col("start"), F.col("end")), p))
    pairs = F.arrays_zip(F.slice("samples", F.lit(1), F.size("samples") - 1).alias("a"), F.slice("samples", F.lit(2), F.size("samples") - 1).alias("b"))
    moving = F.flatten(F.transform(pairs, lambda x: F.transform(_changing_pieces(x["a"], x["b"], _keeps), lambda p: spanned((x["a"]["t"], x["b"]["t"]), p))))

    def flagged(k: str) -> Column:
        before = lambda i: F.get("samples", i - 1)[k]
        times = lambda when: F.transform(F.filter("samples", when), lambda x: x["t"])
        opens = times(lambda x, i: x[k] & ((i == 0) | ~before(i)))
        ends = F.concat(times(lambda x, i: ~x[k] & (i > 0) & before(i)), F.when(last[k], F.array(last["t"])).otherwise(F.array().cast("array<double>")))
        spans = F.filter(F.arrays_zip(opens.alias("start"), ends.alias("end")), lambda x: x["end"] > x["start"])
        return F.when(~_keeps(k), F.transform(spans, lambda x: spanned((x["start"], x["end"]), _piece(k, F.lit(True)))))

    own = [F.coalesce(x, F.array().cast(f"array<struct<start:double,end:double,kind:string,v_start:double,v_end:double,c_start:{COLOUR},c_end:{COLOUR}>>")) for x in (moving, *map(flagged, timeline.FLAG_KINDS))]
    return rows.select(*RUN, F.inline(F.concat(still, *own)))


def _bake_many(plain: DataFrame, pivots: DataFrame, runs: DataFrame, frame: float) -> DataFrame:
    plain = cut(plain)
    spans = runs.select(*RUN, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    kept = constancy(plain, pivots, spans)
    fixed = _fixed(_posed(kept, pivots, runs))

    changing = kept.where(~reduce(Column.__and__, map(_keeps, ("position", "Fade", "Colour", "Additive")))).drop("state")
    steps = F.greatest(F.ceil((F.col("end") - F.col("start")) / frame).cast("int"), F.lit(1))
    numbered = changing.withColumn("n", steps).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = numbered.withColumn("t", F.when(F.col("k") == F.col("n"), F.col("end")).otherwise(F.col("start") + F.col("k") * frame))
    samples = _posed(at.join(_states(plain, at.select("object", "t"), pivots), ["object", "t"]), pivots, runs)
    return fixed.unionByName(_linear(samples)).unionByName(_flag_spans(samples, frame))


def place(runs: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Every run at every target of its source: base moved to the target's origin and scaled."""
    return runs.join(targets, keys).withColumns({"px": F.col("x") * F.col("scale") + F.col("dx"), "py": F.col("y") * F.col("scale") + F.col("dy")})
