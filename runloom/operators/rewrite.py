"""Commands rewritten to fewer or flatter ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, stash
from .folds import fold_sorted
from .intervals import cell, indexed, level, listed, used_levels

TIME_EPSILON, VALUE_EPSILON, SLOPE_EPSILON = 0.01, 1e-4, 1e-4
KEYS = ("object", "kind")


def merge_adjacent(commands: DataFrame, keys: tuple[str, ...] = KEYS, linear_only: bool = False) -> DataFrame:
    """Chains of commands that touch, continue each other's value, ease alike and rise alike become one.

    Where one of two has no length, both must be flat.
    Slopes are compared with the merged command so far, so an object's kind passes through one task, which holds that
    command and one batch.
    """
    rows = commands.select(*keys, F.col("start").cast("double").alias("start"), "seq", F.col("end").cast("double").alias("end"), "easing", F.col("v_start").cast("double").alias("a"), F.col("v_end").cast("double").alias("b"))

    def fits(last: tuple, x: tuple) -> bool:
        (_, s, e, easing, a, b), (_, xs, xe, x_easing, xa, xb) = last, x
        if None in (s, e, easing, a, b, xs, xe, x_easing, xa, xb) or linear_only and x_easing != 0:
            return False
        if abs(e - xs) > TIME_EPSILON or abs(b - xa) > VALUE_EPSILON or easing != x_easing:
            return False
        if e <= s or xe <= xs:
            return abs(b - a) <= VALUE_EPSILON and abs(xb - xa) <= VALUE_EPSILON
        return abs((b - a) / (e - s) - (xb - xa) / (xe - xs)) <= SLOPE_EPSILON

    def run(last: tuple | None, piece: dict[str, list]) -> tuple[list[tuple], tuple]:
        done = []
        for x in zip(*[piece[c] for c in ("seq", "start", "end", "easing", "a", "b")], strict=True):
            if last and fits(last, x):
                last = (*last[:2], x[2], *last[3:5], x[5])
                continue
            if last:
                done.append(last)
            last = x
        return done, last

    output = {"seq": "seq", "start": "double", "end": "double", "easing": "easing", "v_start": "double", "v_end": "double"}
    return fold_sorted(rows, list(keys), ["start", "seq", "end", "easing", "a", "b"], run, lambda last: [last], output)


def drop_covered(commands: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Without the flat commands that another flat command of equal value covers; of equal ones the first stays.

    A command looks for its start among the intervals that are as long as it is, or longer.
    """
    flat = commands.where(F.abs(F.col("v_end") - F.col("v_start")) <= VALUE_EPSILON).select(*keys, "seq", "start", "end", "v_start")
    bits = flat.groupBy(*keys).agg(used_levels().alias("bits"))
    own = level(F.col("start"), F.col("end"))
    inner = flat.join(bits, list(keys)).withColumn("level", F.explode(F.filter(listed(F.col("bits")), lambda k: k >= own))).withColumn("cell", cell(F.col("start"), F.col("level"))).alias("l")
    outer = indexed(flat).alias("r")
    condition = (
        (F.col("l.seq") != F.col("r.seq")) & (F.abs(F.col("l.v_start") - F.col("r.v_start")) <= VALUE_EPSILON)
        & (F.col("r.start") <= F.col("l.start")) & (F.col("r.end") >= F.col("l.end"))
        & ((F.col("r.start") < F.col("l.start")) | (F.col("r.end") > F.col("l.end")) | (F.col("r.seq") < F.col("l.seq")))
    )
    for k in (*keys, "level", "cell"):
        condition = (F.col(f"l.{k}") == F.col(f"r.{k}")) & condition
    gone = inner.join(outer, condition, "left_semi").select(*keys, "seq").distinct()
    return commands.join(gone, [*keys, "seq"], "left_anti")


def extract_loops(sequences: DataFrame, items: str = "items", least: int = 3) -> DataFrame:
    """Adds period and count of the shortest body that makes up the whole array at least ``least`` times, else null.

    ``items`` is an array of structs whose first field is the place in time and whose other fields make up the content;
    the places must be evenly apart by the body's length, within 0.01.
    """
    n = F.size(items)
    fields = [f.name for f in sequences.schema[items].dataType.elementType.fields]
    time, content = fields[0], fields[1:]

    def repeats(p: Column) -> Column:
        span = F.get(items, p)[time] - F.get(items, F.lit(0))[time]
        later = F.sequence(p, F.greatest(n - 1, p))
        same = F.forall(later, lambda j: F.coalesce(
            _same(F.get(items, j), F.get(items, j - p), content) & (F.abs(F.get(items, j)[time] - F.get(items, j - p)[time] - span) <= TIME_EPSILON), F.lit(False)))
        return (n % p == 0) & (n / p >= least) & same

    periods = F.when(n >= least, F.filter(F.sequence(F.lit(1), F.greatest(F.floor(n / least).cast("int"), F.lit(1))), repeats))
    return sequences.withColumn("period", F.array_min(periods)).withColumn("count", (n / F.col("period")).cast("int"))


def loop_periods(rows: DataFrame, keys: list[str], time: str, content: str, least: int = 3) -> DataFrame:
    """W13 for rows instead of arrays: keys, n, period and count as extract_loops() finds them; no key's rows are collected.

    The times a body runs divide the count of every content, which leaves few periods to try; for these each row is joined
    with the one a period before.
    """
    by = Window.partitionBy("k").orderBy("time", "content")
    placed = rows.select(F.struct(*keys).alias("k"), F.col(time).alias("time"), F.col(content).alias("content"))
    placed = cut(placed.withColumn("i", F.row_number().over(by) - 1))
    counts = placed.groupBy("k", "content").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("k").agg(F.sum("c").alias("n"), F.min("c").alias("m"))
    low = F.filter(F.sequence(F.lit(1).cast("long"), F.ceil(F.sqrt("m"))), lambda d: F.col("m") % d == 0)
    times = F.explode(F.array_distinct(F.concat(low, F.transform(low, lambda d: F.floor(F.col("m") / d)))))
    dividing = sizes.select("k", "n", times.alias("times")).where(F.col("times") >= least).join(counts, "k").groupBy("k", "n", "times").agg(F.max(F.col("c") % F.col("times")).alias("rest"))
    tried = cut(dividing.where("rest = 0").select("k", (F.col("n") / F.col("times")).cast("int").alias("period")))
    first = placed.where("i = 0").select("k", F.col("time").alias("t0"))
    spans = tried.join(first, "k").join(placed.select("k", F.col("i").alias("period"), F.col("time").alias("tp")), ["k", "period"]).select("k", "period", (F.col("tp") - F.col("t0")).alias("span"))
    later = placed.join(spans, "k").where("i >= period").select("k", "period", "span", (F.col("i") - F.col("period")).alias("i"), F.col("time").alias("t1"), F.col("content").alias("c1"))
    same = F.col("content").eqNullSafe(F.col("c1")) & (F.abs(F.col("t1") - F.col("time") - F.col("span")) <= TIME_EPSILON)
    broken = later.join(placed, ["k", "i"]).where(~F.coalesce(same, F.lit(False))).select("k", "period").distinct()
    found = tried.join(broken, ["k", "period"], "left_anti").groupBy("k").agg(F.min("period").alias("period"))
    return sizes.join(found, "k", "left").select(*[F.col(f"k.{k}").alias(k) for k in keys], F.col("n").cast("int").alias("n"), "period", (F.col("n") / F.col("period")).cast("int").alias("count"))


def apply_loops(rows: DataFrame, keys: list[str], time: str, content: str, least: int = 3) -> DataFrame:
    """I4, T4: keys, i, time, content, and period and count of the loop that a key's rows make.

    Of a loop only the body stays, timed from the loop's start; rows that make none stay as they are, with null period and count.
    """
    by = Window.partitionBy(*keys).orderBy(time, content)
    placed = rows.select(*keys, time, content, (F.row_number().over(by) - 1).alias("i"), F.first(time).over(by).alias("__t0"))
    found = placed.join(loop_periods(rows, keys, time, content, least).drop("n"), keys)
    body = found.where("period is null or i < period")
    return body.withColumn(time, F.when(F.col("period").isNull(), F.col(time)).otherwise(F.col(time) - F.col("__t0"))).drop("__t0")


def _same(a: Column, b: Column, fields: list[str]) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & a[f].eqNullSafe(b[f])
    return out


def flatten_loops(loops: DataFrame, children: DataFrame, keys: tuple[str, ...] = ("object",)) -> DataFrame:
    """The children of each loop as often as it runs, moved to their iteration's start.

    ``loops``: keys, loop, start, count; ``children``: keys, loop, seq, start, end (both relative to the loop).  A loop runs
    once at least; its cycle is the end of its last child (A18).
    """
    cycle = children.groupBy(*keys, "loop").agg(F.greatest(F.lit(0), F.max("end")).alias("cycle"))
    runs = loops.join(cycle, [*keys, "loop"]).select(*keys, "loop", F.col("start").alias("at"), "cycle", F.explode(F.sequence(F.lit(0), F.greatest(F.col("count") - 1, F.lit(0)))).alias("i"))
    shift = F.col("at") + F.col("i") * F.col("cycle")
    return runs.join(children, [*keys, "loop"]).withColumns({"start": F.col("start") + shift, "end": F.col("end") + shift}).drop("at", "cycle")


def expand_loops(commands: DataFrame, keys: tuple[str, ...] = ("object",)) -> DataFrame:
    """I1 for loops in loops: every command of a loop as often as it and the loops around it run, at its absolute time.

    ``commands``: keys, seq, parent (seq of the loop or trigger around it), depth, kind, start, end and count; other columns
    stay.  Adds iteration, the number of the run (0 for what is in no loop); the parent is then the outermost loop's.
    From the innermost loops outward, a loop's cycle is the latest end in it, and it ends when its last run does.  Each loop then
    knows the counts and cycles of all loops around it, and the number of a run, in the mixed radix of these counts, has the
    number of each loop's run as its digits.  A loop runs once at least.  Triggers and what is in them stay as they are; a
    trigger in a loop is an error, as a loop's runs need fixed times.
    """
    held = [*keys, "parent"]
    within = commands.where("kind != 'Loop'").groupBy(*held).agg(F.max(F.col("end").cast("double")).alias("last"), F.bool_or(F.col("kind") == "Trigger").alias("trigger"))
    last = F.when(F.col("trigger"), F.raise_error(F.lit("a trigger in a loop has no fixed time"))).otherwise(F.col("last")).alias("last")
    loops = commands.where("kind = 'Loop'").select(*keys, "seq", "parent", "depth", F.col("start").cast("double").alias("start"), F.greatest("count", F.lit(1)).cast("long").alias("runs"))
    loops = stash(loops.join(within.withColumnRenamed("parent", "seq"), [*keys, "seq"], "left").select(*loops.columns, last))  # one row a loop: its commands don't travel again
    depths = [r.depth for r in loops.select("depth").distinct().orderBy(F.desc("depth")).collect()]
    inside = ends = None
    for depth in depths:  # as many as loops are nested
        at = loops.where(F.col("depth") == depth)
        if ends is not None:
            inner = ends.groupBy(*held).agg(F.max("end").alias("inner")).withColumnRenamed("parent", "seq")
            at = at.join(inner, [*keys, "seq"], "left").withColumn("last", F.greatest("last", "inner")).drop("inner")
        at = stash(at.withColumn("cycle", F.greatest(F.coalesce("last", F.lit(0.0)), F.lit(0.0))))
        inside = at if inside is None else inside.unionByName(at)
        upto = at.where("last is not null").select(*held, (F.col("start") + (F.col("runs") - 1) * F.col("cycle") + F.col("last")).alias("end"))
        ends = upto if ends is None else ends.unionByName(upto)
    if inside is None:
        return commands.withColumn("iteration", F.lit(0).cast("long"))
    parents = loops.select(*keys, F.col("seq").alias("parent"))
    step = F.struct("start", "runs", "cycle")
    outer = stash(inside.join(parents, held, "left_anti").select(*keys, "seq", F.col("parent").alias("top"), F.array(step).alias("chain")))
    chains = outer
    for _ in depths[1:]:
        around = outer.select(*keys, F.col("seq").alias("parent"), "top", F.col("chain").alias("outer"))
        outer = stash(inside.join(around, held).select(*keys, "seq", "top", F.concat("outer", F.array(step)).alias("chain")))
        chains = chains.unionByName(outer)
    triggers = commands.where("kind = 'Trigger'").select(*keys, F.col("seq").alias("top"))
    untouched = chains.join(triggers, [*keys, "top"], "left_semi").select(*keys, "seq")
    chains = chains.join(untouched, [*keys, "seq"], "left_anti").withColumnRenamed("seq", "parent")
    is_loop = F.col("kind") == "Loop"
    kept = commands.where(~is_loop).unionByName(commands.where(is_loop).join(untouched, [*keys, "seq"], "left_semi").select(commands.columns)).join(chains, held, "left")
    total = F.aggregate(F.coalesce("chain", F.array().cast(chains.schema["chain"].dataType)), F.lit(1).cast("long"), lambda n, x: n * x.runs)
    numbered = kept.withColumn("iteration", F.explode(F.sequence(F.lit(0).cast("long"), total - 1)))
    start = F.struct(F.col("iteration").alias("rest"), F.lit(0.0).alias("shift"))
    digits = F.aggregate(F.reverse("chain"), start, lambda acc, x: F.struct(F.floor(acc.rest / x.runs).alias("rest"), (acc.shift + x.start + F.pmod(acc.rest, x.runs) * x.cycle).alias("shift")))
    shift = F.when(F.col("chain").isNotNull(), digits.shift).otherwise(0.0)
    out = numbered.withColumns({"start": F.col("start") + shift, "end": F.col("end") + shift, "parent": F.coalesce("top", "parent")})
    return out.select(*commands.columns, "iteration")


def pair_axes(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with x_seq and y_seq: the n-th command of one axis with the n-th of the other of equal span and easing.

    What finds no partner has a null, which a writer reports.
    """
    same = [*keys, "start", "end", "easing"]

    def numbered(df: DataFrame, name: str) -> DataFrame:
        return df.select(*same, F.col("seq").alias(name), F.row_number().over(Window.partitionBy(*same).orderBy("seq")).alias("place"))

    return numbered(x, "x_seq").join(numbered(y, "y_seq"), [*same, "place"], "full").select(*same, "x_seq", "y_seq")
