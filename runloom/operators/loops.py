"""Repeating commands of an object written once, as loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..session import stash
from .intervals import by_crowd, crowds
from .rewrite import TIME_EPSILON, VALUE_EPSILON, drop_covered, merge_adjacent
from .timeline import DEFAULTS

VALUES = ("start", "end", "easing", "v_start", "v_end")
#: A loop takes the place right before its first command
BEFORE = 0.25
#: Commands of a key whose blocks a task may hold; keys with more are crowded
HELD = 100_000
#: Commands that a task looks through at once, where no block is longer, and comparisons that it makes at once
CHUNK, COMPARED = 16_384, 1 << 20


def _alike(a: str, b: str, shift: Column) -> Column:
    """Whether a repeats b, ``shift`` later."""
    near = lambda x, y, eps: F.abs(x - y) <= eps
    at = lambda side, c: F.col(f"{side}.{c}")
    parts = [near(at(a, c), at(b, c) + shift, TIME_EPSILON) for c in ("start", "end")]
    parts += [near(at(a, c), at(b, c), VALUE_EPSILON) for c in ("v_start", "v_end")]
    return F.coalesce(reduce(Column.__and__, parts) & at(a, "easing").eqNullSafe(at(b, "easing")), F.lit(False))


def command_blocks(commands: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """``commands`` with block, the number of the stretch of value commands of one kind that each stands in, and i, its place there."""
    by = Window.partitionBy(*keys).orderBy(*order)
    value = F.col("kind").isin(*DEFAULTS)
    opens = ~value | ~F.col("kind").eqNullSafe(F.lag("kind").over(by))
    blocks = commands.withColumn("block", F.sum(opens.cast("long")).over(by))
    return blocks.withColumn("i", F.row_number().over(Window.partitionBy(*keys, "block").orderBy(*order)) - 1)


def command_periods(blocks: DataFrame, keys: tuple[str, ...], least: int = 3) -> DataFrame:
    """keys, block, period, cycle and count of the shortest body that makes up a whole block ``least`` times or more.

    A loop runs its body again when its last command has ended, so a period is tried only where the command after it starts just then and
    repeats the first; each other command is then compared with its own in the body, as many cycles earlier.
    """
    of = [*keys, "block"]
    value = F.struct(*VALUES)
    rows = stash(blocks.where(F.col("kind").isin(*DEFAULTS)).select(*of, "i", value.alias("x")))
    sizes = rows.groupBy(*of).agg(F.count("*").alias("n"), F.min_by("x", "i").alias("first")).where(F.col("n") >= least)
    upto = F.max("x.end").over(Window.partitionBy(*of).orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    after = rows.withColumn("cycle", upto).join(sizes, of).withColumn("cycle", F.col("cycle") - F.col("first.start"))
    fits = (F.col("i") > 0) & (F.col("n") % F.col("i") == 0) & (F.col("n") >= least * F.col("i")) & (F.col("cycle") > 0)
    tried = stash(after.where(fits & _alike("x", "first", F.col("cycle"))).select(*of, F.col("i").alias("period"), "cycle", "n"))
    later = rows.join(tried, of).where("i >= period").withColumn("turn", F.floor(F.col("i") / F.col("period"))).withColumn("j", F.col("i") % F.col("period"))
    body = rows.select(*of, F.col("i").alias("j"), F.col("x").alias("own"))
    broken = later.join(body, [*of, "j"]).where(~_alike("x", "own", F.col("turn") * F.col("cycle"))).select(*of, "period").distinct()
    found = tried.join(broken, [*of, "period"], "left_anti").groupBy(*of).agg(F.min(F.struct("period", "cycle", "n")).alias("m"))
    return found.select(*of, "m.period", "m.cycle", (F.col("m.n") / F.col("m.period")).cast("int").alias("count"))


def _numbers(x: pa.ChunkedArray) -> np.ndarray:
    """As doubles; what is null equals nothing."""
    return x.cast(pa.float64(), safe=False).to_numpy()


def _codes(x: pa.ChunkedArray) -> np.ndarray:
    """Equal numbers for equal values; null is a value."""
    return x.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


def _openings(rows: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Whether a block opens with each of the rows, which are in order."""
    opens = ~pc.is_in(rows["kind"], value_set=pa.array(DEFAULTS)).to_numpy()
    opens[:1] = True
    for c in (*keys, "kind"):
        codes = _codes(rows[c])
        opens[1:] |= codes[1:] != codes[:-1]
    return opens


def _bodies(rows: pa.Table, opens: np.ndarray, least: int) -> pa.Table:
    """``rows`` (whole blocks) without the turns after a loop's first, and __seq and __at of the loop's first command and, there, __times.

    The same periods are tried by the same comparisons as in command_periods().
    """
    n = len(opens)
    heads = np.flatnonzero(opens)
    sizes = np.diff(heads, append=n)
    first, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
    i = np.arange(n) - first
    start, end, low, high = (_numbers(rows[c]) for c in ("start", "end", "v_start", "v_end"))
    easing = _codes(rows["easing"])

    def alike(a: np.ndarray, b: np.ndarray, shift: np.ndarray) -> np.ndarray:
        near = (np.abs(low[a] - low[b]) <= VALUE_EPSILON) & (np.abs(high[a] - high[b]) <= VALUE_EPSILON) & (easing[a] == easing[b])
        return near & (np.abs(start[a] - (start[b] + shift)) <= TIME_EPSILON) & (np.abs(end[a] - (end[b] + shift)) <= TIME_EPSILON)

    period = np.zeros(n, np.int64)  # by a block's first row
    with np.errstate(invalid="ignore"):
        tried = np.flatnonzero((i > 0) & (size >= least * i))
        tried = tried[size[tried] % i[tried] == 0]
        a = first[tried]
        tried = tried[(np.abs(low[tried] - low[a]) <= VALUE_EPSILON) & (np.abs(high[tried] - high[a]) <= VALUE_EPSILON) & (easing[tried] == easing[a])]
        a = first[tried]
        known = np.where(pc.is_null(rows["end"]).to_numpy(), -np.inf, end)
        cycle = np.maximum.reduceat(known, np.stack([a, tried], 1).ravel())[::2] - start[a] if len(tried) else np.zeros(0)
        fits = (cycle > 0) & alike(tried, a, cycle)
        tried, a, cycle = tried[fits], a[fits], cycle[fits]
        p, left = i[tried], size[tried] - i[tried]
        done = np.zeros(len(tried), bool)
        for cut in np.split(np.arange(len(tried)), np.flatnonzero(np.diff(np.cumsum(left) // COMPARED)) + 1) if len(tried) else ():
            of = np.repeat(cut, left[cut])
            begins = np.cumsum(left[cut]) - left[cut]
            at = np.arange(len(of)) - np.repeat(begins, left[cut]) + p[of]
            done[cut] = np.logical_and.reduceat(alike(a[of] + at, a[of] + at % p[of], at // p[of] * cycle[of]), begins)
    tried, a = tried[done], a[done]
    a, shortest = np.unique(a, return_index=True)
    period[a] = i[tried[shortest]]
    own = period[first]
    stays = (own == 0) | (i < own)
    inside, head = own[stays] > 0, (own[stays] > 0) & (i[stays] == 0)
    origin = pa.array(first[stays], mask=~inside)
    times = pa.array((size[stays] // np.maximum(own[stays], 1)).astype(np.int32), mask=~head)
    return rows.filter(pa.array(stays)).append_column("__seq", rows["seq"].take(origin)).append_column("__at", rows["start"].take(origin)).append_column("__times", times)


def _loops_few(rows: DataFrame, keys: tuple[str, ...], least: int) -> DataFrame:
    """``rows``, of which each key's follow each other in order within a partition, with loops; a task holds a block and a chunk."""
    chunk = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, have, wanted = [], 0, chunk
        for batch in batches:
            pieces.append(batch)
            have += batch.num_rows
            if have < wanted:
                continue
            table = pa.Table.from_batches(pieces).combine_chunks()
            opens = _openings(table, keys)
            open_ = int(np.flatnonzero(opens)[-1])
            if open_:
                yield from _bodies(table.slice(0, open_), opens[:open_], least).to_batches()
            pieces, have = table.slice(open_).to_batches(), table.num_rows - open_
            wanted = max(chunk, 2 * have)
        if have:
            table = pa.Table.from_batches(pieces).combine_chunks()
            yield from _bodies(table, _openings(table, keys), least).to_batches()

    schema = StructType([*rows.schema.fields]).add("__seq", rows.schema["seq"].dataType).add("__at", rows.schema["start"].dataType).add("__times", IntegerType())
    for field in schema.fields:
        field.nullable = True
    return rows.mapInArrow(run, schema)


def _opened(bodies: DataFrame, columns: list[str], keys: tuple[str, ...]) -> DataFrame:
    """``columns`` of the commands of _loops_few(), and a loop before each first one of a body."""
    both, one = F.array(F.lit(True), F.lit(False)), F.array(F.lit(False))
    rows = bodies.withColumn("__opens", F.explode(F.when(F.col("__times").isNotNull(), both).otherwise(one)))
    opens, inside, loop = F.col("__opens"), F.col("__seq").isNotNull(), F.col("__seq") - BEFORE
    shifted = lambda c: F.when(inside, F.col(c) - F.col("__at")).otherwise(F.col(c))
    made = {
        "seq": F.when(opens, loop).otherwise(F.col("seq")), "kind": F.when(opens, "Loop").otherwise(F.col("kind")), "count": F.when(opens, F.col("__times")).otherwise(F.col("count")),
        "parent": F.when(opens, F.col("parent")).otherwise(F.coalesce(loop, "parent")), "depth": F.when(~opens & inside, F.col("depth") + 1).otherwise(F.col("depth")),
        "start": F.when(opens, F.col("start")).otherwise(shifted("start")), "end": F.when(opens, F.col("start")).otherwise(shifted("end")),
    }
    return rows.select(*[(made[c] if c in made else F.col(c) if c in keys else F.when(~opens, F.col(c))).alias(c) for c in columns])


def _loops_many(top: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], least: int) -> DataFrame:
    """``top`` with loops, by joins of each command with its own in the body."""
    blocks = stash(command_blocks(top, keys, order))
    found = blocks.join(command_periods(blocks, keys, least).withColumnRenamed("count", "times"), [*keys, "block"], "left")
    heads = found.where("period is not null and i = 0").select(*keys, "block", F.col("start").alias("at"), (F.col("seq") - BEFORE).alias("loop"))
    body = found.where("period is null or i < period").join(heads, [*keys, "block"], "left")
    inside = F.col("loop").isNotNull()
    moved = body.withColumns({
        "parent": F.coalesce("loop", "parent"), "depth": F.when(inside, F.col("depth") + 1).otherwise(F.col("depth")),
        **{c: F.when(inside, F.col(c) - F.col("at")).otherwise(F.col(c)) for c in ("start", "end")},
    })
    empty = {c: F.lit(None).cast(top.schema[c].dataType) for c in top.columns if c not in (*keys, "seq", "parent", "depth", "start", "end", "kind", "count")}
    opened = found.where("period is not null and i = 0").withColumns({**empty, "seq": F.col("seq") - BEFORE, "end": F.col("start"), "kind": F.lit("Loop"), "count": F.col("times")})
    return moved.select(top.columns).unionByName(opened.select(top.columns))


def extract_command_loops(
    commands: DataFrame, keys: tuple[str, ...] = ("object",), order: tuple[str, ...] = ("seq",), least: int = 3, unpack: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """I4: ``commands`` with parent, depth and count, blocks that repeat as a loop and the commands of its body.

    Commands (keys, seq, kind and VALUES) of one kind that follow each other along ``order`` are a block.  The loop stands before its
    first command, whose times then count from the loop's start.  Commands in loops and triggers, and others than values, stay.
    ``unpack`` makes the commands of shorter rows (keys and ``order``), those of a row in order and before those of later rows; then
    only these rows are exchanged and sorted.  Keys of over HELD commands go by joins, which hold no block.
    """
    unpack = unpack or (lambda rows: rows)
    columns = unpack(commands).columns
    given = {"parent": F.lit(None).cast("double"), "depth": F.lit(1), "count": F.lit(None).cast("int")}
    missing = {c: v for c, v in given.items() if c not in columns}
    seq = F.col("seq").cast("double")
    whole = lambda rows: rows.withColumns(missing | {"seq": seq})
    top = (lambda rows: unpack(rows).where("depth = 1")) if "depth" in columns else unpack
    few = lambda c: _opened(_loops_few(top(c.repartition(*keys).sortWithinPartitions(*keys, *order)).withColumn("seq", seq), keys, least).withColumns(missing), [*columns, *missing], keys)
    many = lambda c: _loops_many(whole(top(c)), keys, order, least)
    out = by_crowd(crowds(top(commands), keys, HELD), keys, few, many, commands)
    return out.unionByName(whole(unpack(commands)).where("depth > 1")) if "depth" in columns else out


def simplify(commands: DataFrame, keys: tuple[str, ...] = ("object",)) -> DataFrame:
    """The three passes in their order: merged, without what is covered, and repeats as loops; others than values stay as they are.

    ``commands``: keys, seq, kind and VALUES; result with parent, depth and count as of extract_command_loops().
    """
    columns = [*keys, "kind", "seq", *VALUES]
    value = F.col("kind").isin(*DEFAULTS)
    merged = drop_covered(merge_adjacent(commands.where(value).select(columns), (*keys, "kind")), (*keys, "kind")).select(columns)
    others = commands.where(~value).select(columns)
    return extract_command_loops(merged, keys, ("kind", "start", "seq")).unionByName(others.withColumn("seq", F.col("seq").cast("double")), allowMissingColumns=True).withColumn("depth", F.coalesce("depth", F.lit(1)))
