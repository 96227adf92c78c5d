"""Operator 13, repair of the turn structure of conversations by a dynamic programme with checkpoints at square-root distance.

The turns of a conversation have to become an optional system turn and then pairs of user and assistant.  A turn is kept (cost 0),
given the role that fits (2) or deleted (3); an empty turn can be inserted anywhere (2).  Blank and duplicate turns must be deleted, a
truncated turn that stays costs 1.  Of the cheapest edits, those whose initials D, I, K, R come first in ASCII are made.

1. A conversation of n turns is cut into blocks of about sqrt(n).  Each block, on its own, gives the least cost between any two
   of the four states before and after it.
2. From the last block backward, a vector of costs by state is worked out and stored at the end of each block only.
3. Each block works its inner vectors out again from the one at its end, and walks forward from every state; the states that are
   met are then chained from the first block on, so the blocks of one long conversation are walked by many tasks.

No task holds more than a block's turns, or a vector a block, and the texts are only read in order, never gathered.

Turns go by turn (nulls first), then role and text; equal rows are alike.  A null role or text stands for one space, so it's no role that
can be kept, and blank.  An empty role has no initial and can't be kept either.  Rows with a null conv_id are one conversation.
Texts of any length are read whole.  An empty table gives none.  Other columns of the input are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash

WHITE = r"[\x20\x09-\x0D]"
#: States: nothing yet, after system, after user, after assistant; the role that comes next and the state behind it
NEXT = (2, 2, 3, 2)
INSERTED = ("user", "user", "assistant", "user")
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
STATES = range(4)
FAR = 1 << 60
RELABEL, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
OPEN_END = (0, FAR, FAR, 0)
_NONE = (None,) * 4


def _settle(costs: list[int]) -> list[int]:
    """Costs by state once turns may be inserted first; two in a row at most are of use."""
    for _ in range(2):
        costs = [min(costs[q], INSERT + costs[NEXT[q]]) for q in STATES]
    return costs


def _before(initial: str, stays: bool, truncated: bool, after: list[int]) -> list[int]:
    """Costs by state before a turn, from those after it, nothing inserted."""
    out = [DELETE + after[q] for q in STATES]
    if stays:
        extra = TRUNCATED if truncated else 0
        kept = KEPT.get(initial, _NONE)
        for q in STATES:
            out[q] = min(out[q], RELABEL + extra + after[NEXT[q]])
            if kept[q] is not None:
                out[q] = min(out[q], extra + after[kept[q]])
    return out


def end_costs() -> list[int]:
    """Costs by state behind the last turn."""
    return _settle(list(OPEN_END))


def costs_before(turns: list[tuple[str, bool, bool]], after: list[int]) -> list[list[int]]:
    """Costs by state before each turn (initial, may stay, truncated) and behind the last."""
    out = [after]
    for turn in reversed(turns):
        out.append(_settle(_before(*turn, out[-1])))
    return out[::-1]


def walk(turns: list[tuple[str, bool, bool]], costs: list[list[int]], state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least initials of the cheapest edits from a state on, and the state behind them."""
    out = []
    for k, (initial, stays, truncated) in enumerate(turns):
        extra = TRUNCATED if truncated else 0
        while True:
            now, after = costs[k][state], costs[k + 1]
            if now >= FAR:
                return "", state  # no way on from here; never met
            kept = KEPT.get(initial, _NONE)[state]
            if DELETE + after[state] == now:
                out.append("D")
                break
            if INSERT + costs[k][NEXT[state]] == now:
                out.append("I")
                state = NEXT[state]
                continue
            if stays and kept is not None and extra + after[kept] == now:
                out.append("K")
                state = kept
            else:
                out.append("R")
                state = NEXT[state]
            break
    while last and costs[-1][state]:
        out.append("I")
        state = NEXT[state]
    return "".join(out), state


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that follow each other with equal first columns; a group is a block's, so it is small."""
    have, rows = None, []
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if values[:keys] != have:
                if rows:
                    yield have, rows
                have, rows = values[:keys], []
            rows.append(dict(zip(names[keys:], values[keys:], strict=True)))
    if rows:
        yield have, rows


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def conversation(conv_id: str | Column = "conv_id") -> Column:
    """A text for each conv_id, null among them."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def faults(rows: DataFrame) -> DataFrame:
    """The turns in order, with cid, pos, n, initial, fault (blank, duplicate, truncated or null), illegal, m (blocks) and block."""
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), conversation().alias("cid"))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    by = Window.partitionBy("cid").orderBy(*order)
    again = F.row_number().over(Window.partitionBy("cid", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    end = F.substring(F.regexp_replace("text", f"{WHITE}+$", ""), -1, 1)
    fault = F.when(end == "", "blank").when(again > 1, "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    seen = turns.withColumn("initial", F.substring("role", 1, 1)).withColumn("fault", fault)
    pair = F.concat(F.lag("initial").over(by), "initial")
    seen = seen.withColumn("pos", F.row_number().over(by) - 1).withColumn("illegal", F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)))
    sizes = turns.groupBy("cid").agg(F.count("*").alias("n")).withColumn("width", F.ceil(F.sqrt("n")))
    return seen.join(sizes, "cid").withColumn("block", F.floor(F.col("pos") / F.col("width"))).withColumn("m", F.ceil(F.col("n") / F.col("width"))).drop("width")


def _coded(turns: DataFrame) -> DataFrame:
    stays = F.coalesce(~F.col("fault").isin("blank", "duplicate"), F.lit(True))
    return turns.select("cid", "block", "m", "pos", "initial", stays.alias("stays"), F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("truncated"))


def block_costs(turns: DataFrame) -> DataFrame:
    """cid, block, m and costs: by state before the block (outer) and behind it the least cost, as 16 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (cid, block, m), rows in _groups(batches, 3):
            steps = [(r["initial"], r["stays"], r["truncated"]) for r in rows]
            ends = [costs_before(steps, [0 if q == k else FAR for q in STATES])[0] for k in STATES]
            out.append((cid, block, m, [ends[k][q] for q in STATES for k in STATES]))
            if len(out) == 1000:
                yield _batch(out, ["cid", "block", "m", "costs"], [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())])
                out = []
        yield _batch(out, ["cid", "block", "m", "costs"], [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())])

    return _coded(turns).repartition("cid", "block").sortWithinPartitions("cid", "block", "pos").mapInArrow(run, "cid string, block long, m long, costs array<long>")


def checkpoints(blocks: DataFrame) -> DataFrame:
    """cid, block, after (costs by state behind the block) and least (of the whole conversation, at its first block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = end_costs()
        for batch in batches:
            out = []
            for cid, block, m, costs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block == m - 1:
                    after = end_costs()
                before = [min(min(FAR, costs[4 * q + k] + after[k]) for k in STATES) for q in STATES]
                out.append((cid, block, after, None if block else before[0]))
                after = before
            yield _batch(out, ["cid", "block", "after", "least"], [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64()])

    return blocks.repartition("cid").sortWithinPartitions("cid", F.col("block").desc()).mapInArrow(run, "cid string, block long, after array<long>, least long")


def _walks(turns: DataFrame, ends: DataFrame) -> DataFrame:
    """cid, block, and for each state before the block the edits and the state behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["cid", "block", "edits", "to"], [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
        out = []
        for (cid, block, m), rows in _groups(batches, 3):
            steps = [(r["initial"], r["stays"], r["truncated"]) for r in rows]
            costs = costs_before(steps, rows[0]["after"])
            ways = [walk(steps, costs, q, block == m - 1) for q in STATES]
            out.append((cid, block, [w for w, _ in ways], [q for _, q in ways]))
            if len(out) == 1000:
                yield _batch(out, names, kinds)
                out = []
        yield _batch(out, names, kinds)

    joined = _coded(turns).join(ends.select("cid", "block", "after"), ["cid", "block"]).select("cid", "block", "m", "pos", "initial", "stays", "truncated", "after")
    return joined.repartition("cid", "block").sortWithinPartitions("cid", "block", "pos").mapInArrow(run, "cid string, block long, edits array<string>, to array<long>")


def _chained(walks: DataFrame) -> DataFrame:
    """cid, block, start (state before it) and edits, along the one way from the first block on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = 0
        for batch in batches:
            out = []
            for cid, block, edits, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = state if block else 0
                out.append((cid, block, state, edits[state]))
                state = to[state]
            yield _batch(out, ["cid", "block", "start", "edits"], [pa.string(), pa.int64(), pa.int64(), pa.string()])

    return walks.repartition("cid").sortWithinPartitions("cid", "block").mapInArrow(run, "cid string, block long, start long, edits string")


def repairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of faults(): cid, block, start and edits of every block; cid and cost of every conversation."""
    ends = stash(checkpoints(block_costs(turns)))
    return stash(_chained(_walks(turns, ends))), ends.where("block = 0").select("cid", F.col("least").alias("cost"))


def repaired_turns(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """cid, pos, k, role, text of the turns as repaired, in the order of pos and k; an inserted turn stands before pos or behind the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["cid", "pos", "k", "role", "text"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        at, left, state = None, iter(""), 0
        for batch in batches:
            out = []
            for cid, block, pos, role, text, start, letters, final in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cid, block) != at:
                    at, left, state = (cid, block), iter(letters), start
                k = 0
                for letter in left:
                    if letter != "D":
                        new = KEPT[role[:1]][state] if letter == "K" else NEXT[state]
                        out.append((cid, pos, k, role if letter == "K" else INSERTED[state], "" if letter == "I" else text))
                        state = new
                    k += 1
                    if letter != "I":
                        break
                if final:
                    for _ in left:
                        out.append((cid, pos, k, INSERTED[state], ""))
                        state = NEXT[state]
                        k += 1
            yield _batch(out, names, kinds)

    rows = turns.join(edits, ["cid", "block"]).select("cid", "block", "pos", "role", "text", "start", "edits", (F.col("pos") == F.col("n") - 1).alias("final"))
    return rows.repartition("cid", "block").sortWithinPartitions("cid", "block", "pos").mapInArrow(run, "cid string, pos long, k long, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """cid and sha256 of its turns as role:text, joined by line breaks; fed turn by turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string()]
        at, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for cid, _, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cid != at:
                    if at is not None:
                        out.append((at, state.hexdigest()))
                    at, state = cid, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    state.update(f"\n{role}:{text}".encode())
            yield _batch(out, ["cid", "sha256"], kinds)
        if at is not None:
            yield _batch([(at, state.hexdigest())], ["cid", "sha256"], kinds)

    return repaired.repartition("cid").sortWithinPartitions("cid", "pos", "k").mapInArrow(run, "cid string, sha256 string")


def structure(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation that has turns."""
    turns = stash(faults(rows))
    edits, costs = repairs(turns)
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    seen = turns.groupBy("cid").agg(F.first("conv_id").alias("conv_id"), gaps, count("blank"), count("duplicate"), count("truncated"), F.count_if("illegal").alias("illegal"))
    audit = edits.groupBy("cid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "edits"))), lambda b: b.edits), "").alias("audit"))
    sums = digests(repaired_turns(turns, edits))
    out = seen.join(costs, "cid").join(audit, "cid").join(sums, "cid", "left")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
