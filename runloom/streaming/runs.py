"""Runs and bursts of a stream.

Rows of a key must come in order between batches (within one they are sorted), as frames do; with the watermark behind, late
rows are dropped.  A run is emitted when its content changes, when it has ``cap`` rows, or when no row of its key has come for
``timeout``: a stream has no end at which to flush.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Iterator
from itertools import count, islice
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


STRETCH = pa.schema([("time", pa.timestamp("ns")), ("content", pa.string())])
KEYED = pa.schema([("us", pa.int64()), ("key", pa.int64()), ("content", pa.string())])
#: Neighbouring keys of a call at most
TOGETHER = 64
#: Rows of a call that are sorted in memory, sorted stretches on disk that are merged at a time, and rows read of each at once
HELD, STRETCHES, READ = 100_000, 32, 1000


def in_order(batches: Iterator[pd.DataFrame], held: int = HELD, of: pa.Schema = STRETCH) -> Iterator[tuple]:
    """The columns ``of`` the batches by time, the first of them, equal times as they came; over ``held`` rows are sorted on the task's disk."""

    def merged() -> Iterator[tuple]:
        return heapq.merge(*[rows(f) for f in stretches], key=itemgetter(0))

    def rows(path: str) -> Iterator[tuple]:
        with pa.OSFile(path) as f, pa.ipc.open_stream(f) as stretch:
            for batch in stretch:
                pdf = batch.to_pandas()
                yield from zip(*(pdf[c] for c in of.names), strict=True)

    def write(found: Iterator[tuple]) -> str:
        path = f"{folder}/{next(number)}"
        with pa.OSFile(path, "wb") as f, pa.ipc.new_stream(f, of) as stretch:
            while some := list(islice(found, READ)):
                stretch.write_batch(pa.RecordBatch.from_pandas(pd.DataFrame(some, columns=of.names), of, preserve_index=False))
        return path

    def sort() -> Iterator[tuple]:
        pdf = pd.concat(held_back).sort_values(of.names[0], kind="stable")
        return zip(*(pdf[c] for c in of.names), strict=True)

    number, stretches, held_back, n = count(), [], [], 0
    with tempfile.TemporaryDirectory(prefix="runs-") as folder:
        for pdf in batches:
            held_back.append(pdf[of.names])
            n += len(pdf)
            if n >= held:
                stretches.append(write(sort()))
                held_back, n = [], 0
            if len(stretches) == STRETCHES:
                whole = write(merged())
                for f in stretches:
                    os.unlink(f)
                stretches = [whole]
        if held_back and not stretches:
            yield from sort()
            return
        if held_back:
            stretches.append(write(sort()))
            held_back = []
        yield from merged()


def stream_runs(stream: DataFrame, key: str, time: str, content: str, delay: str = "1 minute", timeout_ms: int = 60_000, cap: int | None = None) -> DataFrame:
    """key, start, end, n and content of closed runs, in append mode.

    TOGETHER neighbouring keys share a call and a state, as calls take longer than rows; each keeps a run and a timer of its own.
    """
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(content).cast("string").alias("content")).withWatermark("time", delay)
    rows = rows.select(F.floor(F.col("key") / TOGETHER).alias("keys"), "key", "time", F.unix_micros("time").alias("us"), "content")
    output = "key long, start long, end long, n long, content string"
    state = "key array<long>, start array<long>, last array<long>, n array<long>, content array<string>, timer array<long>"

    def frame(closed: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: list(x) for c, x in zip(("key", "start", "end", "n", "content"), zip(*closed, strict=True), strict=True)})

    def fold(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = {k: run for k, *run in zip(*state.get, strict=True)} if state.exists or state.hasTimedOut else {}
        now = state.getCurrentWatermarkMs()
        closed, heard = [], set()
        for t, k, c in in_order(batches, of=KEYED) if not state.hasTimedOut else ():
            k = None if keys[0] is None else k
            run = open_.get(k)
            if run is not None and (run[3] != c or cap is not None and run[2] >= cap):
                closed.append((k, run[0], t, run[2], run[3]))
                run = None
                if len(closed) == READ:  # a frame for each run would take most of the time
                    yield frame(closed)
                    closed = []
            if run is None:
                open_[k] = [t, t, 1, c, 0]
            else:
                run[1], run[2] = t, run[2] + 1
            heard.add(k)
        for k in heard:
            open_[k][4] = max(open_[k][1] // 1000 + timeout_ms, now + 1)
        silent = [k for k, run in open_.items() if run[4] < now and k not in heard]
        closed += [(k, *open_.pop(k)[:4]) for k in silent]
        if closed:
            yield frame(closed)
        if not open_:
            state.remove()
            return
        state.update(([*open_], *map(list, zip(*open_.values(), strict=True))))
        state.setTimeoutTimestamp(max(now, min(run[4] for run in open_.values())))

    found = rows.groupBy("keys").applyInPandasWithState(fold, output, state, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("key", *[F.timestamp_micros(c).alias(c) for c in ("start", "end")], "n", "content")


def stream_bursts(stream: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """Bursts of each key by session windows: key, start, end and number of moments."""
    rows = stream.select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("time")).withWatermark("time", delay)
    out = rows.groupBy("key", F.session_window("time", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
