"""The two stages of tiles as a stream: runs of unchanged content, then bursts of short ones, in one keyed operator.

Rows wait in the state until the watermark has passed them, so each key's rows are taken in the order of their time, whatever batch they
came in; what is held is what came since the watermark.  A key that is silent for the timeout ends: first its open run, then what
the second stage still holds.  ``runloom.operators.bursts.split_runs`` is the same for tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "key long, kind string, start long, end long, n long, contents array<string>"
RUN = "start long, end long, content string"


class TileStages(StatefulProcessor):
    """Times are in milliseconds.  ``single``: the length of a run of one frame, within ``slack``."""

    def __init__(self, timeout: int, single: float, slack: float, cap: int, least: int, unique: float) -> None:
        self.timeout, self.single, self.slack, self.cap, self.least, self.unique = timeout, single, slack, cap, least, unique

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "time long, content string, wide boolean")
        self.open = handle.getValueState("open", "start long, last long, content string, wide boolean")
        self.pending = handle.getListState("pending", RUN)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        latest = None
        for pdf in rows:
            self.waiting.appendList([(int(t), None if pd.isna(c) else c, bool(w)) for t, c, w in zip(pdf["time"], pdf["content"], pdf["wide"], strict=True)])
            latest = max(int(pdf["time"].max()), latest if latest is not None else int(pdf["time"].max()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + 1)
        yield from self.taken(key, timerValues.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        yield from self.taken(key, now, False)
        if self.waiting.exists():
            return
        end = self.open.get()[1] + self.timeout if self.open.exists() else now
        if end < now:
            yield from self.taken(key, now, True)
        else:
            self.handle.registerTimer(max(end, now) + 1)

    def taken(self, key: tuple, upto: int, ends: bool) -> Iterator[pd.DataFrame]:
        """What the rows up to a time close; at the key's end, all."""
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((r for r in rows if r[0] <= upto), key=lambda r: r[0])
        if not due and not ends:
            return
        left = [r for r in rows if r[0] > upto]
        self.waiting.put(left) if left else self.waiting.clear()
        open_ = tuple(self.open.get()) if self.open.exists() else None
        pending = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        out: list[tuple] = []
        for time, content, wide in due:
            if open_ and (open_[2], open_[3]) != (content, wide):
                pending = self.detect(open_, time, pending, out)
                open_ = None
            open_ = (open_[0] if open_ else time, time, content, wide)
        if ends:
            if open_:
                pending = self.detect(open_, open_[1], pending, out)
            out += self.flushed(pending)
            open_, pending = None, []
        self.open.update(open_) if open_ else self.open.clear()
        self.pending.put(pending) if pending else self.pending.clear()
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["key", "kind", "start", "end", "n", "contents"])

    def detect(self, run: tuple, end: int, pending: list[tuple], out: list[tuple]) -> list[tuple]:
        """The second stage takes a closed run; what it still holds."""
        start, _, content, wide = run
        own = ("sprite", start, end, 1, [content])
        if wide:  # a merged block is no frame of a burst
            out.append(own)
            return pending
        if abs(end - start - self.single) > self.slack:
            out += [*self.flushed(pending), own]
            return []
        if pending and pending[-1][1] != start:
            out += self.flushed(pending)
            pending = []
        pending = [*pending, (start, end, content)]
        if len(pending) < self.cap:
            return pending
        out += self.flushed(pending)
        return []

    def flushed(self, runs: list[tuple]) -> list[tuple]:
        if len(runs) >= self.least and len({c for _, _, c in runs}) >= self.unique * len(runs):
            return [("animation", runs[0][0], runs[-1][1], len(runs), [c for _, _, c in runs])]
        return [("sprite", s, e, 1, [c]) for s, e, c in runs]

    def close(self) -> None:
        pass


def stream_tiles(stream: DataFrame, key: str, time: str, content: str, wide: str | None = None, single: float = 1000 / 30, slack: float = 1.0, delay: str = "1 minute", timeout_ms: int = 60_000, cap: int = 300, least: int = 4, unique: float = 0.8) -> DataFrame:
    """key, kind (sprite or animation), start, end (milliseconds), n and contents, in append mode; keeps its state in RocksDB."""
    stream.sparkSession.conf.set(PROVIDER, ROCKS)
    flag = F.lit(False) if wide is None else F.coalesce(F.col(wide), F.lit(False))
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(time).cast("timestamp").alias("at"), F.col(content).cast("string").alias("content"), flag.alias("wide")).withWatermark("at", delay)
    rows = rows.withColumn("time", F.unix_millis("at"))
    return rows.groupBy("key").transformWithStateInPandas(TileStages(timeout_ms, single, slack, cap, least, unique), OUTPUT, "append", "eventtime")
