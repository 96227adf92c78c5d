"""Raw RGB frames, what is known of their files, and their tiles.

Video decoding isn't part of this engine: frames come as packed RGB files (one per source) or as rows
(source, frame, width, height, rgb).  The source ``raw_frames`` reads such files by ranges of bytes, so no file lies whole in a row or
task; it opens paths that drivers and executors see alike, such as a mounted store.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

TILES = "source string, frame long, ts double, col int, row int, x int, y int, w int, h int, rgb binary"
FRAMES = "source string, frame long, ts double, width int, height int, rgb binary"
#: Bytes of frames in a partition, and in a batch of rows
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def local(path: str) -> Path:
    """A path without the scheme of a mounted file system."""
    return Path(path.removeprefix("file://").removeprefix("file:"))


@dataclass
class Stretch(InputPartition):
    """Frames of one file: their first number from the range's start on, and how many."""

    source: str
    first: int
    count: int


@dataclass
class Written(WriterCommitMessage):
    """A file of one task, under its name until the job commits."""

    path: str
    frames: int


class FrameRanges(DataSourceReader):
    """Ranges of bytes of all frames."""

    def __init__(self, options: dict[str, str]) -> None:
        self.width, self.height, self.fps = int(options["width"]), int(options["height"]), float(options["fps"])
        self.size = self.width * self.height * 3
        if self.size <= 0 or self.fps <= 0:
            raise ValueError("width, height and fps must be over 0")
        self.path = options["path"]
        self.skipped = round(float(options.get("start", 0)) * self.fps)
        self.most = round(float(options["duration"]) * self.fps) if "duration" in options else None
        self.per = max(1, int(options.get("partitionBytes", PARTITION_BYTES)) // self.size)
        self.low, self.high = 0, math.inf

    def partitions(self) -> list[Stretch]:
        top = local(self.path)
        files = sorted(p for p in top.rglob("*") if p.is_file() and not p.name.startswith((".", "_"))) if top.is_dir() else [top]
        out = []
        for p in files:
            frames = p.stat().st_size // self.size - self.skipped  # a partial last frame is left out
            end = min(frames if self.most is None else min(frames, self.most), self.high + 1)
            out += [Stretch(str(p), k, int(min(self.per, end - k))) for k in range(max(0, int(self.low)), int(max(0, end)), self.per)]
        return out or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH_BYTES // self.size)
        if not partition.count:
            return
        with open(partition.source, "rb") as file:
            file.seek((self.skipped + partition.first) * self.size)
            for k in range(partition.first, partition.first + partition.count, step):
                n = min(step, partition.first + partition.count - k)
                raw = file.read(n * self.size)
                frame = np.arange(k, k + n)
                rgb = pa.array([raw[i * self.size : (i + 1) * self.size] for i in range(n)], pa.binary())
                columns = [pa.array([partition.source] * n), pa.array(frame, pa.int64()), pa.array(frame * 1000.0 / self.fps), *(pa.array([x] * n, pa.int32()) for x in (self.width, self.height)), rgb]
                yield pa.RecordBatch.from_arrays(columns, ["source", "frame", "ts", "width", "height", "rgb"])


class FrameReader(FrameRanges):
    """Reads the frames that filters leave.

    Spark keeps what is left with the table, for later queries without filters too, so only tables that one query reads may have it.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of ts and frame narrow the frames that are read; Spark applies all filters again."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("ts",), ("frame",)):
                at = float(f.value) * self.fps / 1000 if f.attribute == ("ts",) else float(f.value)
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, math.floor(at) - 1)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, math.ceil(at) + 1)
            yield f


class FrameWriter(DataSourceArrowWriter):
    """One file a task; files get their names when all tasks have ended, so a lost task leaves none."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.top, self.overwrite = local(options["path"]), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        self.top.mkdir(parents=True, exist_ok=True)
        path, n = self.top / f".{uuid.uuid4().hex}.rgb", 0
        with open(path, "wb") as file:
            for batch in iterator:
                for x in batch.column("rgb"):
                    file.write(x.as_buffer())
                n += batch.num_rows
        return Written(str(path), n)

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            for p in self.top.glob("part-*.rgb"):
                p.unlink()
        job = uuid.uuid4().hex[:8]
        for k, m in enumerate(messages):
            if m and m.frames:
                os.replace(m.path, self.top / f"part-{k:05d}-{job}.rgb")
            elif m:
                Path(m.path).unlink(missing_ok=True)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                Path(m.path).unlink(missing_ok=True)


class RawFrames(DataSource):
    """Options: path, width, height, fps, start and duration (seconds), partitionBytes, pushed (true: see FrameReader)."""

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> FrameRanges:
        return (FrameReader if self.options.get("pushed") == "true" else FrameRanges)(self.options)

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options, overwrite)


def read_raw(spark: SparkSession, path: str, width: int, height: int, fps: float, start: float = 0.0, duration: float | None = None, pushed: bool = False) -> DataFrame:
    """Frames of packed RGB files from ``start`` on, for ``duration`` seconds, whose bytes alone are read; a partial last frame is left out.

    With ``pushed`` filters on ts and frame narrow what is read too; such frames are for one query that reads them once.
    """
    if pushed:
        spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(RawFrames)
    options = {"width": width, "height": height, "fps": fps, "start": start, "pushed": str(pushed).lower()} | ({} if duration is None else {"duration": duration})
    return spark.read.format("raw_frames").options(**options).load(path)


def write_raw(frames: DataFrame, path: str) -> None:
    """The rgb of the rows as packed files, one for each partition, in its order."""
    frames.sparkSession.dataSource.register(RawFrames)
    width, height = F.lit(None).cast("int"), F.lit(None).cast("int")
    rows = frames.select(F.lit("").alias("source"), F.lit(0).cast("long").alias("frame"), F.lit(0.0).alias("ts"), width.alias("width"), height.alias("height"), "rgb")
    rows.write.format("raw_frames").mode("overwrite").save(path)


def replay(frames: DataFrame, fps: float) -> DataFrame:
    """Frames (frame) with the time at which each is shown again."""
    return frames.withColumn("ts", F.col("frame") * 1000.0 / fps)


def media(spark: SparkSession, path: str, width: int, height: int, fps: float) -> DataFrame:
    """Source, bytes, frames and duration (seconds) of packed RGB files, of which nothing is read; one without a frame raises."""
    size = width * height * 3
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("source"), F.col("length").alias("bytes"))
    frames = F.floor(F.col("bytes") / size)
    has = F.when(frames > 0, frames).otherwise(F.raise_error(F.concat(F.lit("no frame in "), "source")).cast("long"))
    return files.select("source", "bytes", has.alias("frames"), (has / fps).alias("duration"))


def extract_tiles(frames: DataFrame, tile: int) -> DataFrame:
    """Every frame cut into the tiles of its grid, edge tiles cropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                w, h = f["width"], f["height"]
                image = np.frombuffer(f["rgb"], np.uint8).reshape(h, w, 3)
                cells = [(x // tile, y // tile, x, y, image[y : y + tile, x : x + tile]) for y in range(0, h, tile) for x in range(0, w, tile)]
                n = len(cells)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f["source"]] * n), pa.array([f["frame"]] * n, pa.int64()), pa.array([f["ts"]] * n, pa.float64()), *(pa.array([c[k] for c in cells], pa.int32()) for k in range(4)), *(pa.array([c[4].shape[k] for c in cells], pa.int32()) for k in (1, 0)), pa.array([c[4].tobytes() for c in cells], pa.binary())],
                    ["source", "frame", "ts", "col", "row", "x", "y", "w", "h", "rgb"],
                )

    return frames.select("source", "frame", "ts", "width", "height", "rgb").mapInArrow(run, TILES)
