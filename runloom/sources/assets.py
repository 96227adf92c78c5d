"""Images as PNG files named by their content, written once and read back.

The source ``asset_files`` writes each row's image under its key; a file that is there already isn't written again, so tasks that run
twice and later jobs leave the same files.  It opens paths that drivers and executors see alike.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .frames import local

ASSETS = "asset_key string, w int, h int, rgb binary"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Files of one partition when reading
FILES = 512
#: Bits of a channel that an octree tells apart
DEPTH = 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(w: int, h: int, rgb: bytes) -> bytes:
    """A PNG of 8-bit colours; by a palette if it has 256 colours at most, which loses nothing."""
    pixels = np.frombuffer(rgb, np.uint8).reshape(h, w, 3)
    colours, index, _ = distinct_colours(pixels.reshape(-1, 3))
    few = len(colours) <= 256
    rows = index.astype(np.uint8).reshape(h, w) if few else pixels.reshape(h, w * 3)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()  # each row unfiltered
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 3 if few else 2, 0, 0, 0))
    return SIGNATURE + head + (_chunk(b"PLTE", colours.tobytes()) if few else b"") + _chunk(b"IDAT", zlib.compress(raw, 9)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and pixels of what encode_png() writes; anything else raises."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, parts = 8, {}
    while at < len(data):
        size = struct.unpack_from(">I", data, at)[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("damaged PNG")
        parts[kind] = parts.get(kind, b"") + body
        at += 12 + size
    w, h, bits, colour = struct.unpack_from(">IIBB", parts[b"IHDR"])
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(h, -1)
    if bits != 8 or colour not in (2, 3) or rows[:, 0].any():
        raise ValueError("a form of PNG that isn't read here")
    if colour == 3:
        return w, h, np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)[rows[:, 1:]].tobytes()
    return w, h, rows[:, 1:].tobytes()


def distinct_colours(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct colours of pixels (n by 3 bytes) in order, and for each pixel its colour's place, and their counts."""
    r, g, b = pixels.astype(np.int32).T
    number, index, counts = np.unique(r << 16 | g << 8 | b, return_inverse=True, return_counts=True)
    return np.stack([number >> 16, number >> 8 & 255, number & 255], axis=1).astype(np.uint8), index, counts


def octree_palette(colours: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """For each of some distinct colours (n by 3) with their counts, the colour that stands for it; ``most`` of them at most.

    The leaves of an octree, one bit of each channel a level, are folded into their parents, from the deepest level up and there those
    of the fewest pixels first (then the least prefix), until few enough are left.  A leaf's colour is the mean of its pixels.
    """
    path = np.zeros(len(colours), np.int64)
    for bit in range(DEPTH - 1, -1, -1):
        for channel in range(3):
            path = path << 1 | (colours[:, channel].astype(np.int64) >> bit & 1)
    level, leaf = DEPTH, path.copy()
    depth = np.full(len(colours), DEPTH)
    numbers = lambda: depth << 3 * DEPTH | leaf
    while (leaves := len(np.unique(numbers()))) > most and level:
        level -= 1
        deep = np.flatnonzero(depth > level)
        parents, of = np.unique(leaf[deep] >> 3, return_inverse=True)
        weight = np.bincount(of, counts[deep])
        children = np.unique(np.unique(leaf[deep]) >> 3, return_counts=True)[1]
        order = np.lexsort((parents, weight))
        left = leaves - np.cumsum(children[order] - 1) + children[order] - 1  # leaves before each is folded
        folded = np.zeros(len(parents), bool)
        folded[order[left > most]] = True
        at = folded[of]
        leaf[deep[at]], depth[deep[at]] = parents[of[at]], level
    _, group = np.unique(numbers(), return_inverse=True)
    total = np.bincount(group.ravel(), counts)
    mean = np.stack([np.bincount(group.ravel(), counts * colours[:, c]) / total for c in range(3)], axis=1)
    return np.floor(mean + 0.5).astype(np.uint8)[group.ravel()]


def quantise(assets: DataFrame, most: int) -> DataFrame:
    """Assets (asset_key, w, h, rgb) with the pixels of their own palette of ``most`` colours; 0 leaves them."""
    if most <= 0:
        return assets

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rgb in pdf["rgb"]:
                pixels = np.frombuffer(rgb, np.uint8).reshape(-1, 3)
                colours, index, counts = distinct_colours(pixels)
                out.append(octree_palette(colours, counts, most)[index.ravel()].tobytes())
            yield pdf.assign(rgb=out)

    return assets.select("asset_key", "w", "h", "rgb").mapInPandas(run, ASSETS)


@dataclass
class Stored(WriterCommitMessage):
    written: int
    skipped: int


@dataclass
class Files(InputPartition):
    paths: list[str]


class AssetWriter(DataSourceArrowWriter):
    """A file appears under its name only when it is whole."""

    def __init__(self, options: dict[str, str]) -> None:
        self.top = local(options["path"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Stored:
        self.top.mkdir(parents=True, exist_ok=True)
        written = skipped = 0
        for batch in iterator:
            for key, w, h, rgb in zip(*(batch.column(c).to_pylist() for c in ("asset_key", "w", "h", "rgb")), strict=True):
                path = self.top / f"{key}.png"
                if path.exists():
                    skipped += 1
                    continue
                part = self.top / f".{key}.{uuid.uuid4().hex}"
                part.write_bytes(encode_png(w, h, rgb))
                os.replace(part, path)
                written += 1
        return Stored(written, skipped)

    def commit(self, messages: list[Stored | None]) -> None:
        sums = [sum(getattr(m, k) for m in messages if m) for k in ("written", "skipped")]
        (self.top / "_last").write_text("{} {}".format(*sums))

    def abort(self, messages: list[Stored | None]) -> None:
        """What is there is whole and named by its content, so it can stay."""


class AssetReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.top = local(options["path"])

    def partitions(self) -> list[Files]:
        names = sorted(str(p) for p in self.top.glob("[!._]*.png"))
        return [Files(names[k : k + FILES]) for k in range(0, max(1, len(names)), FILES)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            w, h, rgb = decode_png(Path(path).read_bytes())
            columns = [pa.array([Path(path).stem]), *(pa.array([x], pa.int32()) for x in (w, h)), pa.array([rgb], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["asset_key", "w", "h", "rgb"])


class AssetFiles(DataSource):
    """Option: path, a folder."""

    @classmethod
    def name(cls) -> str:
        return "asset_files"

    def schema(self) -> str:
        return ASSETS

    def reader(self, schema) -> AssetReader:
        return AssetReader(self.options)

    def writer(self, schema, overwrite: bool) -> AssetWriter:
        return AssetWriter(self.options)


def store(assets: DataFrame, path: str, colours: int = 0) -> tuple[int, int]:
    """K3, D3: writes assets (asset_key, w, h, rgb), each key once; how many were written, and how many were there already."""
    spark = assets.sparkSession
    spark.dataSource.register(AssetFiles)
    once = assets.select("asset_key", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), "rgb").dropDuplicates(["asset_key"])
    quantise(once, colours).write.format("asset_files").mode("append").save(path)
    written, skipped = (local(path) / "_last").read_text().split()
    return int(written), int(skipped)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored assets with the pixels that their files hold."""
    spark.dataSource.register(AssetFiles)
    return spark.read.format("asset_files").load(path)
