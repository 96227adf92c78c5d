"""Parameters tried on sample frames: encoded, drawn again and scored, all candidates in one job."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fidelity import psnr
from ..operators.folds import fold_sorted
from ..session import stash
from ..sources.assets import distinct_colours, encode_png, octree_palette
from .tuning import Parameters, Score

KEYS = ["ord", "series", "col", "row"]
#: Contents whose stored form a task remembers
REMEMBERED = 4096


def within(a: bytes, b: bytes, tolerance: float) -> bool:
    """whether the mean absolute difference of two contents of one length is within a tolerance."""
    x, y = (np.frombuffer(v, np.uint8).astype(np.int16) for v in (a, b))
    return len(x) == len(y) and float(np.abs(x - y).sum()) <= tolerance * len(x)


def quantised(pixels: np.ndarray, levels: int) -> np.ndarray:
    """P4 of an image."""
    if levels <= 0 or levels >= 256:
        return pixels
    step = 256 // levels
    return np.minimum(255, pixels.astype(np.int16) // step * step + step // 2).astype(np.uint8)


def _tiles(frames: DataFrame, candidates: Sequence[Parameters]) -> DataFrame:
    """ord, tolerance, series, col, row, frame, fold, and raw and own (quantised) pixels of each candidate's tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ord", "series", "col", "row", "frame", "fold", "size", "w", "raw", "own"]
        for batch in batches:
            for f in batch.to_pylist():
                image = np.frombuffer(f["rgb"], np.uint8).reshape(f["height"], f["width"], 3)
                out = []
                for k, p in enumerate(candidates):
                    for y in range(0, f["height"], p.tile):
                        for x in range(0, f["width"], p.tile):
                            raw = image[y : y + p.tile, x : x + p.tile]
                            out.append((k, f["series"], x // p.tile, y // p.tile, f["frame"], f["fold"], image.size, raw.shape[1], raw.tobytes(), quantised(raw, p.quant).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], names)

    rows = frames.select(F.col("series").cast("string").alias("series"), F.col("frame").cast("long").alias("frame"), "fold", "width", "height", "rgb")
    return rows.mapInArrow(run, "ord long, series string, col long, row long, frame long, fold string, size long, w long, raw binary, own binary")


def _tracked(tiles: DataFrame, candidates: Sequence[Parameters]) -> DataFrame:
    """The tiles with opens (1 where a run opens) and drawn, the content that stands there: of the run that goes on within the tolerance."""
    tolerance = F.create_map(*[x for k, p in enumerate(candidates) for x in (F.lit(k).cast("long"), F.lit(float(p.tolerance)))])
    rows = tiles.withColumn("tolerance", tolerance[F.col("ord")])

    def step(state: tuple | None, piece: dict[str, list]) -> tuple[list[tuple], tuple]:
        out = []
        for frame, fold, size, w, raw, own, tolerance in zip(*(piece[c] for c in ("frame", "fold", "size", "w", "raw", "own", "tolerance")), strict=True):
            goes_on = state is not None and (own == state[1] or within(raw, state[0], tolerance))
            state = state if goes_on else (raw, own)
            out.append((frame, fold, size, w, int(not goes_on), raw, state[1]))
        return out, state

    output = {"frame": "long", "fold": "string", "size": "long", "w": "long", "opens": "long", "raw": "raw", "drawn": "own"}
    return fold_sorted(rows, KEYS, ["frame"], step, lambda state: [], output)


def _stored(tracked: DataFrame, candidates: Sequence[Parameters]) -> DataFrame:
    """ord, series, frame, fold, size, opens, error (squares) and key and bytes of the image that is stored for the content drawn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[np.ndarray, int]] = {}
        for batch in batches:
            error, size = [], []
            for ord_, w, raw, drawn in zip(*(batch.column(c).to_pylist() for c in ("ord", "w", "raw", "drawn")), strict=True):
                most = candidates[ord_].colors
                found = known.get((most, w, drawn))
                if found is None:
                    pixels = np.frombuffer(drawn, np.uint8).reshape(-1, 3)
                    if most > 0:
                        colours, index, counts = distinct_colours(pixels)
                        pixels = octree_palette(colours, counts, most)[index.ravel()]
                    found = pixels.ravel().astype(np.int32), len(encode_png(w, len(pixels) // w, pixels.tobytes()))
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[most, w, drawn] = found
                error.append(float(((np.frombuffer(raw, np.uint8).astype(np.int32) - found[0]) ** 2).sum()))
                size.append(found[1])
            columns = [batch.column(c) for c in ("ord", "series", "frame", "fold", "size", "opens", "key")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(error, pa.float64()), pa.array(size, pa.int64())], ["ord", "series", "frame", "fold", "size", "opens", "key", "error", "bytes"])

    keyed = tracked.withColumn("key", F.sha2(F.concat(F.col("w").cast("string").cast("binary"), "drawn"), 256))
    return keyed.mapInArrow(run, "ord long, series string, frame long, fold string, size long, opens long, key string, error double, bytes long")


def probe(frames: DataFrame, candidates: Sequence[Parameters]) -> DataFrame:
    """H5: ord, train, eval, bytes and commands of each candidate over sample frames (series, frame, fold, width, height, rgb).

    Frames are cut into the candidate's tiles and quantised; a tile's run goes on while its content stays or is within the tolerance of
    the content it opened with; distinct contents are stored by the candidate's palette, a run is a command.  Each frame, drawn from what
    is stored, is compared with the original: quality is the mean of decibels by fold.  Every candidate is a set of rows of one job.
    """
    rows = stash(_stored(_tracked(_tiles(frames, candidates), candidates), candidates))  # read by frame and by content, encoded once
    by_frame = rows.groupBy("ord", "series", "frame", "fold").agg((F.sum("error") / F.first("size")).alias("mse"), F.sum("opens").alias("opens"))
    quality = by_frame.groupBy("ord").agg(*[F.coalesce(F.avg(F.when(F.col("fold") == f, psnr(F.col("mse")))), F.lit(0.0)).alias(f) for f in ("train", "eval")], F.sum("opens").alias("commands"))
    stored = rows.groupBy("ord", "key").agg(F.first("bytes").alias("bytes")).groupBy("ord").agg(F.sum("bytes").alias("bytes"))
    return quality.join(stored, "ord").select("ord", "train", "eval", "bytes", "commands")


def scores(frames: DataFrame, candidates: Sequence[Parameters]) -> list[Score]:
    """The same for tune(): one row for each candidate."""
    found = {r.ord: r for r in probe(frames, candidates).collect()}
    return [Score(found[k].train, found[k].eval, found[k].bytes, found[k].commands) for k in range(len(candidates))]
