"""Raw frames by ranges of bytes, and assets as files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.sources import assets, frames


def test_frames_of_several_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = {n: rng.integers(0, 256, (k, 2 * 3 * 3), dtype=np.uint8) for n, k in (("a", 23), ("b", 1), ("c", 0))}
    for n, x in data.items():
        (tmp_path / f"{n}.rgb").write_bytes(x.tobytes() + b"rest"[: 3 * (n == "a")])
    read = lambda **more: frames.read_raw(spark, str(tmp_path), 3, 2, 10.0, **more)
    got = {(os.path.basename(r.source)[0], r.frame): (r.ts, bytes(r.rgb)) for r in read().collect()}
    assert got == {(n, i): (i * 100.0, row.tobytes()) for n, x in data.items() for i, row in enumerate(x)}
    small = spark.read.format("raw_frames").options(width=3, height=2, fps=10, partitionBytes=40).load(str(tmp_path))
    assert small.rdd.getNumPartitions() == 13 and small.count() == 24
    assert [r.frame for r in read(start=0.5, duration=0.4).where("source like '%a.rgb'").orderBy("frame").collect()] == [0, 1, 2, 3]
    assert bytes(read(start=0.5, duration=0.4).where("frame = 2").first().rgb) == data["a"][7].tobytes()


def test_time_filters_are_pushed(spark, tmp_path):
    (tmp_path / "v.rgb").write_bytes(bytes(range(256)) * 48)  # 1024 frames of 12 bytes
    all_ = frames.read_raw(spark, str(tmp_path), 2, 2, 4.0)
    part = all_.where("ts >= 1000 and ts < 2000")
    assert sorted(r.frame for r in part.collect()) == [4, 5, 6, 7]
    reader = frames.FrameReader({"path": str(tmp_path), "width": "2", "height": "2", "fps": "4"})
    list(reader.pushFilters([frames.GreaterThanOrEqual(("ts",), 1000.0), frames.LessThan(("ts",), 2000.0)]))
    (stretch,) = reader.partitions()
    assert 3 <= stretch.first <= 4 and stretch.count <= 7
    assert all_.where("frame = 1023").count() == 1 and all_.where("ts > 1e9").count() == 0


def test_a_large_file_is_many_partitions(tmp_path):
    with open(tmp_path / "v.rgb", "wb") as f:
        f.truncate(3 << 30)  # sparse
    reader = frames.FrameReader({"path": str(tmp_path / "v.rgb"), "width": "1920", "height": "1080", "fps": "30"})
    parts = reader.partitions()
    size = 1920 * 1080 * 3
    assert len(parts) > 40 and sum(p.count for p in parts) == (3 << 30) // size and max(p.count for p in parts) * size <= frames.PARTITION_BYTES
    first = next(reader.read(parts[-1]))
    assert first.num_rows * size <= frames.BATCH_BYTES or first.num_rows == 1


def test_media_and_replay(spark, tmp_path):
    (tmp_path / "v.rgb").write_bytes(bytes(12 * 5 + 1))
    row = frames.media(spark, str(tmp_path), 2, 2, 10.0).first()
    assert (row.bytes, row.frames, row.duration) == (61, 5, 0.5)
    (tmp_path / "w.rgb").write_bytes(b"short")
    with pytest.raises(Exception, match="no frame in"):
        frames.media(spark, str(tmp_path), 2, 2, 10.0).collect()
    assert frames.replay(spark.range(3).withColumnRenamed("id", "frame"), 4.0).where("frame = 2").first().ts == 500


def test_written_frames_are_read_back(spark, tmp_path):
    rows = spark.range(40).select(F.unhex(F.repeat(F.lpad(F.hex("id"), 2, "0"), F.lit(12))).alias("rgb"))
    for _ in range(2):  # the second write takes the place of the first
        frames.write_raw(rows.repartition(3), str(tmp_path / "out"))
    back = frames.read_raw(spark, str(tmp_path / "out"), 2, 2, 25.0)
    assert sorted(bytes(r.rgb)[0] for r in back.collect()) == list(range(40)) and back.select("source").distinct().count() == 3
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".") and p.suffix == ".rgb"]


def images(spark, data):
    return spark.createDataFrame([(k, w, h, bytearray(x)) for k, w, h, x in data], "asset_key string, w int, h int, rgb binary")


def test_png_round_trip():
    rng = np.random.default_rng(2)
    for w, h, colours in ((1, 1, 1), (7, 3, 5), (40, 30, 256), (64, 48, 100_000)):
        rgb = rng.integers(0, 256, (colours, 3), dtype=np.uint8)[rng.integers(0, colours, w * h)].tobytes()
        assert assets.decode_png(assets.encode_png(w, h, rgb)) == (w, h, rgb)
    with pytest.raises(ValueError):
        assets.decode_png(b"GIF89a")


def test_a_second_write_touches_no_file(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = [(f"k{i % 30}", 4, 4, rng.integers(0, 256, 48, dtype=np.uint8).tobytes() if i < 30 else None) for i in range(45)]
    data = [(k, w, h, x or data[i - 30][3]) for i, (k, w, h, x) in enumerate(data)]
    path = str(tmp_path / "store")
    assert assets.store(images(spark, data).repartition(4), path) == (30, 0)
    times = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "store").glob("*.png")}
    assert assets.store(images(spark, [*data, ("new", 1, 1, b"abc")]), path) == (1, 30)
    assert len(times) == 30 and all((tmp_path / "store" / n).stat().st_mtime_ns == t for n, t in times.items())
    back = {r.asset_key: (r.w, r.h, bytes(r.rgb)) for r in assets.stored(spark, path).collect()}
    assert back == {k: (w, h, x) for k, w, h, x in data} | {"new": (1, 1, b"abc")}


def brute_octree(pixels: list[tuple], most: int) -> dict:
    """The same folding over a tree of dictionaries."""
    leaves: dict = {}
    for p in pixels:
        path = tuple(tuple(c >> b & 1 for c in p) for b in range(7, -1, -1))
        leaves.setdefault(path, []).append(p)
    for depth in range(7, -1, -1):
        parents: dict = {}
        for path in leaves:
            if len(path) == depth + 1:
                parents.setdefault(path[:depth], []).append(path)
        for parent in sorted(parents, key=lambda q: (sum(len(leaves[x]) for x in parents[q]), q)):
            if len(leaves) <= most:
                break
            leaves[parent] = [p for x in parents[parent] for p in leaves.pop(x)]
    return {p: tuple(int(sum(c) / len(own) + 0.5) for c in zip(*own, strict=True)) for own in leaves.values() for p in own}


@pytest.mark.parametrize("most", [1, 2, 7, 16, 64])
def test_palette_equals_a_plain_octree(spark, most):
    rng = np.random.default_rng(most)
    pixels = rng.choice([rng.integers(0, 256, 3), *rng.integers(0, 256, (40, 3)), *rng.integers(90, 110, (40, 3))], 400).astype(np.uint8)
    want = brute_octree([tuple(p) for p in pixels.tolist()], most)
    got = assets.quantise(images(spark, [("k", 20, 20, pixels.tobytes())]), most).first().rgb
    assert [tuple(p) for p in np.frombuffer(got, np.uint8).reshape(-1, 3).tolist()] == [want[tuple(p)] for p in pixels.tolist()] and len(set(want.values())) <= most


def test_frames_are_read_whole_after_a_filter(spark, tmp_path):
    (tmp_path / "v.rgb").write_bytes(bytes(range(12)) * 40)  # 40 frames of 12 bytes
    all_ = frames.read_raw(spark, str(tmp_path), 2, 2, 4.0)
    assert all_.where("frame = 30").count() == 1
    assert all_.count() == 40
    low, high = all_.where("frame < 3"), all_.where("frame > 35")
    assert sorted(r.frame for r in low.unionByName(high).collect()) == [0, 1, 2, 36, 37, 38, 39]
    once = frames.read_raw(spark, str(tmp_path), 2, 2, 4.0, pushed=True).where("ts >= 1000 and ts < 2000")
    assert sorted(r.frame for r in once.collect()) == [4, 5, 6, 7]
