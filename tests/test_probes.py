"""Candidates scored in one job against one after another, a frame at a time."""

import numpy as np

from runloom.plans import probes
from runloom.plans.tuning import Parameters
from runloom.sources.assets import encode_png, octree_palette


def brute(frames: list[tuple], p: Parameters) -> tuple:
    stored, commands, quality, snapshots = {}, 0, {"train": [], "eval": []}, {}
    for series, _, fold, w, h, rgb in sorted(frames, key=lambda f: (f[0], f[1])):
        image = np.frombuffer(rgb, np.uint8).reshape(h, w, 3)
        out = np.zeros_like(image)
        for y in range(0, h, p.tile):
            for x in range(0, w, p.tile):
                raw = image[y : y + p.tile, x : x + p.tile]
                step = 256 // p.quant
                own = np.minimum(255, raw.astype(int) // step * step + step // 2).astype(np.uint8)
                old = snapshots.get((series, x, y))
                if old is None or not ((own == old[1]).all() or np.abs(raw.astype(int) - old[0]).mean() <= p.tolerance):
                    snapshots[series, x, y] = old = (raw.astype(int), own)
                    commands += 1
                pixels = old[1].reshape(-1, 3)
                if p.colors:
                    colours, index, counts = np.unique(pixels, axis=0, return_inverse=True, return_counts=True)
                    pixels = octree_palette(colours, counts, p.colors)[index.ravel()]
                stored[old[1].shape[1], old[1].tobytes()] = len(encode_png(old[1].shape[1], old[1].shape[0], pixels.tobytes()))
                out[y : y + p.tile, x : x + p.tile] = pixels.reshape(old[1].shape)
        mse = ((image.astype(float) - out) ** 2).mean()
        quality[fold].append(100.0 if mse <= 0 else 10 * np.log10(255**2 / mse))
    return *(float(np.mean(quality[f])) for f in ("train", "eval")), sum(stored.values()), commands


def test_probe_equals_one_after_another(spark):
    rng = np.random.default_rng(5)
    frames, image = [], rng.integers(0, 256, (7, 10, 3))
    for s in "ab":
        for k in range(12):
            if k % 3 == 0:
                image = rng.integers(0, 256, (7, 10, 3))
            image = np.clip(image + rng.integers(-6, 7, image.shape) * (rng.random(image.shape) < 0.3), 0, 255)
            frames.append((s, k, "eval" if k % 4 == 2 else "train", 10, 7, image.astype(np.uint8).tobytes()))
    df = spark.createDataFrame([(*f[:5], bytearray(f[5])) for f in frames], "series string, frame long, fold string, width int, height int, rgb binary").repartition(3)
    tried = [Parameters(4, 0, 32, 0), Parameters(8, 0, 32, 0), Parameters(4, 3, 32, 0), Parameters(4, 0, 8, 0), Parameters(4, 0, 32, 4), Parameters(4, 0, 256, 0)]
    got = {r.ord: r for r in probes.probe(df, tried).collect()}
    seen = set()
    for k, p in enumerate(tried):
        want = brute(frames, p)
        assert np.allclose((got[k].train, got[k].eval), want[:2]) and (got[k].bytes, got[k].commands) == want[2:], p
        seen.add(tuple(round(x, 6) for x in want))
    assert len(seen) == len(tried)  # every axis changes the score
    assert got[5].train == 100 and probes.probe(df.where("false"), tried).count() == 0


def test_tolerance_of_arrays():
    assert probes.within(b"\x00\x0a", b"\x04\x0a", 2.0) and not probes.within(b"\x00\x0a", b"\x05\x0a", 2.0) and not probes.within(b"a", b"ab", 9)


def test_frames_are_encoded_once(spark):
    frame = ("a", 1, "train", 2, 2, bytearray(range(12)))
    df = spark.createDataFrame([frame], "series string, frame long, fold string, width int, height int, rgb binary")
    assert "MapInArrow" not in probes.probe(df, [Parameters(2)])._jdf.queryExecution().toString()  # it was there for each of two aggregates


def test_distinct_colours():
    from runloom.sources.assets import distinct_colours

    pixels = np.random.default_rng(1).integers(0, 3, (60, 3), dtype=np.uint8) * 127
    for got, want in zip(distinct_colours(pixels), np.unique(pixels, axis=0, return_inverse=True, return_counts=True), strict=True):
        assert (got == want.reshape(got.shape)).all()
