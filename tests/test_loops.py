"""Repeating commands found as loops, and expanded again."""

from __future__ import annotations

import random

import pytest

from runloom.operators import loops, rewrite

COLUMNS = "object string, seq long, kind string, start double, end double, easing int, v_start double, v_end double"


def repeat(n, cycle, kind="Fade", first=0, at=0.0):
    return [("o", first + i, kind, at + i * cycle, at + (i + 1) * cycle, 0, 0.0, 1.0) for i in range(n)]


def found(spark, rows):
    return sorted(loops.extract_command_loops(spark.createDataFrame(rows, COLUMNS)).collect(), key=lambda r: (r.object, r.seq))


def brute(block: list[tuple]) -> tuple | None:
    """period and count of a block of one kind, by trying every period."""
    n = len(block)
    for p in range(1, n // 3 + 1):
        if n % p:
            continue
        cycle = max(r[4] for r in block[:p]) - block[0][3]
        same = all(abs(r[3] - b[3] - i // p * cycle) <= 0.01 and abs(r[4] - b[4] - i // p * cycle) <= 0.01 and r[5] == b[5] and abs(r[6] - b[6]) <= 1e-4 and abs(r[7] - b[7]) <= 1e-4 for i, r in enumerate(block) for b in [block[i % p]])
        if cycle > 0 and same:
            return p, n // p
    return None


def test_three_repeats_become_a_loop(spark):
    loop, child = found(spark, repeat(3, 500))
    assert (loop.kind, loop.start, loop.end, loop["count"], loop.depth) == ("Loop", 0, 0, 3, 1)
    assert (child.kind, child.start, child.end, child.parent, child.depth) == ("Fade", 0, 500, loop.seq, 2)


@pytest.mark.parametrize("rows", [repeat(1, 100), repeat(2, 500), [*repeat(2, 500), ("o", 2, "Fade", 1200.0, 1700.0, 0, 0.0, 1.0)], [("o", i, "Fade", 0.0, 0.0, 0, 1.0, 1.0) for i in range(3)]])
def test_what_is_no_loop_stays(spark, rows):
    got = found(spark, rows)
    assert [(r.seq, r.kind, r.start, r.end, r.parent) for r in got] == [(r[1], r[2], r[3], r[4], None) for r in rows]


def test_kinds_are_apart(spark):
    ramp = [("o", 10 + i, "MoveX", 100.0 * i, 100.0 * (i + 1), 0, 10.0 * i, 10.0 * (i + 1)) for i in range(3)]
    got = found(spark, [*repeat(3, 500), *ramp, ("o", 20, "Additive", 0.0, 0.0, None, None, None)])
    assert [r.kind for r in got] == ["Loop", "Fade", "MoveX", "MoveX", "MoveX", "Additive"]
    apart = found(spark, [*repeat(3, 500), ("o", 5, "Colour", 0.0, 9.0, 0, None, None), *repeat(3, 500, first=6, at=1500.0)])
    assert [r.kind for r in apart] == ["Loop", "Fade", "Colour", "Loop", "Fade"] and [r.start for r in apart if r.kind == "Loop"] == [0, 1500]


def test_loops_equal_brute_force_and_expand_to_what_was(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for k in range(40):
        p, times = rng.randint(1, 4), rng.randint(1, 6)
        body, t = [], 0.0
        for _ in range(p):
            length = float(rng.randint(1, 5))
            body.append((t, t + length, rng.randint(0, 1), float(rng.randint(0, 2)), float(rng.randint(0, 2))))
            t += length
        block = [(f"o{k}", i * p + j, "Scale", 100 + i * t + a, 100 + i * t + b, e, x, y) for i in range(times) for j, (a, b, e, x, y) in enumerate(body)]
        if rng.random() < 0.3:
            i = rng.randrange(len(block))
            block[i] = (*block[i][:7], 9.0)
        rows += block
        want[f"o{k}"] = brute(block)
    df = spark.createDataFrame(rows, COLUMNS)
    out = loops.extract_command_loops(df).cache()
    got = dict.fromkeys(want)
    for r in out.where("kind = 'Loop'").collect():
        got[r.object] = (out.where(f"object = '{r.object}' and kind != 'Loop'").count(), r["count"])
    assert got == want and sum(v is not None for v in want.values()) > 8
    flat = rewrite.expand_loops(out).select("object", "kind", "start", "end", "easing", "v_start", "v_end")
    assert sorted(tuple(r) for r in flat.collect()) == sorted((r[0], *r[2:]) for r in rows)


def test_three_passes(spark):
    zigzag = [("o", 2 * i + k, "MoveX", 100.0 * i + 50 * k, 100.0 * i + 50 * (k + 1), 0, 50.0 * k, 50.0 * (1 - k)) for i in range(4) for k in (0, 1)]
    split = [("o", 50, "Fade", 0.0, 100.0, 0, 0.0, 1.0), ("o", 51, "Fade", 100.0, 200.0, 0, 1.0, 2.0)]
    covered = [("o", 60, "Scale", 0.0, 900.0, 0, 1.0, 1.0), ("o", 61, "Scale", 10.0, 20.0, 0, 1.0, 1.0)]
    flag = [("o", 70, "FlipH", 0.0, 5.0, 0, None, None)]
    got = loops.simplify(spark.createDataFrame([*zigzag, *split, *covered, *flag], COLUMNS)).collect()
    assert sorted((r.kind, r.start, r.end, r["count"]) for r in got if r.kind != "Loop") == [("Fade", 0, 200, None), ("FlipH", 0, 5, None), ("MoveX", 0, 50, None), ("MoveX", 50, 100, None), ("Scale", 0, 900, None)]
    assert [(r["count"], r.start) for r in got if r.kind == "Loop"] == [(4, 0)]
