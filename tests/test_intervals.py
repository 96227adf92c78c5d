"""The index of intervals against all pairs, and nested loops against recursion."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from runloom.operators import intervals, rewrite, timeline


def test_covering_equals_all_pairs(spark):
    rng = random.Random(8)
    spans = []
    for i in range(300):
        start = rng.choice([0.0, -5.5, rng.uniform(-100, 100), rng.uniform(-1e9, 1e9), float(rng.randint(0, 64))])
        spans.append((rng.randint(0, 2), i, start, start + rng.choice([0.0, 0.25, 1.0, 8.0, rng.uniform(0, 50), rng.uniform(0, 3e8), -3.0])))
    points = [(rng.randint(0, 3), float(t)) for _ in range(300) for t in [rng.choice([*spans[rng.randrange(300)][2:], rng.uniform(-100, 100)])]]
    df = spark.createDataFrame(spans, "k int, i int, start double, end double")
    at = spark.createDataFrame(sorted(set(points)), "k int, t double")
    got = sorted((r.k, r.t, r.i) for r in intervals.covering(at, df, ("k",)).collect())
    assert got == sorted((k, t, i) for k, t in set(points) for kk, i, s, e in spans if k == kk and s <= t <= e)


def test_rows_do_not_grow_with_length(spark):
    lengths = [0.0, 0.5, 1.0, 1.5, 2.0, 1023.0, 1024.0, 1025.0, 3e8, 2.0**40, 2.0**62]
    df = spark.createDataFrame([(i, s, s + n) for i, n in enumerate(lengths) for s in (0.0, 0.75, 12345.0)], "i int, start double, end double")
    most = intervals.indexed(df).groupBy("i", "start").count().agg({"count": "max"}).first()[0]
    assert most <= 3
    assert intervals.indexed(df.where("false")).count() == 0
    one = spark.createDataFrame([("o", "F", 0, 0.0, 3e8, 0, 0.0, 1.0)], "object string, kind string, seq int, start double, end double, easing int, v_start double, v_end double")
    at = spark.createDataFrame([("o", "F", 1.5e8)], "object string, kind string, t double")
    assert timeline.evaluate(one, at).first().value == 0.5


def loops(spark, data):
    return spark.createDataFrame(data, "object string, seq double, parent double, depth int, kind string, start double, end double, count int")


def flat(rows: list[tuple]) -> list[tuple]:
    """(seq, start, end) by recursion over the same rows."""
    under: dict = {}
    for _, seq, parent, _, kind, start, end, count in rows:
        under.setdefault(parent, []).append((seq, kind, start, end, count))

    def of(parent) -> list[tuple]:
        out = []
        for seq, kind, start, end, count in under.get(parent, []):
            if kind != "Loop":
                out.append((seq, start, end))
                continue
            inner = of(seq)
            cycle = max([0.0, *(e for _, _, e in inner)])
            out += [(s, a + start + i * cycle, b + start + i * cycle) for i in range(max(1, count or 0)) for s, a, b in inner]
        return out

    return sorted(of(0.0))


def test_nested_loops(spark):
    rng = random.Random(2)
    for _ in range(4):
        data, seq = [], 0.0
        for o in "ab":
            open_ = [(0.0, 0)]
            for _ in range(14):
                parent, depth = rng.choice(open_)
                seq += 1
                if rng.random() < 0.45 and depth < 3:
                    data.append((o, seq, parent, depth + 1, "Loop", float(rng.randint(0, 50)), None, rng.choice([None, 0, 1, 2, 3])))
                    open_.append((seq, depth + 1))
                else:
                    start = float(rng.randint(0, 20))
                    data.append((o, seq, parent, depth + 1, "Fade", start, start + rng.randint(0, 30), None))
        got = rewrite.expand_loops(loops(spark, data)).collect()
        for o in "ab":
            assert sorted((r.seq, r.start, r.end) for r in got if r.object == o) == flat([d for d in data if d[0] == o])
        assert all(r.parent == 0.0 and r.kind == "Fade" for r in got)


def test_loops_of_two_levels_by_hand(spark):
    data = [("o", 1.0, 0.0, 1, "Loop", 5000.0, None, 2), ("o", 2.0, 1.0, 2, "Loop", 0.0, None, 2), ("o", 3.0, 2.0, 3, "Fade", 0.0, 200.0, None), ("o", 4.0, 0.0, 1, "Fade", 7.0, 9.0, None)]
    got = rewrite.expand_loops(loops(spark, data)).orderBy("seq", "iteration").collect()
    assert [(r.start, r.end, r.iteration) for r in got] == [(5000.0, 5200.0, 0), (5200.0, 5400.0, 1), (5400.0, 5600.0, 2), (5600.0, 5800.0, 3), (7.0, 9.0, 0)]
    same = [("o", 4.0, 0.0, 1, "Fade", 7.0, 9.0, None)]
    assert [tuple(r) for r in rewrite.expand_loops(loops(spark, same)).collect()] == [(*same[0], 0)]


def test_triggers_and_loops(spark):
    held = [("o", 1.0, 0.0, 1, "Trigger", 0.0, 99.0, None), ("o", 2.0, 1.0, 2, "Loop", 3.0, None, 4), ("o", 3.0, 2.0, 3, "Fade", 0.0, 5.0, None), ("o", 4.0, 0.0, 1, "Loop", 10.0, None, 2), ("o", 5.0, 4.0, 2, "Fade", 0.0, 5.0, None)]
    got = sorted(tuple(r)[:-1] for r in rewrite.expand_loops(loops(spark, held)).drop("count").collect())
    assert [(r[1], r[4], r[5]) for r in got] == [(1.0, "Trigger", 0.0), (2.0, "Loop", 3.0), (3.0, "Fade", 0.0), (5.0, "Fade", 10.0), (5.0, "Fade", 15.0)]
    wrong = [("o", 1.0, 0.0, 1, "Loop", 0.0, None, 2), ("o", 2.0, 1.0, 2, "Trigger", 0.0, 99.0, None)]
    with pytest.raises(Exception, match="trigger in a loop"):
        rewrite.expand_loops(loops(spark, wrong)).select(F.max("end")).collect()


def test_expanded_loops_leave_no_raw_rows(spark, monkeypatch):
    data = [("o", 1.0, 0.0, 1, "Loop", 50.0, None, 2), ("o", 2.0, 1.0, 2, "Loop", 0.0, None, 2), ("o", 3.0, 2.0, 3, "Fade", 0.0, 2.0, None), ("o", 4.0, 1.0, 2, "Fade", 0.0, 9.0, None)]
    df = loops(spark, data)
    monkeypatch.setattr(type(df), "checkpoint", None)
    got = rewrite.expand_loops(df).orderBy("seq", "iteration").collect()
    assert [(r.seq, r.start) for r in got] == [(3.0, 50.0), (3.0, 52.0), (3.0, 59.0), (3.0, 61.0), (4.0, 50.0), (4.0, 59.0)]
