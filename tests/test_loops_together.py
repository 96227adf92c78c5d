"""Loops found where a key's commands meet once, and by joins for crowded keys: the same results."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from runloom import queries
from runloom.operators import loops
from runloom.session import BATCH

DIR = "/root/testdata/sf0.001"
COLUMNS = "object int, seq int, kind string, start double, end double, easing int, v_start double, v_end double, note string"


@pytest.fixture
def small_batches(spark):
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "7")
    yield
    spark.conf.set(BATCH, before)


def rows(df) -> list[str]:
    return sorted(map(repr, map(tuple, df.collect())))


def scripts(seed: int) -> list[tuple]:
    """Objects of a few blocks: whole turns, turns with a fault, odd values."""
    rng, out = random.Random(seed), []
    for o in range(200):
        t, seq = 0.0, 0
        for _ in range(rng.randint(1, 4)):
            body, kind = [], rng.choice(["Fade", "MoveX", "Colour", None])
            for _ in range(rng.randint(1, 4)):
                body.append((t, t + (d := float(rng.randint(0, 3))), rng.choice([0, 1, None]), rng.choice([0.0, 1.0]), rng.choice([0.0, 1.0, None, float("nan")] if rng.random() < 0.2 else [0.0])))
                t += d
            cycle = max(b[1] for b in body) - body[0][0]
            for k in range(rng.randint(1, 7)):
                for s, e, easing, a, b in body:
                    fault = rng.random() < 0.02
                    out.append((o, seq, kind, s + k * cycle + rng.choice([0, 0.005]), None if fault else e + k * cycle, easing, a, b, f"n{seq}"))
                    seq += 1
            t += 10 * cycle
    rng.shuffle(out)
    return out


def test_commands_are_exchanged_once(spark):
    plan = queries.QUERIES["command_loops"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert plan.index("Generate") < plan.index("Exchange")  # a line item is exchanged, not each of its commands


@pytest.mark.parametrize("chunk", [5, 1 << 14])
def test_both_ways_agree(spark, monkeypatch, small_batches, chunk):
    monkeypatch.setattr(loops, "CHUNK", chunk)
    df = spark.createDataFrame(scripts(3), COLUMNS).cache()
    few = rows(loops.extract_command_loops(df))
    monkeypatch.setattr(loops, "HELD", 0)
    many = rows(loops.extract_command_loops(df))
    monkeypatch.setattr(loops, "HELD", 20)
    assert few == many == rows(loops.extract_command_loops(df))
    assert sum("'Loop'" in r for r in few) > 20


def test_an_object_without_a_key_has_loops(spark):
    data = [(None, i, "Fade", 2.0 * i, 2.0 * i + 2, 0, 0.0, 1.0, "n") for i in range(4)]
    got = loops.extract_command_loops(spark.createDataFrame(data, COLUMNS)).collect()
    assert sorted((r.kind, r["count"]) for r in got) == [("Fade", None), ("Loop", 4)]


def test_rows_are_unpacked_where_they_met(spark):
    packed = spark.createDataFrame([(1, 10 * i, 4.0 * i) for i in (2, 0, 1)], "object int, seq int, t double")

    def unpack(r):
        r = r.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
        start = F.col("t") + 2 * F.col("i")
        return r.select("object", (F.col("seq") + F.col("i")).alias("seq"), F.lit("Fade").alias("kind"), start.alias("start"), (start + 2).alias("end"), F.lit(0).alias("easing"), F.col("i").cast("double").alias("v_start"), F.lit(0.5).alias("v_end"))

    got = loops.extract_command_loops(packed, unpack=unpack)
    assert rows(got) == rows(loops.extract_command_loops(unpack(packed))) and [r["count"] for r in got.where("kind = 'Loop'").collect()] == [3]
