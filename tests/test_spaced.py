"""Accepted starts against a fold in order."""

import random

import pytest
from pyspark.sql import functions as F

from runloom.operators import bursts


@pytest.mark.parametrize("block", [1, 3, 64])
def test_spaced_starts_equal_a_fold(spark, monkeypatch, block):
    monkeypatch.setattr(bursts, "BLOCK", block)
    rng = random.Random(block)
    series = {k: [float(rng.choice([rng.randint(0, 300), rng.randint(0, 20), rng.randint(-5000, 90000)])) for _ in range(rng.choice([1, 2, 40, 200]))] for k in range(6)}
    rows = [(k, t) for k, ts in series.items() for t in ts] + [(9, None), (0, None)]
    got = sorted((r.k, r.cut) for r in bursts.spaced_starts(spark.createDataFrame(rows, "k int, t double"), ["k"], "t", 10.0).where("cut is not null").collect())
    want = []
    for k, ts in series.items():
        last = None
        for t in sorted(ts):
            if last is None or t - last >= 10:
                want.append((k, t))
                last = t
    assert got == sorted(want)
    assert bursts.spaced_starts(spark.createDataFrame(rows, "k int, t double"), ["k"], "t", 10.0).where(F.col("cut").isNull()).collect()[0].k == 9
