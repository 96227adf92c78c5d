"""The two stages of a stream against the same over a table."""

import random

import pytest
from pyspark.sql import functions as F

from runloom.operators import bursts, runs
from runloom.streaming.tiles import TileStages, stream_tiles

FRAME = 100


def made(seed: int) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for k in range(5):
        t = 1_000_000
        for _ in range(25):
            wide = rng.random() < 0.1
            n = rng.choice([1, 1, 1, 1, 1, 3])
            burst = rng.choice([1, 4, 9]) if not wide else 1
            for _ in range(burst):
                c = rng.choice("abcdefghijklmnop")
                rows += [(k, t + i * FRAME, c, wide) for i in range(n)]
                t += n * FRAME
            if rng.random() < 0.2:
                t += 500
    return rows


def of_table(spark, rows):
    df = spark.createDataFrame(rows, "key long, t long, content string, wide boolean")
    found = runs.change_runs(df.withColumn("both", F.struct("content", "wide")), ["key"], ["t"], "t", "both", F.lit(0))
    flat = found.select("key", "start", "end", F.col("content.content").alias("content"), F.col("content.wide").alias("wide"))
    single = F.abs(F.col("end") - F.col("start") - FRAME) <= 1
    return sorted((r.key, r.kind, r.start, r.end, r.n, tuple(r.contents)) for r in bursts.split_runs(flat, ["key"], single, F.col("wide"), cap=6).collect())


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_table(spark, tmp_path, files):
    rows = made(files)
    df = spark.createDataFrame(rows, "key long, t long, content string, wide boolean").withColumn("at", F.timestamp_millis("t"))
    edges = sorted({r[1] for r in rows})
    for i in range(files):  # later files have later rows, in any order within
        low, high = edges[i * len(edges) // files], edges[min(len(edges) - 1, (i + 1) * len(edges) // files)]
        part = df.where((F.col("t") >= low) & ((F.col("t") < high) | F.lit(i == files - 1)))
        part.orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for t in (10**8, 2 * 10**8):  # time goes on
        spark.createDataFrame([(99, t, "z", False)], "key long, t long, content string, wide boolean").withColumn("at", F.timestamp_millis("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stream_tiles(source, "key", "at", "content", "wide", single=FRAME, delay="1 second", timeout_ms=5000, cap=6)
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(300)
    assert q.exception() is None
    got = sorted((r.key, r.kind, r.start, r.end, r.n, tuple(r.contents)) for r in spark.read.parquet(str(tmp_path / "out")).where("key < 99").collect())
    want = of_table(spark, rows)
    assert got == want and {r[1] for r in want} == {"sprite", "animation"}


def test_second_stage_by_hand():
    stage = TileStages(0, 100, 1, 300, 4, 0.8)
    out: list = []
    pending: list = []
    for i, c in enumerate("abcd"):
        pending = stage.detect((i * 100, i * 100, c, False), (i + 1) * 100, pending, out)
    pending = stage.detect((400, 400, "w", True), 900, pending, out)  # a merged block doesn't end the burst
    pending = stage.detect((400, 600, "e", False), 700, pending, out)
    assert out == [("sprite", 400, 900, 1, ["w"]), ("animation", 0, 400, 4, ["a", "b", "c", "d"]), ("sprite", 400, 700, 1, ["e"])] and pending == []
