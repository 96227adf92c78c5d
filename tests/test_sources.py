"""Storyboard text and raw frames, to tables and back; streams against batches."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.operators import runs
from runloom.sources import frames, storyboard
from runloom.streaming.runs import stream_bursts, stream_runs

SAMPLE = """Sprite,Overlay,TopLeft,"sky.png",12.5,-4
 R,3,10,900,0,1.5
 V,1,0,250,1,2,0.5,0.25
Animation,Pass,Centre,"walk.png",64,32,6,40,LoopForever
 F,0,5,5,1,1
 L,100,4
  MX,2,0,50,0,8
  L,50,2
   M,0,0,20,1,2,3,4
Sprite,Fail,BottomRight,"a,b.png",0,0
 P,0,0,700,V
 T,Passing,0,600,2
  C,0,0,90,255,0,10,0,255,20
AnimationVideo,Background,Centre,"clip.bin",320,240,1500,24
"""


def parsed(spark, text):
    return storyboard.parse(storyboard.split_lines(spark.createDataFrame([("d", text)], "doc string, value string")))


def test_round_trip(spark):
    p = storyboard.checked(parsed(spark, SAMPLE))
    o, c = storyboard.objects(p), storyboard.commands(p)
    assert [r.type for r in o.orderBy("z").collect()] == ["Sprite", "Animation", "Sprite", "AnimationVideo"]
    assert c.count() == 12
    written = storyboard.documents(storyboard.object_lines(o).unionByName(storyboard.command_lines(c)))
    assert written.first().value == SAMPLE
    assert storyboard.validate(written, o).first().valid


def test_read_from_a_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("// note\n\n" + SAMPLE)
    assert storyboard.objects(storyboard.parse(storyboard.read_text(spark, str(tmp_path)))).count() == 4


@pytest.mark.parametrize(
    "line, want",
    [("F,0,1000,,0.5", "F,0,1000,,0.5"), ("F,0,0,1000,0,0.5", "F,0,0,1000,0,0.5"), ("S,0,0,1000,2,2", "S,0,0,1000,2"), ("V,0,0,1000,1,2", "V,0,0,1000,1,2"), ("V,0,0,1000,1,2,1,3", "V,0,0,1000,1,2,1,3"), ("C,0,0,1000,255,255,255", "C,0,0,1000,255,255,255"), ("P,0,0,1000,A", "P,0,0,1000,A"), ("MX,0,0,10,1,2", "MX,0,0,10,1,2")],
)
def test_shorthand(spark, line, want):
    c = storyboard.commands(storyboard.checked(parsed(spark, f'Sprite,Background,Centre,"a",0,0\n {line}\n')))
    assert [r.line for r in storyboard.command_lines(c, shorthand=True).collect()] == [" " + want]


@pytest.mark.parametrize("text", [" F,0,0,1,0,1", "Sprite,a,b,c", "Sprite,Background,Centre,\"a\",0,0\n  F,0,0,1,0,1", "Sprite,Background,Centre,\"a\",0,0\n F,0", "Nothing,1,2"])
def test_errors_carry_the_line(spark, text):
    p = parsed(spark, text)
    assert p.where("error is not null").count() == 1
    with pytest.raises(Exception, match="line [12]: "):
        storyboard.checked(p).collect()


def test_fields(spark):
    split = lambda s: spark.range(1).select(storyboard.split_fields(F.lit(s))).first()[0]
    assert split('a,"b,c",,d') == ["a", "b,c", "", "d"] and split('a,"open, end') == ["a", "open, end"] and split("") == [""]


def test_raw_frames_and_tiles(spark, tmp_path):
    image = np.arange(3 * 2 * 5 * 3, dtype=np.uint8)
    (tmp_path / "v.rgb").write_bytes(image.tobytes() + b"xx")
    f = frames.read_raw(spark, str(tmp_path), 5, 2, 10.0)
    assert [(r.frame, r.ts) for r in f.orderBy("frame").collect()] == [(0, 0.0), (1, 100.0), (2, 200.0)]
    assert bytes(f.where("frame = 2").first().rgb) == image[60:].tobytes()
    assert frames.read_raw(spark, str(tmp_path), 5, 2, 10.0, start=0.1, duration=0.1).count() == 1
    t = frames.extract_tiles(f, 2)
    assert t.count() == 9 and {(r.x, r.w) for r in t.collect()} == {(0, 2), (2, 2), (4, 1)}


def test_stream_gives_the_batch_runs(spark, tmp_path):
    e = spark.createDataFrame([(k, 1000 + t, "ab"[(t // (k + 2)) % 2]) for k in range(3) for t in range(30)], "k long, t long, c string").withColumn("ts", F.timestamp_seconds("t"))
    e.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    marker = e.select(F.lit(99).cast("long").alias("k"), (F.lit(10_000).cast("long")).alias("t"), F.lit("z").alias("c"), F.timestamp_seconds(F.lit(10_000)).alias("ts")).limit(1)
    marker.write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_runs(source, "k", "ts", "c").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "out")).where("key < 99").select("key", F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"), "n", "content")
    want = runs.change_runs(e, ["k"], ["t"], "t", "c", F.lit(0)).select("k", "start", "end", "n", "content")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_stream_bursts_plan(spark, tmp_path):
    e = spark.createDataFrame([(t,) for t in (0, 100, 300, 900)], "ms long").select(F.lit(1).alias("k"), F.timestamp_millis("ms").alias("ts"))
    e.write.parquet(str(tmp_path / "b"))
    q = stream_bursts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "b")), "k", "ts", "300 milliseconds", "0 seconds").writeStream.format("memory").queryName("bursts_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("bursts_out").collect()) == [3]


def test_neighbouring_keys_share_a_call_but_not_a_timer(spark, tmp_path, monkeypatch):
    import time

    rows = [[(0, 1000, "a"), (1, 1000, "x"), (0, 1010, "b"), (70, 1005, "q")], [(1, 5000, "x")], [(1, 5010, "y"), (None, 5020, "z")], [(1, 9000, "y")]]
    for part in rows:
        e = spark.createDataFrame(part, "k long, t long, c string").withColumn("ts", F.timestamp_seconds("t"))
        e.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken by their time
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        closed = stream_runs(source, "k", "ts", "c")
        q = closed.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        assert q.exception() is None
        got = spark.read.schema(closed.schema).parquet(str(tmp_path / "out")).select("key", F.unix_seconds("start"), F.unix_seconds("end"), "n", "content").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    # key 0 falls silent while key 1 goes on; key 1's own run of x goes on as nothing had moved the watermark past its timer before
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(0, 1000, 1010, 1, "a"), (0, 1010, 1010, 1, "b"), (70, 1005, 1005, 1, "q"), (1, 1000, 5010, 2, "x"), (None, 5020, 5020, 1, "z")]))
