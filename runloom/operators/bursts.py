"""Bursts of short runs, change points, and the scenes between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def thrash_segments(runs: DataFrame, keys: list[str], single: Column, cap: int = 300, least: int = 4, unique: float = 0.8) -> DataFrame:
    """keys, first, last, n, distinct_contents, promoted of the chains of single-frame runs (start, end, content).

    A chain breaks at a run that isn't ``single`` and at a gap, and is cut every ``cap`` runs.  It is promoted with at
    least ``least`` runs of which the share ``unique`` has contents of its own.
    """
    by = Window.partitionBy(*keys).orderBy("start", "end")
    rows = runs.withColumn("single", single)
    breaks = ~F.coalesce(F.lag("single").over(by), F.lit(False)) | ~F.lag("end").over(by).eqNullSafe(F.col("start"))
    chained = rows.withColumn("chain", F.sum(F.when(~F.col("single") | breaks, 1).otherwise(0)).over(by)).where("single")
    place = F.row_number().over(Window.partitionBy(*keys, "chain").orderBy("start", "end")) - 1
    cut = chained.withColumn("part", F.floor(place / cap))
    out = cut.groupBy(*keys, "chain", "part").agg(
        F.min("start").alias("first"), F.max("end").alias("last"), F.count("*").alias("n"), F.count_distinct("content").alias("distinct_contents")
    )
    return out.select(*keys, "first", "last", "n", "distinct_contents", ((F.col("n") >= least) & (F.col("distinct_contents") >= unique * F.col("n"))).alias("promoted"))


def split_runs(runs: DataFrame, keys: list[str], single: Column, wide: Column, cap: int = 300, least: int = 4, unique: float = 0.8) -> DataFrame:
    """Keys, kind, start, end, n and contents: promoted chains of single-frame runs as one animation each, all other runs as sprites.

    Runs of merged blocks (``wide``) are sprites, and no part of a chain.  A chain has ``cap`` runs at most, so its contents are few.
    """
    rows = runs.withColumn("wide", wide)
    narrow = rows.where("not wide")
    by = Window.partitionBy(*keys).orderBy("start", "end")
    own = narrow.withColumn("single", single)
    breaks = ~F.coalesce(F.lag("single").over(by), F.lit(False)) | ~F.lag("end").over(by).eqNullSafe(F.col("start"))
    chained = own.withColumn("chain", F.sum(F.when(~F.col("single") | breaks, 1).otherwise(0)).over(by))
    place = F.row_number().over(Window.partitionBy(*keys, "chain").orderBy("start", "end")) - 1
    parts = chained.where("single").withColumn("part", F.floor(place / cap)).groupBy(*keys, "chain", "part").agg(F.array_sort(F.collect_list(F.struct("start", "end", "content"))).alias("runs"))
    contents = F.transform("runs", lambda r: r["content"])
    distinct = F.size(F.array_distinct(contents))
    parts = parts.withColumn("promoted", (F.size("runs") >= least) & (distinct >= unique * F.size("runs")))
    n = lambda x: F.lit(x).cast("long").alias("n")
    animations = parts.where("promoted").select(*keys, F.lit("animation").alias("kind"), F.get("runs", F.lit(0))["start"].alias("start"), F.element_at("runs", -1)["end"].alias("end"), F.size("runs").cast("long").alias("n"), contents.alias("contents"))
    short = parts.where("not promoted").select(*keys, F.lit("sprite").alias("kind"), F.explode("runs").alias("r")).select(*keys, "kind", "r.start", "r.end", n(1), F.array("r.content").alias("contents"))
    plain = chained.where("not single").select(*keys, "start", "end", "content").unionByName(rows.where("wide").select(*keys, "start", "end", "content"))
    return animations.unionByName(short).unionByName(plain.select(*keys, F.lit("sprite").alias("kind"), "start", "end", n(1), F.array("content").alias("contents")))


def burst_starts(moments: DataFrame, keys: list[str], time: str, gap: Column | float) -> DataFrame:
    """The first moment of each burst; a burst goes on while the next moment is at most ``gap`` after the last."""
    by = Window.partitionBy(*keys).orderBy(time)
    before = moments.withColumn("__p", F.lag(time).over(by))
    return before.where(F.col("__p").isNull() | (F.col(time) - F.col("__p") > gap)).drop("__p")


#: A block of moments is so many times the least distance long
BLOCK = 64


def next_starts(points: DataFrame, keys: list[str], least: float) -> DataFrame:
    """keys, t and next: of each distinct moment t the first moment of its key from t + least on; null if there is none.

    Moments and what they ask for meet in blocks of time; for what a block doesn't have, the first moment of the next block that
    has any is taken, so a key is windowed whole by one row a block only.
    """
    width = BLOCK * least
    block = lambda t: F.floor(t / width)
    t = F.col("t")
    held = points.select(*keys, t.alias("at"), F.lit(1).alias("held"), F.lit(None).cast("double").alias("t"), t.alias("moment"), block(t).alias("block"))
    asked = points.select(*keys, (t + least).alias("at"), F.lit(0).alias("held"), "t", F.lit(None).cast("double").alias("moment"), block(t + least).alias("block"))
    back = Window.partitionBy(*keys, "block").orderBy(F.desc("at"), F.desc("held"))
    met = held.unionByName(asked).withColumn("next", F.last("moment", ignorenulls=True).over(back)).where("held = 0")
    heads = points.groupBy(*keys, block(t).alias("block")).agg(F.min("t").alias("head"))
    heads = heads.select(*keys, "block", F.lead("head").over(Window.partitionBy(*keys).orderBy("block")).alias("after"))
    own = heads.select(*keys, "block", "after", F.lit(True).alias("has"))
    before = heads.select(*keys, F.col("block").alias("from"), F.col("after").alias("after_from"))
    found = met.withColumn("from", block(t)).join(own, [*keys, "block"], "left").join(before, [*keys, "from"])
    later = F.when(F.col("has"), F.col("after")).otherwise(F.col("after_from"))
    return found.select(*keys, "t", F.coalesce("next", later).alias("next"))


def spaced_starts(starts: DataFrame, keys: list[str], time: str, least: float) -> DataFrame:
    """Keys and each moment ``cut`` accepted in order, at least ``least`` (over 0) after the last accepted one.

    Each moment has one that would be accepted after it; accepted are those that the key's first leads to.  By pointer doubling: what
    is led to in under 2^k steps gives, by links of 2^k steps, what is led to in under 2^(k+1), in as many rounds as the longest chain
    has binary digits.  A key without moments has one row of null.
    """
    at = starts.select(*keys, F.col(time).cast("double").alias("t"))
    points = cut(at.where("t is not null").distinct())
    links = cut(next_starts(points, keys, least).where("next is not null"))
    firsts = at.groupBy(*keys).agg(F.min("t").alias("t"))
    led, n = cut(firsts), -1
    while (met := led.count()) != n:
        n = met
        new = led.join(links, [*keys, "t"]).select(*keys, F.col("next").alias("t"))
        led = cut(led.unionByName(new))
        second = links.select(*keys, F.col("t").alias("next"), F.col("next").alias("second"))
        links = cut(links.join(second, [*keys, "next"]).select(*keys, "t", F.col("second").alias("next")))
    return led.withColumnRenamed("t", "cut")


def spaced(starts: DataFrame, keys: list[str], time: str, least: float) -> DataFrame:
    """Keys and the array of the moments of spaced_starts(); for keys of few moments."""
    return spaced_starts(starts, keys, time, least).groupBy(*keys).agg(F.array_sort(F.collect_list("cut")).alias("cuts"))


def scenes_between(bounds: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """W11 for cuts in rows: from start and end, start before end, and the moments ``cut``, one row (scene, start, end) for each piece."""
    inside = cuts.join(bounds, keys).where("start < cut and cut < end").select(*keys, F.col("cut").alias("start"))
    edges = inside.distinct().unionByName(bounds.select(*keys, "start")).unionByName(bounds.select(*keys, F.col("end").alias("start")))
    by = Window.partitionBy(*keys).orderBy("start")
    return edges.select(*keys, (F.row_number().over(by) - 1).alias("scene"), "start", F.lead("start").over(by).alias("end")).where("end is not null")


def scenes(bounds: DataFrame, keys: list[str]) -> DataFrame:
    """From start, end and the array of cuts between them, one row (scene, start, end) for each piece."""
    inside = F.filter("cuts", lambda c: (c > F.col("start")) & (c < F.col("end")))
    edges = F.concat(F.array("start"), F.array_sort(F.array_distinct(inside)), F.array("end"))
    cut = bounds.select(*keys, edges.alias("edges")).select(*keys, "edges", F.posexplode(F.slice("edges", 1, F.size("edges") - 1)).alias("scene", "start"))
    return cut.select(*keys, "scene", "start", F.get("edges", F.col("scene") + 1).alias("end"))


def overlaps(members: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Members (start, end) cut to each scene (scene, start, end) of their key that they overlap."""
    s = spans.select(*keys, "scene", F.col("start").alias("s0"), F.col("end").alias("s1"))
    return (
        members.join(s, keys).where("start < s1 and s0 < end")
        .withColumns({"start": F.greatest("start", "s0"), "end": F.least("end", "s1")}).drop("s0", "s1")
    )
