"""What a storyboard holds, and what making it took.

Objects are rows (doc, z, type, layer, ..), commands rows (doc, object, seq, parent, kind, ..) with loops, triggers and their
children as rows of their own; object is the z of the object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds that may stand in a trigger
IN_TRIGGERS = ("Fade", "Colour", "Additive")


def with_commands(objects: DataFrame, commands: DataFrame) -> DataFrame:
    """the objects with a command that is no trigger, directly below them."""
    direct = commands.where((F.col("kind") != "Trigger") & (F.col("depth") == 1)).select("doc", F.col("object").alias("z"))
    return objects.join(direct, ["doc", "z"], "left_semi")


def pass_through(objects: DataFrame) -> DataFrame:
    """Sprites and animations as they go to the output: places in single precision, and of an animation only its frames' fields."""
    animated = F.col("type") == "Animation"
    own = {c: F.when(animated, F.col(c)) for c in ("frame_count", "frame_delay", "loop_type")}
    return objects.where(F.col("type").isin("Sprite", "Animation")).withColumns({**own, "x": F.col("x").cast("float"), "y": F.col("y").cast("float")})


def document_counts(objects: DataFrame, commands: DataFrame) -> DataFrame:
    """A2, A3: doc, sprites, animations and commands; loops and triggers count, and so do their children."""
    kinds = objects.groupBy("doc").agg(F.count_if(F.col("type") == "Sprite").alias("sprites"), F.count_if(F.col("type") == "Animation").alias("animations"))
    return kinds.join(commands.groupBy("doc").agg(F.count("*").alias("commands")), "doc", "left").fillna(0, ["commands"])


def layer_counts(objects: DataFrame) -> DataFrame:
    """A16"""
    return objects.groupBy("doc", "layer").agg(F.count("*").alias("objects"))


def naive_bytes(samples: DataFrame, frames: Column) -> DataFrame:
    """Doc and the bytes of storing each of ``frames`` frames as an image, from the mean of some (doc, bytes)."""
    return samples.groupBy("doc").agg((F.coalesce(F.avg("bytes"), F.lit(0.0)) * F.first(frames)).cast("long").alias("naive_bytes"))


def encode_statistics(counts: DataFrame, assets: DataFrame, naive: DataFrame) -> DataFrame:
    """Per doc (width, height, frames and the counts) the bytes of raw frames, of stored assets (doc, bytes), of one image a frame."""
    stored = assets.groupBy("doc").agg(F.count("*").alias("assets"), F.sum("bytes").alias("asset_bytes"))
    raw = F.col("width").cast("long") * F.col("height") * 3 * F.col("frames")
    return counts.withColumn("raw_bytes", raw).join(stored, "doc", "left").join(naive, "doc", "left").fillna(0, ["assets", "asset_bytes", "naive_bytes"])


def stage_shares(times: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys and stage (ms of each probe) the sum, its share of all stages, and the longest probe."""
    sums = times.groupBy(*keys, "stage").agg(F.sum("ms").alias("total"), F.max("ms").alias("longest"))
    every = F.sum("total").over(Window.partitionBy(*keys))  # as many rows as there are stages
    return sums.withColumn("share", F.col("total") / F.nullif(every, F.lit(0)))


def valid_triggers(commands: DataFrame) -> DataFrame:
    """the commands; a child of a trigger that isn't one of IN_TRIGGERS raises an error."""
    triggers = commands.where("kind = 'Trigger'").select("doc", F.col("seq").alias("parent"), F.lit(True).alias("__t"))
    child = F.col("__t").isNotNull() & ~F.col("kind").isin(*IN_TRIGGERS)
    checked = commands.join(triggers, ["doc", "parent"], "left").where(F.when(child, F.raise_error(F.concat(F.lit("not allowed in a trigger: "), F.col("kind"))).cast("boolean")).otherwise(F.lit(True)))
    return checked.select(commands.columns)


def json_report(statistics: DataFrame, keys: list[str]) -> DataFrame:
    """K5: keys and report, the other columns as JSON text."""
    return statistics.select(*keys, F.to_json(F.struct(*[c for c in statistics.columns if c not in keys])).alias("report"))
