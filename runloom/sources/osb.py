"""The .osb text form: an events section, layers in a fixed order, objects with commands only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import LAYERS, layer_ordinal
from ..operators.document import with_commands
from . import storyboard

# Fixed lines of the format: layer, place, line.
FRAME = [
    (-1, 0, "[Events]"), (-1, 1, "//Background and Video events"),
    *[(k, -1, f"//Storyboard Layer {k} ({name})") for k, name in enumerate(LAYERS)],
    (len(LAYERS), 0, "//Storyboard Sound Samples"),
]


def write(objects: DataFrame, commands: DataFrame) -> DataFrame:
    """doc and its text.  Objects stand by layer, then by z; those with no command, or only triggers, are left out.

    ``objects`` has what storyboard.objects() gives, ``commands`` what storyboard.commands() gives.
    """
    kept = with_commands(objects, commands).withColumn("__at", F.struct("doc", layer_ordinal(F.col("layer")).alias("layer"), F.col("z").cast("double").alias("z")))
    head = storyboard.object_lines(kept.withColumn("doc", F.col("__at")).withColumn("z", F.lit(-1)))
    own = commands.join(kept.select("doc", F.col("z").alias("object"), "__at"), ["doc", "object"]).withColumn("doc", F.col("__at"))
    body = storyboard.command_lines(own, shorthand=True)
    lines = head.unionByName(body).select("doc.doc", F.struct("doc.layer", "doc.z", "seq").alias("seq"), "line")
    frame = F.array(*[F.struct(F.struct(F.lit(k).cast("int").alias("layer"), F.lit(float(z)).alias("z"), F.lit(0.0).alias("seq")).alias("seq"), F.lit(x).alias("line")) for k, z, x in FRAME])
    around = objects.select("doc").distinct().select("doc", F.inline(frame))
    return storyboard.documents(lines.select("doc", F.struct(F.col("seq.layer").cast("int").alias("layer"), F.col("seq.z").alias("z"), F.col("seq.seq").alias("seq")).alias("seq"), "line").unionByName(around))


# Fixed numbers of the format: of events that are objects, of origins and loop types; layers count from 0.
OBJECTS = {"4": "Sprite", "6": "Animation"}
ORIGIN_NUMBERS = ("TopLeft", "Centre", "CentreLeft", "TopRight", "BottomCentre", "TopCentre", "Custom", "CentreRight", "BottomLeft", "BottomRight")
LOOPS = ("LoopForever", "LoopOnce")


def _named(field: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])[field], field)


def events(files: DataFrame) -> DataFrame:
    """doc, line_no and line of the sprites and animations of files (doc, value), with what is below them.

    Only the events section counts; names of the variables section are put in.  Backgrounds, videos, breaks, colours and samples, and
    what stands below one, are passed over.  Numbers for types, layers, origins and loop types become names; an animation without
    a loop type loops forever.
    """
    lines = storyboard.split_lines(files).where(F.trim("line") != "")
    upto = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.startswith(F.ltrim("line"), F.lit("[")), F.lower(F.trim("line")))
    lines = lines.withColumn("header", header).withColumn("section", F.last("header", True).over(upto)).where("header is null")
    pair = F.split(F.ltrim("line"), "=", 2)
    variable = (F.col("section") == "[variables]") & F.startswith(F.ltrim("line"), F.lit("$")) & F.contains("line", F.lit("="))
    # a longer name may begin with a shorter one
    given = F.collect_list(F.when(variable, F.struct((-F.length(pair[0])).alias("order"), pair[0].alias("name"), pair[1].alias("value")))).over(Window.partitionBy("doc"))
    own = lines.withColumn("given", given).where("section is null or section = '[events]'").where(~F.startswith(F.ltrim("line"), F.lit("//")))
    put = F.aggregate(F.sort_array("given"), F.col("line"), lambda line, v: F.replace(line, v["name"], v["value"]))
    own = own.withColumn("line", F.when(F.size("given") > 0, put).otherwise(F.col("line"))).drop("given", "header", "section")
    top = ~F.col("line").rlike("^[ _]")
    own = own.withColumn("f", F.when(top, storyboard.split_fields(F.trim("line"))))
    at = lambda i: F.get("f", F.lit(i))
    name = _named(at(0), OBJECTS)
    own = own.withColumn("is_object", F.when(top, name.isin(*OBJECTS.values()))).withColumn("kept", F.last("is_object", True).over(upto)).where("coalesce(kept, true)")
    numbers = lambda names: {str(i): n for i, n in enumerate(names)}
    head = [name, _named(at(1), numbers(LAYERS)), _named(at(2), numbers(ORIGIN_NUMBERS)), F.concat(F.lit('"'), at(3), F.lit('"')), at(4), at(5)]
    loop = F.when(name == "Animation", _named(F.coalesce(at(8), F.lit(LOOPS[0])), numbers(LOOPS)))
    line = F.concat_ws(",", *head, at(6), at(7), loop)
    return own.select("doc", "line_no", F.when(F.col("is_object"), line).otherwise(F.col("line")).alias("line"))


def read(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects and commands of files (doc, value); a wrong line raises with its number.

    Objects have layer_ord, by which and z they are drawn.  Commands have place: plain ones, then loops, then triggers, each in
    the file's order.
    """
    parsed = storyboard.checked(storyboard.parse(events(files)))
    group = F.when(F.col("kind") == "Loop", 1).when(F.col("kind") == "Trigger", 2).otherwise(0)
    objects = storyboard.objects(parsed).withColumn("layer_ord", layer_ordinal(F.col("layer")))
    return objects, storyboard.commands(parsed).withColumn("place", F.struct(group.alias("group"), "seq"))
