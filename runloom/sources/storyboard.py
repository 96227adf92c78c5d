"""The indented text form of a storyboard, to and from tables.

A file is an ordered list of objects; a line at depth d (leading spaces or underscores) belongs to the last line at depth
d - 1, which must be an object, loop or trigger.  Lines are parsed with column expressions; only the links between lines
need the order of a file, taken by windows over one file's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import LAYERS, ORIGINS, format_number, format_time

MAX_DEPTH = 8
# Fixed letters of commands and flags.
SCALARS = {"F": "Fade", "MX": "MoveX", "MY": "MoveY", "S": "Scale", "R": "Rotate"}
VECTORS = {"M": ("MoveX", "MoveY"), "V": ("VectorScaleX", "VectorScaleY")}
FLAGS = {"H": "FlipH", "V": "FlipV", "A": "Additive"}
HEADERS = {"Sprite": (6, 6), "Animation": (9, 9), "AnimationVideo": (7, 10)}
ARITY = {"T": (4, 5), "L": (3, 3), **dict.fromkeys(SCALARS, (5, 6)), **dict.fromkeys(VECTORS, (6, 8)), "C": (7, 10), "P": (5, 5)}
#: Numbers of fields between least and most that a type can't have
UNEVEN = {**dict.fromkeys(VECTORS, (7,)), "C": (8, 9)}
LOOP_TYPES = ("LoopForever", "LoopOnce")
TIMED = [(1, "integer"), (2, "number"), (3, "number?")]
#: By type: the field and what it must be; with ? it can be empty
TYPED = {
    "Sprite": [(1, "layer"), (2, "origin"), (4, "number"), (5, "number")],
    "Animation": [(1, "layer"), (2, "origin"), (4, "number"), (5, "number"), (6, "integer"), (7, "number"), (8, "loop type")],
    "AnimationVideo": [(1, "layer"), (2, "origin"), (4, "number"), (5, "number"), *((i, "number?") for i in range(6, 10))],
    **{k: [*TIMED, *((i, "number") for i in range(4, ARITY[k][1]))] for k in (*SCALARS, *VECTORS)},
    "C": [*TIMED, *((i, "byte") for i in range(4, 10))], "P": [*TIMED, (4, "flag")], "L": [(1, "number"), (2, "integer")], "T": [(2, "number"), (3, "number"), (4, "integer?")],
}


def split_fields(line: Column) -> Column:
    """Fields between commas outside quotes, quotes stripped; an open quote runs to the end."""
    quoted = F.transform(F.regexp_extract_all(line, F.lit(r'(?:^|,)((?:"[^"]*(?:"|$)|[^,"])*)'), 1), lambda f: F.replace(f, F.lit('"'), F.lit("")))
    return F.when(F.contains(line, F.lit('"')) | F.startswith(line, F.lit(",")), quoted).otherwise(F.split(line, ","))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """doc, line_no and line of text files."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), "value")
    return split_lines(files)


def split_lines(files: DataFrame) -> DataFrame:
    return files.select("doc", F.posexplode(F.split("value", "\r?\n"))).select("doc", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))


def _is(kind: str, field: Column) -> Column:
    names = {"layer": LAYERS, "origin": tuple(ORIGINS), "loop type": LOOP_TYPES, "flag": tuple(FLAGS)}
    if kind in names:
        return field.isin(*names[kind])
    value = field.try_cast("double" if kind == "number" else "int")
    return F.coalesce(value.between(0, 255), F.lit(False)) if kind == "byte" else value.isNotNull()


def misfit(type_: Column, fields: Column) -> Column:
    """What is wrong with the first field that isn't what its place asks for; null if none is. Fields left out don't count."""

    def wrong(i: int, kind: str) -> Column:
        name = kind.rstrip("?")
        field = F.get(fields, F.lit(i))
        asked = field.isNotNull() & (field != "") if kind.endswith("?") else field.isNotNull()
        return F.when(asked & ~_is(name, field), F.concat(F.lit(f"expected {name}, got \""), field, F.lit('"')))

    found = F.lit(None).cast("string")
    for name, places in TYPED.items():
        found = F.when(type_ == name, F.coalesce(*[wrong(*x) for x in places])).otherwise(found)
    return found


def parse(lines: DataFrame) -> DataFrame:
    """doc, line_no, depth, object (its line), parent (its line), fields and error of each line that isn't blank or a comment."""
    indent = F.regexp_extract("line", r"^([ _]*)", 1)
    body = F.regexp_replace("line", r"^[ _]+|[ _]+$", "")
    rows = lines.withColumns({"indent": indent, "depth": F.length(indent), "body": body}).where("body != '' and not startswith(body, '//')")
    before = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.array(*[F.last(F.when(F.col("depth") <= k, F.struct("line_no", "depth", F.substring_index("body", ",", 1).alias("type"))), True).over(before) for k in range(MAX_DEPTH)])
    parent = F.get(opened, F.col("depth") - 1)
    fields = rows.withColumns({"parent_line": F.when(F.col("depth") > 0, parent), "object": F.last(F.when(F.col("depth") == 0, F.col("line_no")), True).over(upto), "fields": split_fields(F.col("body"))})
    type_ = F.get("fields", F.lit(0))
    allowed = {**HEADERS, **ARITY}
    least, most = (F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.lit(v[i]))]) for i in (0, 1))
    wrong = (
        F.when((F.col("depth") > 0) & (F.col("parent_line").isNull() | (F.col("parent_line.depth") != F.col("depth") - 1) | ((F.col("depth") > 1) & ~F.col("parent_line.type").isin("L", "T"))), "no open block at this depth")
        .when(F.col("depth") >= MAX_DEPTH, "nested too deep")
        .when(F.when(F.col("depth") == 0, ~type_.isin(*HEADERS)).otherwise(~type_.isin(*ARITY)), "unknown type")
        .when((F.size("fields") < least[type_]) | (F.size("fields") > most[type_]), "wrong number of fields")
        .when(F.array_contains(F.create_map(*[x for k, v in UNEVEN.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[type_], F.size("fields")), "wrong number of fields")
        .otherwise(misfit(type_, F.col("fields")))
    )
    # depth leaves as a value of its own: a filter on it must not be put in its place inside the checks
    return fields.select("doc", "line_no", F.length("indent").alias("depth"), "object", F.col("parent_line.line_no").alias("parent"), type_.alias("type"), "fields", wrong.alias("error"))


def checked(parsed: DataFrame) -> DataFrame:
    """The parsed lines; the first wrong one raises an error with its number."""
    message = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), F.col("error"))
    return parsed.where(F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop("error")


def _number(i: int, kind: str = "double") -> Column:
    return F.get("fields", F.lit(i)).try_cast(kind)


def objects(parsed: DataFrame) -> DataFrame:
    """One row per object; z is its line."""
    f = [F.nullif(F.get("fields", F.lit(i)), F.lit("")) for i in range(10)]
    animation, video = F.col("type") == "Animation", F.col("type") == "AnimationVideo"
    return parsed.where("depth = 0").select(
        "doc", F.col("line_no").alias("z"), "type", f[1].alias("layer"), f[2].alias("origin"), f[3].alias("path"), _number(4).alias("x"), _number(5).alias("y"),
        F.when(animation, _number(6, "int")).alias("frame_count"), F.when(animation, _number(7)).alias("frame_delay"), F.when(animation, f[8]).alias("loop_type"),
        F.when(video, _number(6)).alias("start"), F.when(video, _number(7)).alias("fps"), F.when(video, _number(8)).alias("video_start"), F.when(video, _number(9)).alias("video_end"),
    )


def commands(parsed: DataFrame) -> DataFrame:
    """Doc, object, parent, seq, kind, easing, start, end, v_start, v_end, and what only some kinds have.

    M and V give two rows each (seq differs by a half); a blank end time is the start, missing end values are the start values.
    """
    rows = parsed.where("depth > 0")
    start = F.when(F.col("type").isin("L"), _number(1)).otherwise(_number(2))
    end = F.when(F.col("type") == "L", start).when(F.get("fields", F.lit(3)) == "", start).otherwise(_number(3))
    rows = rows.withColumns({"start": start, "end": end, "easing": F.when(~F.col("type").isin("L", "T"), _number(1, "int"))})

    def part(kind: Column | str, a: Column, b: Column, half: float = 0.0) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), a.cast("float").alias("v_start"), F.coalesce(b, a).cast("float").alias("v_end"), F.lit(half).alias("half"))

    none = F.lit(None)
    flags = F.create_map(*[x for k, v in FLAGS.items() for x in (F.lit(k), F.lit(v))])
    made = F.when(F.col("type") == "L", F.array(part("Loop", none, none))).when(F.col("type") == "T", F.array(part("Trigger", none, none))).when(F.col("type") == "C", F.array(part("Colour", none, none)))
    made = made.when(F.col("type") == "P", F.array(part(flags[F.get("fields", F.lit(4))], none, none)))
    for letter, (x, y) in VECTORS.items():
        made = made.when(F.col("type") == letter, F.array(part(x, _number(4), _number(6)), part(y, _number(5), _number(7), 0.5)))
    for letter, name in SCALARS.items():
        made = made.when(F.col("type") == letter, F.array(part(name, _number(4), _number(5))))
    rgb = [F.struct(*[_number(i, "int").alias(c) for i, c in zip(range(at, at + 3), "rgb", strict=True)]) for at in (4, 7)]
    colour = F.col("type") == "C"
    return rows.withColumn("m", F.explode(made)).select(
        "doc", "object", "parent", (F.col("line_no") + F.col("m.half")).alias("seq"), "depth", "m.kind", "easing", "start", "end", "m.v_start", "m.v_end",
        F.when(colour, rgb[0]).alias("c_start"), F.when(colour, F.when(F.size("fields") > 7, rgb[1]).otherwise(rgb[0])).alias("c_end"),
        F.when(F.col("type") == "L", _number(2, "int")).alias("count"), F.when(F.col("type") == "T", F.get("fields", F.lit(1))).alias("trigger"), F.when(F.col("type") == "T", F.coalesce(_number(4, "int"), F.lit(0))).alias("group"),
    )


def value_text(values: list[Column], ends: list[Column], shorthand: bool) -> Column:
    """Values and end values; with ``shorthand`` the end values are left out if they read the same."""
    a, b = F.concat_ws(",", *[format_number(v) for v in values]), F.concat_ws(",", *[format_number(v) for v in ends])
    return F.when(a == b, a).otherwise(F.concat_ws(",", a, b)) if shorthand else F.concat_ws(",", a, b)


def command_lines(rows: DataFrame, shorthand: bool = False) -> DataFrame:
    """Doc, seq and line of each command, X and Y rows of equal span and easing in one.

    Depth is the command's own, so a loop within a loop keeps its place.
    """
    axis = F.when(F.col("kind").isin("MoveX", "MoveY"), "M").when(F.col("kind").isin("VectorScaleX", "VectorScaleY"), "V")
    rows = rows.withColumn("axis", axis)
    same = ["doc", "object", "parent", "axis", "start", "end", "easing"]
    by = Window.partitionBy(*same, "kind").orderBy("seq")
    paired = rows.where("axis is not null").withColumn("place", F.row_number().over(by))
    both = paired.groupBy(*same, "depth", "place").agg(
        F.min_by("kind", "seq").alias("kind"), F.min("seq").alias("seq"), F.count("*").alias("n"),
        *[F.max(F.when(F.endswith("kind", F.lit(a)), F.col(c))).alias(f"{c}_{a.lower()}") for a in "XY" for c in ("v_start", "v_end")],
    )
    from_, upto = format_time(F.col("start")), format_time(F.col("end"))
    until = F.when(from_ == upto, "").otherwise(upto) if shorthand else upto
    head = F.concat_ws(",", F.col("easing").cast("string"), from_, until)
    letters = F.create_map(*[x for k, v in SCALARS.items() for x in (F.lit(v), F.lit(k))])
    flag_letters = F.create_map(*[x for k, v in FLAGS.items() for x in (F.lit(v), F.lit(k))])
    x = [F.col(c) for c in ("v_start_x", "v_end_x", "v_start_y", "v_end_y")]
    vector = F.when(F.col("n") == 2, F.concat_ws(",", "axis", head, value_text([x[0], x[2]], [x[1], x[3]], shorthand)))
    alone = F.when(F.col("axis") == "M", F.concat_ws(",", letters[F.col("kind")], head, value_text([F.coalesce(x[0], x[2])], [F.coalesce(x[1], x[3])], shorthand)))
    vector = F.coalesce(vector, alone, F.raise_error(F.lit("a vector scale without its other axis")).cast("string"))
    colours = [[F.col(f"{c}.{k}") for k in "rgb"] for c in ("c_start", "c_end")]
    other = (
        F.when(F.col("kind") == "Loop", F.concat_ws(",", F.lit("L"), from_, F.col("count").cast("string")))
        .when(F.col("kind") == "Trigger", F.concat_ws(",", F.lit("T"), "trigger", from_, upto, F.col("group").cast("string")))
        .when(F.col("kind") == "Colour", F.concat_ws(",", F.lit("C"), head, value_text(colours[0], colours[1], shorthand)))
        .when(flag_letters[F.col("kind")].isNotNull(), F.concat_ws(",", F.lit("P"), head, flag_letters[F.col("kind")]))
        .otherwise(F.concat_ws(",", letters[F.col("kind")], head, value_text([F.col("v_start")], [F.col("v_end")], shorthand)))
    )
    depth = F.repeat(F.lit(" "), F.col("depth"))
    return both.select("doc", "seq", F.concat(depth, vector).alias("line")).unionByName(rows.where("axis is null").select("doc", "seq", F.concat(depth, other).alias("line")))


def object_lines(rows: DataFrame) -> DataFrame:
    """The header lines; fields left out in the middle stay as empty fields."""
    n = format_number
    base = [F.col("type"), F.col("layer"), F.col("origin"), F.concat(F.lit('"'), "path", F.lit('"')), n(F.col("x")), n(F.col("y"))]
    animation = F.concat_ws(",", *base, F.col("frame_count").cast("string"), n(F.col("frame_delay")), "loop_type")
    tail = [F.coalesce(n(F.col(c)), F.lit("")) for c in ("start", "fps", "video_start", "video_end")]
    video = F.regexp_replace(F.concat_ws(",", *base, *tail), ",+$", "")
    line = F.when(F.col("type") == "Animation", animation).when(F.col("type") == "AnimationVideo", video).otherwise(F.concat_ws(",", *base))
    return rows.select("doc", F.col("z").cast("double").alias("seq"), line.alias("line"))


def documents(lines: DataFrame) -> DataFrame:
    """doc and its text, lines by seq."""
    whole = F.transform(F.sort_array(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"])
    return lines.groupBy("doc").agg(F.concat(F.array_join(whole, "\n"), F.lit("\n")).alias("value"))


def validate(written: DataFrame, rows: DataFrame) -> DataFrame:
    """K6: doc, and whether as many objects are read back as were written."""
    back = objects(parse(split_lines(written))).groupBy("doc").agg(F.count("*").alias("read_back"))
    return rows.groupBy("doc").agg(F.count("*").alias("objects")).join(back, "doc", "left").withColumn("valid", F.col("objects") == F.coalesce("read_back", F.lit(0)))
