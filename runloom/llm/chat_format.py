r"""Operator 2, chat formatting, in DataFrame functions only: prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, only its text is under the loss mask.
If a conversation doesn't end with an assistant turn, one more example without a target holds it whole, so that
nothing of it is lost.  A turn is written as ``### role: text </turn>\n``.  In texts and roles ``\``, ``#`` and ``<`` (in
roles ``:`` too) are written as ``\b``, ``\h``, ``\l`` (``\c``), so neither marker can occur in them, and back.

Null texts and roles are empty.  Turns go by turn number, nulls first, ties by role and text as they are written (escaped); equal rows
count each.  Rows with a null conv_id are one conversation.  Texts of any length are whole; an empty table gives no example.  Other columns
are not carried, whatever their names.  The work for one conversation grows with the
square of its turns, as every example holds its whole context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "### ", ": ", " </turn>\n"


def escape(c: Column) -> Column:
    for a, b in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in (("<", "\\l"), ("#", "\\h"), ("\\", "\\b")):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def chat_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start and loss_length (code points; null without a target), by conversation rows."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(OPEN), F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit(MID))
    turns = conversations.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), head.alias("head"), escape(text).alias("body")))).alias("turns")
    )
    size = F.size("turns")
    targets = F.filter(F.sequence(F.lit(1), size), lambda i: (F.get("turns", i - 1)["role"] == "assistant") | (i == size))
    examples = turns.select("conv_id", "turns", F.explode(targets).alias("example"))
    line = F.transform(F.slice("turns", F.lit(1), F.col("example") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE)))
    return (
        examples.select("conv_id", "example", F.get("turns", F.col("example") - 1).alias("last"), F.concat(F.array_join(line, ""), F.get("turns", F.col("example") - 1)["head"]).alias("context"))
        .select(
            "conv_id", "example", F.concat("context", "last.body", F.lit(CLOSE)).alias("text"),
            F.when(F.col("last.role") == "assistant", F.length("context")).alias("loss_start"),
            F.when(F.col("last.role") == "assistant", F.length("last.body")).alias("loss_length"),
        )
    )


def parse_turns(text: Column) -> Column:
    """The turns (role, text) that an example's text holds."""
    pieces = F.split(text, CLOSE, -1)
    return F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(
            unescape(F.replace(F.regexp_extract(p, r"(?s)^### ([^:]*): (.*)$", 1), F.lit("\\c"), F.lit(":"))).alias("role"),
            unescape(F.regexp_extract(p, r"(?s)^### ([^:]*): (.*)$", 2)).alias("text"),
        ),
    )


def loss_text(examples: DataFrame) -> DataFrame:
    """Adds loss, the unescaped text under the mask."""
    return examples.withColumn("loss", unescape(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_length"))))


def chat_digest(examples: DataFrame) -> DataFrame:
    """Per conversation, from its formatted examples alone: turns, text under the mask, and size."""
    turns = parse_turns(F.col("whole"))
    return (
        loss_text(examples)
        .groupBy("conv_id")
        .agg(
            F.max_by("text", "example").alias("whole"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "").alias("losses"),
            F.sum(F.length("text")).cast("long").alias("formatted_chars"),
        )
        .select("conv_id", turns.alias("turns"), "losses", "formatted_chars")
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("losses").cast("long").alias("loss_chars"),
            F.sha2("losses", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
