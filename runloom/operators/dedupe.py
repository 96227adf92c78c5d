"""Content-addressed assets."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .folds import fold_sorted


def assign_assets(items: DataFrame, key: list[Column], content: Column, order: str, size: Column) -> DataFrame:
    """One row per asset: asset_key, the first item that has it, its uses and its size.

    ``key`` holds what keeps equal bytes apart (consumer, palette, width and height).
    """
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in key], F.coalesce(content, F.lit(""))), 256)
    return items.select(digest.alias("asset_key"), F.col(order).alias("item"), size.alias("size")).groupBy("asset_key").agg(
        F.min("item").alias("first_item"), F.count("*").alias("uses"), F.min_by("size", "item").alias("size")
    )


def new_assets(assets: DataFrame, stored: DataFrame) -> DataFrame:
    """D3: the assets whose key isn't stored yet."""
    return assets.join(stored.select("asset_key").distinct(), "asset_key", "left_anti")


def assign_sequences(rows: DataFrame, keys: list[str], order: str, content: Column) -> DataFrame:
    """Keys with the digest of their ordered contents, the first key that has it, and how many have it.

    The digest is fed content by content, so a key's contents are never together.
    """

    def run(state: tuple | None, piece: dict[str, list]) -> tuple[list[tuple], tuple]:
        digest, n = state or (hashlib.sha256(), 0)
        for c in piece["c"]:
            digest.update(b"\x1f" * (n > 0) + c.encode())
            n += 1
        return [], (digest, n)

    parts = rows.select(*keys, F.col(order).alias("at"), F.coalesce(content, F.lit("")).cast("string").alias("c"))
    sequences = cut(fold_sorted(parts, keys, ["at", "c"], run, lambda state: [(state[0].hexdigest(), state[1])], {"sequence_key": "string", "frames": "long"}))
    firsts = sequences.groupBy("sequence_key").agg(F.min(F.struct(*keys)).alias("first"), F.count("*").alias("uses"))
    return sequences.join(firsts, "sequence_key").select(*keys, "sequence_key", "frames", "uses", *[F.col(f"first.{k}").alias(f"first_{k}") for k in keys])


def totals(assets: DataFrame) -> DataFrame:
    """Files and bytes stored."""
    return assets.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
