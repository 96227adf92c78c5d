"""Connected components by alternating large-star and small-star, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: More rounds than any graph of 2^60 nodes needs
MAX_ROUNDS = 100
#: Edges to a task; rounds of a small graph don't run over all the session's partitions
TASK_EDGES = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that a row (a, b) of ``links`` names; component is the least node reachable.

    A round of large-star links each larger neighbour of u to the least node around u, a round of small-star each smaller
    neighbour and u itself; rounds end when the edges stay as they are, a star around each component's least node.
    Rows with a null end and self-links are ignored; repeats don't matter.
    """
    edges = cut(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        tasks = 2 + before[0] // TASK_EDGES
        edges = edges.coalesce(tasks)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").coalesce(tasks).distinct().coalesce(tasks)
        edges = cut(edges).coalesce(tasks)
        least = edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        around = edges.join(least, "u").coalesce(tasks)
        edges = cut(around.select(F.col("v").alias("u"), F.col("m").alias("v")).union(around.select("u", F.col("m").alias("v"))).where("u != v").coalesce(tasks).distinct().coalesce(tasks))
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
