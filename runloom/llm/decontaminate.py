"""Operator 3, benchmark decontamination, in DataFrame functions only: size-partitioned MinHash containment search.

Items and documents are sets of five-word shingles (words as in near-dedup; shorter texts are one shingle).  Items are
partitioned by the size of their set.  In a partition whose smallest set has n shingles and largest has N, an item that
a document contains by at least the threshold c misses at most floor((1 - c) N) of its shingles there, so one of its
floor((1 - c) N) + 1 least universal-hash values is among the document's: the minima are the item's sketch, and its lookup
in the documents' shingles has no false negatives, however long a document is.  Partitions are narrow (each a quarter wider
than the last), so sketches stay near the least size that is safe.  Candidate pairs are then verified by the exact
containment |item and document| / |item| on whole shingle sets.

Null and empty texts and items have no shingles and match nothing.  Repeated rows of one doc_id are one document, the
union of their sets; the same for items.  Texts of any length are whole sets.  Items of equal least values and pairs at the threshold all count.  An empty
table of documents or items gives no pair.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .url_filters import lower_ascii

WIDTH = 5
THRESHOLD = 0.75
#: Tables of sketches or item shingles up to this many rows (24 bytes each) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000
#: Names the hash function of the minima
SEED = 20240607


def words(text: Column) -> Column:
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles, repeats included."""

    def of(w: Column) -> Column:
        n = F.size(w)
        return (
            F.when(n >= WIDTH, F.transform(F.sequence(F.lit(1), F.greatest(n - (WIDTH - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, WIDTH))))
            .when(n > 0, F.array(F.xxhash64(w)))
            .otherwise(F.array().cast("array<bigint>"))
        )

    # bound to a lambda's variable, the words are made once and not for each shingle
    return F.get(F.transform(F.array(words(text)), of), 0)


def _maybe_broadcast(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def contamination(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_item, n_shared and containment of every pair at or over ``threshold``."""
    item_rows = items.select("item_id", F.explode(F.array_distinct(shingles(F.col("text")))).alias("shingle")).distinct()
    sizes = item_rows.groupBy("item_id").agg(F.count("*").alias("n_item"))
    # size partitions: the bounds of partition k are about 1.25^k
    part = F.floor(F.log(1.25, F.col("n_item")))
    widest = sizes.groupBy(part.alias("part")).agg(F.max("n_item").alias("widest"))
    sketch_size = sizes.withColumn("part", part).join(widest, "part").select("item_id", "n_item", (F.floor((1 - threshold) * F.col("widest") + 1e-9) + 1).alias("minima"))
    by_hash = Window.partitionBy("item_id").orderBy(F.xxhash64(F.lit(SEED), "shingle"), "shingle")
    keyed = item_rows.join(sketch_size, "item_id").withColumn("rank", F.row_number().over(by_hash))
    sketch = keyed.where("rank <= minima").select("shingle", "item_id")

    parts = docs.where("doc_id is not null").select("doc_id", F.explode(shingles(F.col("text"))).alias("shingle"))
    pairs = parts.join(_maybe_broadcast(sketch), "shingle").select("doc_id", "item_id").distinct()

    # exact containment of the candidates
    candidates = pairs.groupBy("doc_id").agg(F.collect_set("item_id").alias("item_ids"))
    found = (
        docs.select("doc_id", "text").join(candidates, "doc_id")
        .select("doc_id", "item_ids", F.explode(F.array_distinct(shingles(F.col("text")))).alias("shingle"))
        .join(_maybe_broadcast(item_rows), "shingle")
        .where("array_contains(item_ids, item_id)")
        .groupBy("doc_id", "item_id")
        .agg(F.count_distinct("shingle").alias("n_shared"))
    )
    return found.join(sizes, "item_id").select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment")).where(F.col("containment") >= threshold)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that contain no item."""
    return docs.join(contamination(docs, items, threshold).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
