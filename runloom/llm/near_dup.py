"""Operator 5, MinHash near-dedup over five-word shingles.

1. Every text becomes its set of distinct shingles (64-bit hashes), a 128-bit digest of the set and ``HASHES`` universal
   hash minima.  Documents of equal sets are one class, named by its least doc_id, before anything is compared.
2. The minima are cut into ``BANDS`` bands; classes with an equal band share a bucket.  Each member is paired with the
   least member of its buckets, never with all of them.
3. Pairs are screened by signatures (far under the threshold: no link), then verified by the exact similarity of whole sets;
   texts travel for screened pairs only, a leader's once for many members.
4. Links become components by large-star and small-star.  Pairs with other leaders are verified only where they would still
   join two components; what they add is worked out on the graph of components.
5. Buckets that still hold several components are finished exactly: of their members, those that share a shingle of their
   rarest-first prefixes, at places where enough overlap remains, are verified too.  So no link is lost to leaders.

A link at the threshold of 0.75 shares no band with probability (1 - 0.75^4)^28 = 2e-5.

Texts without words (null, empty) are linked with nothing.  Rows with a null doc_id are linked with nothing and kept.  Rows that
repeat a doc_id stay rows, each with the component of its own text.  Ties go to the least doc_id.  Texts of any length are
whole sets.  An empty table gives none.  Columns of the input that have a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, discard, stash
from . import _bytes as B
from .components import components

WIDTH = 5
#: Similarity in hundredths at which two sets are linked
PERCENT = 75
ROWS, BANDS = 4, 28
HASHES = ROWS * BANDS
#: Signatures that agree in fewer places (0.55 of them, five deviations under the threshold) can't be of linked sets
LEAST_AGREED = int(0.55 * HASHES)
#: Texts that are compared with one text of their leader
GROUP = 64
_rng = np.random.Generator(np.random.PCG64(5))
FACTORS = (_rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
OFFSETS = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]


def shingle_hashes(buf: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of ``width`` words of each row, repeats included, and row boundaries."""
    starts, ends, first = B.words(buf, offs)
    word_hash = B.range_hash(B.prefix_hash(buf, B.LOWER_VALUES), starts, ends)
    h, _, bounds = B.windows_hash(word_hash, first, width)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < width))
    if not len(short):
        return h, bounds
    own = np.zeros(len(short), np.uint64)
    for k in range(width - 1):  # the whole sequence is the one shingle
        has = count[short] > k
        own[has] = own[has] * np.uint64(0x9E3779B97F4A7C15) + word_hash[first[short][has] + k]
    own = B.mix(own ^ count[short].astype(np.uint64))
    return np.insert(h, bounds[short], own), bounds + np.concatenate([[0], np.cumsum((count > 0) & (count < width))])


def _signature(s: np.ndarray) -> bytes:
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(least, (FACTORS * x[i : i + 4096] + OFFSETS).min(axis=1), out=least)
    return least.tobytes()


def _digest(s: np.ndarray) -> bytes:
    return np.array([B.mix(s ^ np.uint64(c)).sum(dtype=np.uint64) for c in (0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35)]).tobytes()


def shingle_sets(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, k (hash of the text, which tells rows of one doc_id apart), n_shingles, and the digest and signature of the set (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in B.text_chunks(batch.column(2)):
                h, bounds = shingle_hashes(buf, offs)
                sets = [np.unique(h[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(lo, hi - lo).columns[:2], pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([_signature(s) if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "k", "n_shingles", "digest", "signature"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64(text).alias("k"), text).mapInArrow(run, f"doc_id {kind}, k long, n_shingles long, digest binary, signature binary")


def _screened(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures (node, signature) don't rule a link out."""
    wide = pairs
    for end in ("a", "b"):
        wide = wide.join(signatures.select(F.col("node").alias(end), F.col("signature").alias(f"signature_{end}")), end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in (2, 3))
            keep = pa.array(np.flatnonzero((x == y).sum(axis=1) >= LEAST_AGREED))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in (0, 1)], ["a", "b"])

    return wide.select("a", "b", "signature_a", "signature_b").mapInArrow(run, pairs.select("a", "b").schema)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are linked.

    The texts of the b of one a come in groups of ``GROUP`` behind the text of a: each is sent once, a common a's once a group.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "groups").alias("group"))
    of = lambda end: texts.select(F.col("node").alias(end), "text")
    members = dealt.join(of("b"), "b").select("a", "group", "b", "text")
    first = dealt.select("a", "group").distinct().join(of("a"), "a").select("a", "group", F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), "text")
    sent = first.union(members).repartition("a", "group").sortWithinPartitions("a", "group", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.uint64)
        for batch in batches:
            keep, n, member = [], 0, batch.column(2).is_valid().to_pylist()
            for _, _, buf, offs in B.text_chunks(batch.column(3), 1 << 18):
                h, bounds = shingle_hashes(buf, offs)
                for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    s = np.unique(h[x:y])
                    if not member[n]:
                        own = s
                    else:
                        both = len(np.intersect1d(s, own, assume_unique=True))
                        if 100 * both >= PERCENT * (len(s) + len(own) - both):
                            keep.append(n)
                    n += 1
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 2)], ["a", "b"])

    return sent.mapInArrow(run, pairs.select("a", "b").schema)


def _prefix_pairs(open_nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of different components that can be linked, from rarest-first prefixes; exact.

    Of a linked pair the smaller set (n) has a common shingle among its first n - 6n/7 + 1 rarest, the larger among its first
    n - 3n/4 + 1.  Pairs of one component aren't made: one side is always outside the shingle's most common component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in B.text_chunks(batch.column(1), 1 << 18):
                h, bounds = shingle_hashes(buf, offs)
                sets = [np.unique(h[a:b]).astype(np.int64) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    kind = open_nodes.schema["node"].dataType.simpleString()
    sets = texts.join(open_nodes.select("node"), "node", "left_semi").select("node", "text").mapInArrow(run, f"node {kind}, shingles array<long>")
    rows = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle"))
    prefix = (
        rows.join(often, "shingle").withColumn("place", rank)
        .where(F.expr(f"often > 1 and place <= n - ceil({PERCENT} * n / 100) + 1"))
        .join(open_nodes, "node")
        .select("shingle", "node", "n", "place", "component", F.expr(f"place <= n - ceil({2 * PERCENT} * n / {100 + PERCENT}) + 1").alias("early"))
    )
    by_component = prefix.groupBy("shingle", "component").agg(F.count("*").alias("c"))
    main = by_component.groupBy("shingle").agg(F.max_by("component", "c").alias("main"), F.count("*").alias("d")).where("d > 1").drop("d")
    prefix = cut(prefix.join(main, "shingle"))
    l, r = prefix.where("component != main").alias("l"), prefix.alias("r")
    need = f"{PERCENT} * (l.n + r.n) / {100 + PERCENT}"
    fits = f"l.shingle = r.shingle and l.component != r.component and 100 * l.n >= {PERCENT} * r.n and 100 * r.n >= {PERCENT} * l.n and least(l.n - l.place, r.n - r.place) + 1 >= {need} - 0.001"
    smaller = l.where("early").join(r, F.expr(f"{fits} and l.n <= r.n"))
    larger = l.join(r.where("early"), F.expr(f"{fits} and r.n <= l.n"))
    return smaller.union(larger).select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def _classes(members: DataFrame) -> tuple[DataFrame, bool]:
    """digest, node, rep (least doc_id), k and signature of every class of equal sets, and whether a doc_id stands for several.

    The node is rep, but where rows of one doc_id have different texts, a hash for all classes of it but one.
    """
    found = members.where("doc_id is not null and n_shingles > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "k")).alias("at"), F.first("signature").alias("signature"))
    classes = stash(found.select("digest", F.col("at.doc_id").alias("rep"), "at.k", "signature"))
    shared_ids = classes.groupBy("rep").agg(F.count("*").alias("c"), F.min("digest").alias("least")).where("c > 1").drop("c")
    if not shared_ids.take(1):
        return classes.withColumn("node", F.col("rep")), False
    node = F.when(F.col("least").isNull() | (F.col("digest") == F.col("least")), F.col("rep")).otherwise(F.xxhash64("rep", "digest").cast(classes.schema["rep"].dataType))
    return stash(classes.join(shared_ids, "rep", "left").select("digest", "rep", "k", "signature", node.alias("node"))), True


def _labels(found: DataFrame, more: DataFrame) -> DataFrame:
    """Components after links ``more`` between them: the old labels, led on by the components of their own graph."""
    over = components(_named(_named(more, found, "a"), found, "b"))
    return cut(found.join(over.select(F.col("node").alias("component"), F.col("component").alias("over")), "component", "full")
               .select(F.coalesce("node", "component").alias("node"), F.coalesce("over", "component").alias("component")))


def _named(df: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """``df`` with the component instead of the node in ``column``."""
    names = found.select(F.col("node").alias(column), F.col("component").alias("__c"))
    return df.join(names, column, "left").withColumn(column, F.coalesce("__c", column)).drop("__c")


def _components(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, k, n_shingles and component_id of every row."""
    members = stash(shingle_sets(docs, text))
    classes, repeats = _classes(members)
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("signature", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)])
    banded = classes.select("node", F.explode(bands).alias("bucket"))
    leaders = banded.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("size")).where("size > 1").drop("size")
    shared = stash(banded.join(leaders, "bucket"))
    signatures = classes.select("node", "signature")
    pairs = stash(_screened(shared.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), signatures))

    wanted = classes.join(shared.select("node").distinct(), "node", "left_semi").select(F.col("rep").alias("doc_id"), "k", "node")
    texts = stash(
        docs.select("doc_id", F.xxhash64(text).alias("k"), F.col(text).alias("text")).join(wanted.hint("shuffle_hash"), ["doc_id", "k"])
        .dropDuplicates(["node"]).select("node", "text")
    )
    found = cut(components(cut(_verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), texts))))

    # other leaders, where they would still join two components
    apart = pairs.join(found.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(found.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    more = cut(_verified(apart.where("coalesce(ca, a) != coalesce(cb, b)").select("a", "b"), texts))
    if more.take(1):
        found = _labels(found, more)
    of = _named(shared.select("bucket", "node", F.col("node").alias("component")), found, "component")
    open_buckets = of.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("bucket")
    open_nodes = cut(of.join(open_buckets, "bucket", "left_semi").select("node", "component").distinct())
    if open_nodes.take(1):
        more = cut(_verified(_screened(_prefix_pairs(open_nodes, texts), signatures), texts))
        if more.take(1):
            found = _labels(found, more)

    named = _named(classes.select("digest", "rep", F.col("node").alias("component")), found, "component")
    if repeats:  # the least node may be a hash
        named = named.join(named.groupBy("component").agg(F.min("rep").alias("least")), "component").withColumn("component", F.col("least"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    named = stash(named.select("digest", "component"))
    for done in (texts, shared, pairs):
        discard(done)
    return members.drop("signature").join(named, "digest", "left").select("doc_id", "k", "n_shingles", component.alias("component_id"))


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the least doc_id of its component) for every row of ``docs``."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return _components(docs, text).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those whose component has a lesser doc_id.

    Of rows that repeat doc_id and text, null among them, one stays.
    """
    found = _components(docs, text)
    named = found.select(F.col("doc_id").alias("__id"), F.col("k").alias("__k"), (F.col("doc_id") != F.col("component_id")).alias("gone"))
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__k"))
    kept = docs.join(named.where("gone").distinct(), same, "left_anti").select(docs.columns)
    again = stash(named.where("not coalesce(gone, false)").groupBy("__id", "__k").agg(F.count("*").alias("c")).where("c > 1").drop("c"))
    if not again.take(1):
        discard(again)
        return kept
    same = kept["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(kept[text]) == F.col("__k"))
    once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", text])
    return kept.join(again, same, "left_anti").unionByName(once)
