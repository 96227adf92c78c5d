"""Operator 12, exact Jaccard join of sets of three-word shingles by universe partition and the pigeonhole principle.

1. Texts become sets of 64-bit shingle hashes; equal sets are one class before anything is compared.
2. Sizes fall into bands that are narrow enough for a set to have smaller partners in its own band (``own``) and the one below
   (``low``) only.  A band hashes the universe of shingles into segments.  Two sets that link differ in at most H shingles, and
   a band has more segments than that, so one segment is the same in both.
3. A segment is free if no possible partner has the same one.  A set of over H free segments links with nothing and is done;
   that leaves the few open sets.
4. Open sets are indexed by their segments and by the segments less one shingle each.  A segment without a partner at one
   shingle's distance counts twice.  For the rest of H + 1 the cheapest are taken, exact or within one shingle, at the cost of
   the partners that the index has for each: sets that differ by more in all that is taken differ in over H shingles.
5. Partners are asked for: first one leader of each list, then, where lists still span several components, those that differ from
   the leader in the same shingles.  Each pair is verified on whole sets; links become components.  No list or pair is capped.

Texts without words (null, empty) are linked with nothing.  Fewer than three words are one shingle, the whole sequence.  Rows with
a null doc_id are linked with nothing and have no component.  Rows that repeat a doc_id stay rows, each with the component of its
own text.  Ties go to the least doc_id.  Texts of any length are whole sets.  An empty table gives none.  Columns of the input that
have a result's name are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, discard, stash
from . import _bytes as B
from .components import components
from .near_dup import shingle_hashes

WIDTH = 3
#: Sets link at 9 / 10: sets of s shingles together differ in s / 19 at most
LEAST, MOST, SHARE = 9, 10, 19
#: Smaller sets link with equal ones only
SMALLEST = 9


def _bands() -> np.ndarray:
    """The least size of each band; a band ends where its least size is 0.81 of the size."""
    starts = [SMALLEST]
    while starts[-1] < 1 << 40:
        starts.append(starts[-1] * MOST**2 // LEAST**2 + 1)
    return np.array(starts)


STARTS = _bands()


def shape(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sizes n: band, H with partners of the own segmentation, H with those of the band below (-1: none there), segments by band."""
    band = np.searchsorted(STARTS, n, side="right") - 1
    end = np.append(STARTS[1:] - 1, 0)
    below = np.where(band > 0, end[band - 1], 0)
    own = np.where(band >= 0, (n + MOST * n // LEAST) // SHARE, -1)
    low = np.where((band > 0) & (LEAST * n <= MOST * below), (n + below) // SHARE, -1)
    segments = (end + MOST * end // LEAST) // SHARE + 1
    return band, own, low, segments


def _salts(band: np.ndarray, segment: np.ndarray) -> np.ndarray:
    return B.mix((band.astype(np.uint64) << np.uint64(48)) + segment.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))


def segment_keys(sets: list[np.ndarray], band: np.ndarray, segments: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For each set, in its band of so many segments: the key of each segment, the segment of each shingle, the key without that shingle.

    The top bits of a shingle tell its segment, so those of a sorted set are in order; a key is a sum, so a shingle can be taken off.
    """
    size, count = np.array([len(s) for s in sets], np.int64), segments.astype(np.int64)
    all_ = np.concatenate([*sets, np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), size)
    segment = ((all_ >> np.uint64(32)) * count[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(count)])
    flat = base[owner] + segment
    cuts = np.searchsorted(flat, np.arange(base[-1] + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(all_, dtype=np.uint64)])
    of = np.repeat(np.arange(len(sets)), count)
    total = sums[cuts[1:]] - sums[cuts[:-1]] + _salts(band[of], np.arange(base[-1]) - base[of])
    keys, without = B.mix(total).view(np.int64), B.mix(total[flat] - all_).view(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    part = lambda x, bounds: [x[a:b] for a, b in pairwise(bounds.tolist())]
    return part(keys, base), part(segment, at), part(without, at)


def _digest(s: np.ndarray) -> bytes | None:
    return np.array([B.mix(s ^ np.uint64(c)).sum(dtype=np.uint64) for c in (0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35)]).tobytes() if len(s) else None


def _members(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, k (hash of the text), n_shingles, digest of the set; for the own and the lower segmentation keys, their number m and H."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in B.text_chunks(batch.column(2)):
                h, bounds = shingle_hashes(buf, offs, WIDTH)
                sets = [np.unique(h[a:b]) for a, b in pairwise(bounds.tolist())]
                n = np.array([len(s) for s in sets])
                band, own_h, low_h, segments = shape(n)
                keys = {}
                for name, least, of in (("own", own_h, band), ("low", low_h, band - 1)):
                    have = np.flatnonzero(least >= 0)
                    found = iter(segment_keys([sets[i] for i in have.tolist()], of[have], segments[of[have]])[0])
                    keys[name] = pa.array([next(found) if x >= 0 else None for x in least.tolist()], pa.list_(pa.int64()))
                numbers = [segments[band], own_h, segments[band - 1], low_h]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(lo, hi - lo).columns[:2], pa.array(n, pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), keys["own"], keys["low"], *(pa.array(x, pa.int64()) for x in numbers)],
                    ["doc_id", "k", "n_shingles", "digest", "own", "low", "m_own", "h_own", "m_low", "h_low"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", F.xxhash64(text).alias("k"), text)
    return made.mapInArrow(run, f"doc_id {kind}, k long, n_shingles long, digest binary, own array<long>, low array<long>, m_own long, h_own long, m_low long, h_low long")


def _open(members: DataFrame, classes: DataFrame) -> DataFrame:
    """node, low, n, m, h of the classes that have too few free segments, in the own or the lower segmentation."""
    nodes = members.join(classes.select(F.col("node").alias("row")).hint("shuffle_hash"), "row", "left_semi")
    of = lambda low: nodes.select(F.col("row").alias("node"), F.lit(low).alias("low"), F.explode("low" if low else "own").alias("key"))
    keys = of(False).unionByName(of(True))
    counts = keys.groupBy("key").agg(F.count("*").alias("c"), F.count_if(~F.col("low")).alias("c_own")).where("c > 1 and c_own > 0")
    shared = keys.join(counts.hint("shuffle_hash"), "key").groupBy("node", "low").agg(F.count("*").alias("shared"))
    of = members.select(F.col("row").alias("node"), F.col("n_shingles").alias("n"), "m_own", "h_own", "m_low", "h_low")
    return shared.join(of, "node").selectExpr("node", "low", "n", "if(low, m_low, m_own) as m", "if(low, h_low, h_own) as h", "shared").where("m - shared <= h").drop("shared")


def _sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """node, n and shingles (sorted hashes) of the wanted (doc_id, k, node)."""
    texts = docs.select("doc_id", F.xxhash64(text).alias("k"), F.col(text).alias("text")).join(wanted.hint("shuffle_hash"), ["doc_id", "k"]).dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in B.text_chunks(batch.column(1)):
                h, bounds = shingle_hashes(buf, offs, WIDTH)
                sets = [np.unique(h[a:b]) for a, b in pairwise(bounds.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, n long, shingles binary")


def _index(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """node, low, segment, key and whether a shingle is left out (less), of the keys that could bring two open sets together.

    With c and c_less: the partners that have the same key, whole and less a shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a set at a time: its keys are as many as its shingles
                s, low = np.frombuffer(batch.column(2)[i].as_py(), np.uint64), batch.column(1)[i].as_py()
                band, _, _, segments = shape(np.array([len(s)]))
                (keys,), (of,), (without,) = segment_keys([s], band - low, segments[band - low])
                n = len(keys) + len(without)
                columns = [pa.array(np.concatenate([np.arange(len(keys)), of]), pa.int32()), pa.array(np.concatenate([keys, without]), pa.int64()), pa.array(np.arange(n) >= len(keys))]
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], n), pa.repeat(batch.column(1)[i], n), *columns], ["node", "low", "segment", "key", "less"])

    rows = open_.join(sets, "node").select("node", "low", "shingles").mapInArrow(run, "node long, low boolean, segment int, key long, less boolean")
    whole, less = ~F.col("less"), F.col("less")
    own = ~F.col("low")
    counts = rows.groupBy("key").agg(*(F.count_if(x).alias(n) for n, x in (("e_own", whole & own), ("e_low", whole & ~own), ("l_own", less & own), ("l_low", less & ~own))))
    counts = counts.where("e_own + e_low > 0 and e_own + e_low + l_own + l_low > 1")
    partners = lambda k: F.col(f"{k}_own") + F.when(F.col("low"), 0).otherwise(F.col(f"{k}_low"))  # noqa: E731  # sets of the band above meet in their own
    return rows.join(counts.hint("shuffle_hash"), "key").select("node", "low", "segment", "key", "less", (partners("e") - F.when(whole & own, 1).otherwise(0)).alias("c"), partners("l").alias("c_less"))


def _asked(index: DataFrame, open_: DataFrame) -> DataFrame:
    """node, low, key, less: the lists that each open set looks through, of least cost.

    A segment's first step is its list of equal ones, its second those a shingle away; segments without partners give both for nothing.
    """
    by_segment = index.groupBy("node", "low", "segment").agg(
        F.sum(F.when(~F.col("less"), F.col("c")).otherwise(0)).alias("equal"), F.sum(F.when(F.col("less"), F.col("c")).otherwise(F.col("c_less"))).alias("near")
    )
    steps = by_segment.select("node", "low", "segment", F.posexplode(F.array("equal", F.greatest("equal", "near"))).alias("step", "cost"))
    rank = F.row_number().over(Window.partitionBy("node", "low").orderBy("cost", "step", "segment"))
    some = by_segment.groupBy("node", "low").agg(F.count("*").alias("listed"))
    room = open_.join(some, ["node", "low"]).select("node", "low", F.expr("h + 1 - 2 * (m - listed)").alias("room"))
    taken = steps.withColumn("rank", rank).join(room, ["node", "low"]).where("rank <= room and cost > 0").select("node", "low", "segment", "step")
    whole = "((not less and step = 0) or (less and step = 1))"  # the list of sets that have the key itself
    asks = index.join(taken, ["node", "low", "segment"]).where(f"{whole} or (not less and step = 1)")
    return asks.select("node", "low", "key", F.expr(f"not {whole}").alias("less"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that link."""
    wide = pairs
    for end in ("a", "b"):
        wide = wide.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"shingles_{end}")), end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if MOST * both >= LEAST * (len(x) + len(y) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in (0, 1)], ["a", "b"])

    return wide.select("a", "b", "shingles_a", "shingles_b").mapInArrow(run, "a long, b long")


def _pairs(found: DataFrame) -> DataFrame:
    """(a, b) of rows with x, n_x, y, n_y that differ and whose sizes allow a link."""
    fits = found.where(f"x != y and {MOST} * least(n_x, n_y) >= {LEAST} * greatest(n_x, n_y)")
    return fits.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _deltas(spread: DataFrame, sets: DataFrame) -> DataFrame:
    """leader, node and each shingle that one of the two has and the other hasn't."""
    wide = spread.select("leader", "node")
    for end in ("leader", "node"):
        wide = wide.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"shingles_{end}")), end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a pair at a time: its rows are as many as its shingles
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                apart = np.setxor1d(x, y, assume_unique=True)
                yield pa.RecordBatch.from_arrays([*(pa.repeat(batch.column(c)[i], len(apart)) for c in (0, 1)), pa.array(apart.view(np.int64))], ["leader", "node", "shingle"])

    return wide.select("leader", "node", "shingles_leader", "shingles_node").mapInArrow(run, "leader long, node long, shingle long")


def _links(index: DataFrame, open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component) of the open sets that link with others.

    First each set is compared with the leader of each list that it looks through: the one whose own lists are longest, which of near
    copies is the one with fewest changes.  Then, for lists that still hold several components, with others of the list: two sets
    that link differ in H shingles at most, so what they have unlike their leader has that much in common, too.  Any H + 1 of the
    shingles in which x and its leader differ hold one in which y and the leader differ; where x differs in fewer, either they
    have one in common or both link with the leader.  So only sets with one of the H + 1 rarest such shingles in common are compared,
    if from the first of these on enough are left on both sides.
    """
    central = index.where("not less").groupBy("node", "low").agg(F.sum("c").alias("central"))
    size = open_.join(central, ["node", "low"], "left").select("node", "low", "n", "h", F.coalesce("central", F.lit(0)).alias("central"))
    asks = stash(_asked(index, open_).join(size, ["node", "low"]))
    lists = stash(index.join(asks.select("key", "less").distinct(), ["key", "less"], "left_semi").join(size, ["node", "low"]).select("key", "less", "node", "low", "n", "central"))
    of, rank = F.struct("node", "n"), F.struct("central", -F.col("node"))
    first = cut(lists.groupBy("key", "less").agg(F.max_by(of, rank).alias("to")).select("key", "less", F.col("to.node").alias("y"), F.col("to.n").alias("n_y")))
    led = asks.join(first, ["key", "less"]).select(F.col("node").alias("x"), F.col("n").alias("n_x"), "y", "n_y")
    links = cut(_verified(_pairs(led), sets))
    found = cut(components(links))

    name = found.select("node", F.col("component").alias("in"))
    members = lists.join(name, "node", "left").withColumn("in", F.coalesce("in", "node"))
    several = members.groupBy("key", "less").agg(F.min("in").alias("a"), F.max("in").alias("b")).where("a != b").select("key", "less")
    led_by = cut(several.join(first.select("key", "less", F.col("y").alias("leader")), ["key", "less"]))
    spread = members.join(led_by, ["key", "less"]).groupBy("leader", "node").agg(F.first("n").alias("n"), F.first("in").alias("in"))
    asking = asks.join(led_by, ["key", "less"]).groupBy("leader", "node").agg(F.max("h").alias("h"))
    apart = stash(_deltas(spread, sets))
    often = apart.groupBy("leader", "shingle").agg(F.count("*").alias("often")).where("often > 1")
    shared = apart.join(often, ["leader", "shingle"])
    sizes = apart.groupBy("leader", "node").agg(F.count("*").alias("apart")).join(shared.groupBy("leader", "node").agg(F.count("*").alias("met")), ["leader", "node"])
    rank = F.row_number().over(Window.partitionBy("leader", "node").orderBy("often", "shingle"))
    # what a set has alone comes before: it's rarest, and meets nothing; left: from this place on
    placed = shared.withColumn("rank", rank).join(sizes, ["leader", "node"]).join(spread, ["leader", "node"]).join(asking, ["leader", "node"], "left")
    placed = stash(placed.selectExpr("leader", "shingle", "node", "n", "in", "apart", "met - rank + 1 as left", "coalesce(apart - met + rank <= h + 1, false) as looks"))
    x = placed.where("looks").select("leader", "shingle", *[F.col(c).alias(f"{c}_x") for c in ("node", "n", "in", "apart", "left")])
    y = placed.select("leader", "shingle", *[F.col(c).alias(f"{c}_y") for c in ("node", "n", "in", "apart", "left")])
    common = F.expr(f"in_x != in_y and 2 * least(left_x, left_y) >= apart_x + apart_y - (n_x + n_y) div {SHARE}")
    met = x.join(y, (x["leader"] == y["leader"]) & (x["shingle"] == y["shingle"]) & common).withColumnsRenamed({"node_x": "x", "node_y": "y"})
    more = cut(_verified(_pairs(met), sets))
    discard(placed)
    for done in (asks, lists, apart):
        discard(done)
    return cut(components(links.union(more))) if more.take(1) else found


def ngram_join(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id that links lead to, for every row of ``docs``."""
    members = stash(_members(docs, text).withColumn("row", F.monotonically_increasing_id()))
    classes = stash(members.where("doc_id is not null and n_shingles > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep")))
    open_ = stash(_open(members, classes))
    wanted = members.join(open_.select(F.col("node").alias("row")).distinct(), "row", "left_semi").select("doc_id", "k", F.col("row").alias("node"))
    sets = stash(_sets(docs, text, wanted))
    index = stash(_index(open_, sets))
    found = _links(index, open_, sets)
    for done in (index, sets, open_):
        discard(done)
    named = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component").select("digest", "least")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return members.join(named, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"))
