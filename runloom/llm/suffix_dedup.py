"""Operator 7, suffix-array dedup: removes every byte covered by a string of ``length`` (400) bytes that starts anywhere else too.

1. Anchors.  Of the grams (0.32 of its length) inside a string the (leftmost) one of least hash is its anchor.  Equal strings
   have equal anchors at the same place, so only strings whose anchor gram repeats can repeat.  Successive starts with
   one anchor make a piece: the bytes from its first start to the end of its last string.  Only pieces of repeated anchors go on,
   and pieces of equal bytes are one from here.
2. Suffix arrays.  The distinct pieces of an anchor meet in one block.  Its suffixes are put in order by two-stage sorting: the
   suffixes smaller than their successor are sorted directly, the others are induced by a scan of the buckets of first
   bytes; then the common prefixes of neighbours tell which strings are equal.
   The pieces of an anchor with more than ``PIECES`` distinct ones are dealt to several blocks; what a block can't settle
   alone, one string of each of its classes, meets the other blocks' by a 128-bit hash that is counted, not gathered.
3. Spans go back to the documents, where the covered bytes are removed.

Passages can be counted in words instead: then each word stands for ``CODE`` bytes, made of its hash, and strings are so many whole
words, whatever white space is between them; what goes is from the first letter of a run of words to the next word.  Grams, anchors
and starts are then whole words too, and a block sorts all of its starts by the words' numbers.  Passages can also be reported beside the bytes that go, by a second search.

Strings are judged on the input and never cross rows.  Null texts are empty.  Rows that repeat each other count as
separate documents, so their strings of that length are all repeated, and of such rows nothing is left; drop repeated rows before.
Texts of any length are taken whole.  Rows with a null doc_id are rows like any other.  An empty table gives none.  The cleaned text is the remaining bytes; where a
cut leaves part of a character, that part is dropped from kept_text, while kept_bytes holds every byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..session import discard, stash
from . import _bytes as B

LENGTH = 400
#: Texts are looked at in stretches of so many starts; pieces end there, strings don't
STRETCH = 1 << 18
#: Bytes of a gram in hundredths of those of a string
GRAM_PERCENT = 32
#: Distinct pieces of one anchor that go to one block
PIECES = 6144
#: Bytes that stand for a word, seven bits of its hash each
CODE = 8
#: Bytes of pieces that a suffix array is built of at once, whole anchors
BLOCK_BYTES = 1 << 18
#: Suffixes that are sorted at once, whole buckets
SORTED = 1 << 14


def pieces(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, values: np.ndarray = B.BYTE_VALUES) -> tuple[np.ndarray, ...]:
    """Row, first start, number of starts, anchor hash and hash of the content of every piece of some rows.

    ``buf`` has bytes, or any items that ``values`` has hashes of.
    """
    width = max(1, length * GRAM_PERCENT // 100)
    n, window = len(buf), length - width + 1
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    prefix = B.prefix_hash(buf, values)
    at = np.arange(n - width + 1)
    gram = B.gram_hash(prefix, width)
    # with the place in the low bits the leftmost of the least is the least, and tells where it is
    bits = np.uint64(int(n).bit_length())
    key = (gram >> bits << bits) | at.astype(np.uint64)
    grid = np.append(key, np.full(-len(key) % window, 2**64 - 1, np.uint64)).reshape(-1, window)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(right[:starts], left[window - 1 : window - 1 + starts])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    room = np.diff(offs) - length + 1
    has = room > 0
    edge = np.zeros(starts + 1, np.int8)
    edge[offs[:-1][has]] += 1
    edge[(offs[:-1] + room)[has]] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    turn = np.ones(starts, bool)
    turn[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    turn[offs[:-1][has]] = True
    first = np.flatnonzero(turn)
    size = np.diff(np.append(first, starts))
    first, size = first[inside[first]], size[inside[first]]
    row = np.searchsorted(offs, first, side="right") - 1
    return row, first - offs[row], size, gram[anchor[first]], B.range_hash(prefix, first, first + size + length - 1)


def _next(marked: np.ndarray) -> np.ndarray:
    """The first marked place from each place on; the last one is marked."""
    return np.minimum.accumulate(np.where(marked, np.arange(len(marked)), len(marked))[::-1])[::-1]


def suffix_order(text: np.ndarray, wanted: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The wanted places of ``text`` in the order of the first ``length`` bytes of their suffixes, by two-stage sorting.

    ``text`` has bytes over 0 and a 0 behind every piece.  With a place its successors up to the next suffix that is
    smaller than its own successor must be wanted.
    """
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1])
    step[-1] = 1
    smaller = step[_next(step != 0)] > 0  # than the successor; ends of pieces are
    places = np.flatnonzero(wanted)
    direct = places[smaller[places]]
    padded = np.concatenate([text, np.zeros(length, np.uint8)])
    direct = _sorted(padded, direct, length)

    # scan the buckets of first bytes upward; what stands before a suffix and is greater joins its own bucket's front part
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    order: list[np.ndarray] = []
    for c in range(257):
        front = waiting[c]
        found = np.concatenate(front) if front else np.empty(0, np.int64)
        while len(found):  # places within a run of c are induced by the run's own end
            order.append(found)
            found = _before(found, text, wanted, smaller, waiting, c)
        own = direct[bounds[c] : bounds[c + 1]]
        if len(own):
            order.append(own)
            _before(own, text, wanted, smaller, waiting, c)
        waiting[c] = []
    return np.concatenate(order)


def _sorted(padded: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """``places`` in the order of the ``length`` bytes from there on: by the first two, then some buckets of these at a time."""
    pair = padded[places].astype(np.uint16) << np.uint16(8) | padded[places + 1]
    by = np.argsort(pair, kind="stable")
    places = places[by]
    edges = np.flatnonzero(np.diff(pair[by])) + 1
    cuts = edges[np.diff(edges // SORTED, prepend=0) > 0]
    suffixes = np.lib.stride_tricks.sliding_window_view(padded, length)
    return np.concatenate([part[np.argsort(suffixes[part].view(f"S{length}").ravel(), kind="stable")] for part in np.split(places, cuts)])


def _before(scanned: np.ndarray, text: np.ndarray, wanted: np.ndarray, smaller: np.ndarray, waiting: list, c: int) -> np.ndarray:
    """Deals the induced places before the scanned ones to their buckets; returns those of the bucket ``c`` itself."""
    p = scanned[scanned > 0] - 1
    p = p[wanted[p] & ~smaller[p]]
    if not len(p):
        return p
    b = text[p]
    order = np.argsort(b, kind="stable")
    p, b = p[order], b[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    same = p[:0]
    for part in np.split(p, cuts):
        d = int(text[part[0]])
        if d == c:
            same = part
        else:
            waiting[d].append(part)
    return same


def common_prefix(text: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Common prefix of each suffix with the one before it, in bytes and up to ``length``; 0 for the first."""
    lcp = np.zeros(len(order), np.int64)
    padded = np.concatenate([text, np.zeros(length + 8, np.uint8)])
    open_ = np.arange(1, len(order))
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(np.uint64).ravel()
    for k in range(0, length, 8):
        a, b = (words[order[open_ - d] + k] for d in (0, 1))
        lcp[open_] += 8
        differs = a != b
        if differs.any():
            x = (a ^ b)[differs]
            low = x & (~x + np.uint64(1))
            lcp[open_[differs]] += (np.log2(low.astype(np.float64)).astype(np.int64) >> 3) - 8
            open_ = open_[~differs]
        if not len(open_):
            break
    return np.minimum(lcp, length)


def block_repeats(parts: list[bytes], sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For pieces with ``sizes`` starts: piece, start and class of every start of a string, and whether the class repeats."""
    lengths = np.array([len(p) + 1 for p in parts])
    base = np.concatenate([[0], np.cumsum(lengths)])
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8) + np.uint8(1)  # UTF-8 has no byte 0xFF
    at = np.zeros(len(text) + 1, np.int32)
    at[base[:-1]] += 1
    at[base[:-1] + sizes] -= 1
    start = np.cumsum(at[:-1]) > 0
    # a start's successors up to the next suffix that is smaller than its own successor are ordered too
    wanted = start.copy()
    up = np.ones(len(text), bool)
    up[:-1] = text[1:] > text[:-1]
    level = np.zeros(len(text), bool)
    level[:-1] = text[1:] == text[:-1]
    smaller = up[_next(~level)]
    smaller[base[1:] - 1] = True
    ends = np.flatnonzero(smaller)
    last = base[:-1] + sizes - 1
    stop = ends[np.searchsorted(ends, last)]
    grow = np.zeros(len(text) + 1, np.int32)
    np.add.at(grow, last, 1)
    np.add.at(grow, stop + 1, -1)
    wanted |= np.cumsum(grow[:-1]) > 0
    order = suffix_order(text, wanted, length)
    fresh = common_prefix(text, order, length) < length
    number = np.cumsum(fresh) - 1
    real = start[order]
    order, number = order[real], number[real]
    many = np.bincount(number, minlength=number[-1] + 1 if len(number) else 0) > 1
    piece = np.searchsorted(base, order, side="right") - 1
    return piece, order - base[piece], number, many[number]


def word_repeats(parts: list[bytes], sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As block_repeats() for pieces of words' codes: only words' starts, whose suffixes are sorted by words' numbers in the block."""
    base = np.concatenate([[0], np.cumsum([len(p) // CODE for p in parts])])
    known, word = np.unique(np.frombuffer(b"".join(parts), np.uint64), return_inverse=True)
    kind = np.dtype(">u2" if len(known) <= 1 << 16 else ">u4")  # bytes sort as the numbers do
    count = (sizes - 1) // CODE + 1
    piece = np.repeat(np.arange(len(parts)), count)
    start = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    words = length // CODE
    suffixes = np.lib.stride_tricks.sliding_window_view(word.astype(kind), words)[base[piece] + start].view(f"S{words * kind.itemsize}").ravel()
    order = np.argsort(suffixes, kind="stable")
    suffixes = suffixes[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = suffixes[1:] != suffixes[:-1]
    number = np.cumsum(fresh) - 1
    return piece[order], start[order], number, np.bincount(number)[number] > 1


def _runs(piece: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of successive starts: piece, first, end."""
    o = np.lexsort((start, piece))
    piece, start = piece[o], start[o]
    if not len(piece):
        return piece, start, start
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (start[1:] != start[:-1] + 1)
    i = np.flatnonzero(new)
    return piece[i], start[i], start[np.append(i[1:], len(piece)) - 1] + 1


def hashed(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and per row the number of the first word (n+1 values)."""
    starts, ends, first = B.words(buf, offs)
    return B.range_hash(B.prefix_hash(buf), starts, ends), first


def coded(words: np.ndarray) -> np.ndarray:
    """Bytes in which each of some hashed words is ``CODE`` bytes."""
    return (words[:, None] >> np.arange(0, 7 * CODE, 7, dtype=np.uint64) & np.uint64(127)).astype(np.uint8).ravel()


def _anchored(length: int, words: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, _, buf, offs in B.text_chunks(batch.column(2), STRETCH):
            values, each, unit = B.BYTE_VALUES, length, 1
            if words:
                values, offs = hashed(buf, offs)
                buf, each, unit = np.arange(len(values)), length // CODE, CODE
            stretches = [(buf, offs, 0)]
            if len(buf) > 2 * STRETCH and len(offs) == 2:
                stretches = [(buf[a : a + STRETCH + each - 1], None, a) for a in range(0, len(buf) - each + 1, STRETCH)]
            for part, bounds, shift in stretches:
                row, first, size, anchor, content = pieces(part, bounds if bounds is not None else np.array([0, len(part)]), each, values)
                if len(row):
                    first, size = (first + shift) * unit, (size - 1) * unit + 1
                    rows = pa.array(row + lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first), pa.array(size.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                        ["id", "k", "first", "size", "anchor", "content"],
                    )


def _cut_pieces(length: int, words: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From id, k, texts and the lists of pieces wanted of them: the pieces' bytes, of rows that repeat each other once."""
    seen = set()
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for lo, hi, buf, offs in B.text_chunks(batch.column(2), STRETCH):
            if words:
                values, offs = hashed(buf, offs)
                buf, offs = coded(values), offs * CODE
            raw, asks, cut = memoryview(buf), [], []
            for i, a in zip(range(lo, hi), offs.tolist(), strict=False):
                if keys[i] in seen:
                    continue
                seen.add(keys[i])
                asks.append(batch.column(3)[i].values)
                first, size = (asks[-1].field(c).to_numpy().tolist() for c in ("first", "size"))
                cut += [bytes(raw[a + f : a + f + s + length - 1]) for f, s in zip(first, size, strict=True)]
            if asks:
                ask = pa.concat_arrays(asks)
                yield pa.RecordBatch.from_arrays([*(ask.field(c) for c in ("anchor", "content", "salt", "hot", "size")), pa.array(cut, pa.binary())], ["anchor", "content", "salt", "hot", "size", "bytes"])


def _settle(length: int, words: bool, rows: list[dict]) -> pa.RecordBatch:
    """Spans of the starts that repeat in a block, and of hot anchors one string of each class for the other blocks."""
    parts = [r["bytes"] for r in rows]
    sizes = np.array([r["size"] for r in rows])
    piece, start, number, twice = (word_repeats if words else block_repeats)(parts, sizes, length)
    p, a, b = _runs(piece[twice], start[twice])
    if words:
        start, a, b = start * CODE, a * CODE, (b - 1) * CODE + 1
    hot = np.array([r["hot"] for r in rows])
    # neighbours of a class stand together, so its first is where the number changes
    lead = np.ones(len(number), bool)
    lead[1:] = number[1:] != number[:-1]
    lead &= hot[piece]
    q, s = piece[lead], start[lead]
    blank = [None] * len(p)
    hashes = []
    if len(q):
        for values in (B.BYTE_VALUES, B.mix(B.BYTE_VALUES)):
            h = np.empty(len(q), np.uint64)
            for x in np.unique(q):
                at = np.flatnonzero(q == x)
                h[at] = B.range_hash(B.prefix_hash(np.frombuffer(parts[x], np.uint8), values), s[at], s[at] + length)
            hashes.append(h.view(np.int64).tolist())
    else:
        hashes = [[], []]
    both = np.concatenate([p, q]).astype(np.int64)
    anchor = np.array([r["anchor"] for r in rows], np.int64)
    content = np.array([r["content"] for r in rows], np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor[both]), pa.array(content[both]), pa.array(np.concatenate([a, s]).astype(np.int32)), pa.array(np.concatenate([b, s + 1]).astype(np.int32)), pa.array(blank + hashes[0], pa.int64()), pa.array(blank + hashes[1], pa.int64())],
        ["anchor", "content", "from", "to", "x", "y"],
    )


def _blocks(length: int, words: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups (anchor, salt), which come one after another, up to BLOCK_BYTES at a time."""
    held: list[dict] = []
    size, last = 0, None
    for batch in batches:
        for r in batch.to_pylist():
            group = (r["anchor"], r["salt"])
            if group != last and size >= BLOCK_BYTES:
                yield _settle(length, words, held)
                held, size = [], 0
            held.append(r)
            size += len(r["bytes"])
            last = group
    if held:
        yield _settle(length, words, held)


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """id, k (hash of the text) and spans (array of start and end in bytes, unsorted) of rows with repeated strings."""
    return _spans_of(_keyed(docs, text), length, False)


def repeated_words(docs: DataFrame, text: str, words: int) -> DataFrame:
    """id, k and spans as of repeated_spans(), of strings of so many words, in bytes of words' codes."""
    return _spans_of(_keyed(docs, text), words * CODE, True)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text).alias("k"), F.col(text).alias("text"))


def _spans_of(keyed: DataFrame, length: int, words: bool) -> DataFrame:
    long_rows = keyed.where(F.octet_length("text") >= (2 * length // CODE - 1 if words else length))
    cut = stash(long_rows.mapInArrow(partial(_anchored, length, words), "id long, k long, first long, size int, anchor long, content long"))
    again = cut.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    # read back, both sides of the join come by an exchange, so that a common anchor's rows can be split
    again = stash(again)
    rows = stash(cut.join(again, "anchor"))
    discard(cut)
    discard(again)
    distinct = rows.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("id", "k", "first", "size")).alias("at"))
    distinct = stash(distinct.select("anchor", "content", "copies", "at.*"))
    # as above
    groups = stash(distinct.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))

    asked = (
        distinct.join(groups, "anchor")
        .withColumn("hot", F.col("n") > PIECES)
        .withColumn("salt", F.pmod("content", F.ceil(F.col("n") / PIECES)).cast("int"))
        .groupBy("id", "k").agg(F.collect_list(F.struct("anchor", "content", "salt", "hot", "first", "size")).alias("asked"))
    )
    blocks = (
        long_rows.join(asked.hint("shuffle_hash"), ["id", "k"]).select("id", "k", F.col("text").cast("binary"), "asked")
        .mapInArrow(partial(_cut_pieces, length, words), "anchor long, content long, salt int, hot boolean, size int, bytes binary")
        .repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
        .mapInArrow(partial(_blocks, length, words), "anchor long, content long, from int, to int, x long, y long")
    )
    settled = stash(blocks)
    discard(groups)
    across = settled.where("x is not null").groupBy("x", "y").agg(F.count("*").alias("c")).where("c > 1").select("x", "y")
    part = settled.where("x is null").select("anchor", "content", "from", "to").union(
        settled.where("x is not null").join(across, ["x", "y"]).select("anchor", "content", "from", "to")
    )
    whole = distinct.where("copies > 1").select("anchor", "content", F.lit(0).alias("from"), F.col("size").alias("to"))
    single = distinct.where("copies = 1").select("anchor", "content")
    found = whole.union(part.join(single, ["anchor", "content"]))
    spans = stash(
        rows.join(found, ["anchor", "content"])
        .groupBy("id", "k")
        .agg(F.collect_set(F.struct((F.col("first") + F.col("from")).alias("a"), (F.col("first") + F.col("to") + (length - 1)).alias("b"))).alias("spans"))
    )
    for done in (rows, distinct, settled):
        discard(done)
    return spans


def _joined(spans: pa.Scalar) -> np.ndarray:
    """The union of some spans as sorted disjoint spans that don't touch."""
    if not spans.is_valid:
        return np.empty((0, 2), np.int64)
    return _union(*(spans.values.field(c).to_numpy() for c in ("a", "b")))


def _of_words(spans: pa.Scalar, raw: bytes, words: int) -> np.ndarray:
    """The union of some spans of codes as spans of a text's bytes; only strings of whole words count."""
    if not spans.is_valid:
        return np.empty((0, 2), np.int64)
    a, b = (spans.values.field(c).to_numpy() for c in ("a", "b"))
    first, last = -(-a // CODE), b // CODE - words
    whole = first <= last
    found = _union(first[whole], last[whole] + words)
    starts, _, _ = B.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return np.append(starts, len(raw))[found]


def _union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a):
        return np.empty((0, 2), np.int64)
    o = np.argsort(a, kind="stable")
    a, b = a[o], np.maximum.accumulate(b[o])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    i = np.flatnonzero(new)
    return np.stack([a[i], b[np.append(i[1:], len(a)) - 1]], axis=1)


def remove_repeats(docs: DataFrame, text: str = "text", decode: bool = False, length: int = LENGTH, over_words: int = 0, passage_words: int = 0) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans and kept_bytes (binary, or kept_text if ``decode``) to the rows of ``docs``, all but ``text``.

    Removed are the bytes covered by repeated strings of ``length`` bytes, or with ``over_words`` of more words than that.
    With ``passage_words`` also n_passages and passage_bytes, the number and bytes of repeated passages of more words than that:
    they are reported and stay, where no removed bytes cover them.
    Columns of ``docs`` with a result's name are replaced.
    """
    counts = ("n_bytes", "n_removed", "n_spans", *(("n_passages", "passage_bytes") if passage_words else ()))
    added = (*counts, "kept_text" if decode else "kept_bytes")
    rest = [c for c in docs.columns if c not in added and c != text]
    spans = repeated_words(docs, text, over_words + 1) if over_words else repeated_spans(docs, text, length)
    if passage_words:
        spans = spans.join(repeated_words(docs, text, passage_words + 1).withColumnRenamed("spans", "passages"), ["id", "k"], "full")
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text).alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    own = [f"c{i}" for i in range(len(rest))]
    source = keyed.join(spans, ["id", "k"], "left").select(*own, "text", *spans.columns[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, *passages = batch.columns[len(own) :]
            size = pc.binary_length(texts).to_numpy().astype(np.int64)
            group = np.cumsum(size) >> 24
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:], strict=False):
                kept, removed, n, seen = [], [], [], []
                for i in range(x, y):
                    raw = texts[i].as_py()
                    cut = _of_words(spans[i], raw, over_words + 1) if over_words else _joined(spans[i])
                    seen += [_of_words(p[i], raw, passage_words + 1) for p in passages]
                    removed.append(int((cut[:, 1] - cut[:, 0]).sum()))
                    n.append(len(cut))
                    edges = [0, *cut.ravel().tolist(), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if n[-1] else raw)
                found = [[len(p) for p in seen], [int((p[:, 1] - p[:, 0]).sum()) for p in seen]] if passages else []
                yield pa.RecordBatch.from_arrays([*batch.slice(x, y - x).columns[: len(own)], pa.array(size[x:y]), *(pa.array(v, pa.int64()) for v in (removed, n, *found)), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if decode else pa.array(kept, pa.binary())], [*own, *added])

    schema = StructType([*(source.schema[c] for c in own), *(StructField(c, LongType()) for c in counts), StructField(added[-1], StringType() if decode else BinaryType())])
    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(c).alias(n) for c, n in zip(own, rest, strict=True)], *added)


def dedup_text(docs: DataFrame, text: str = "text", length: int = LENGTH, over_words: int = 0) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``, and n_chars, if there, of what is left; all rows stay."""
    aside = {c: f"__{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", text)}
    out = remove_repeats(docs.select("doc_id", text, *[F.col(f"`{c}`").alias(a) for c, a in aside.items()]), text, True, length, over_words)
    values = {c: F.col(a) for c, a in aside.items()} | {"doc_id": F.col("doc_id"), text: F.col("kept_text")}
    if "n_chars" in values:
        values["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[values[c].alias(c) for c in docs.columns])
