"""Operator 11, periodic runs of words by a branching-tandem test over an enhanced suffix array.

1. The words of the texts of a chunk become numbers that no two texts share; prefix doubling sorts the suffixes, of which those
   that begin with a word that is alone in its text stay out; common prefixes of neighbours follow in text order.
2. Every LCP interval is known by the nearest smaller values of its common prefix, its children by the places of equal ones.
   For a suffix i of any child but the largest, i + depth and i - depth within the interval but outside the child make a
   branching square: its two halves are equal, and it can't be moved one word on.
3. Squares are rotated back as far as words agree; squares of a multiple of a known run's period fall into that run.

The sums are n log n for n words; a chunk holds half a megabyte of text, or one longer text.

No text, or one without words, has no runs and an empty rest.  Equal words are equal bytes; runs that overlap all count.  Runs of one
start go by period.  Rows that repeat a doc_id, and rows without one, are rows like any other.  Texts of any length are taken
whole.  An empty table gives none.  Columns of the input that have a result's name are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _bytes as B

#: A run has this many words, and this many periods, at least
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Suffixes that are tested at once
TESTED = 1 << 20

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def suffix_order(t: np.ndarray) -> np.ndarray:
    """The places of ``t`` whose value occurs again, in the order of the suffixes that begin there.

    Prefix doubling: ranks by the first h values; only groups that aren't single are sorted on, by the rank h places later.
    """
    n = len(t)
    order = np.argsort(t, kind="stable")
    rank = np.zeros(n + 1, np.int64)  # the place of the group's first member in the order; the end comes first
    new = np.ones(n, bool)
    new[1:] = t[order[1:]] != t[order[:-1]]
    firsts = np.flatnonzero(new)
    rank[order] = 1 + np.repeat(firsts, np.diff(np.append(firsts, n)))
    many = np.repeat(np.diff(np.append(firsts, n)) > 1, np.diff(np.append(firsts, n)))
    at = np.flatnonzero(many)
    repeated = at
    h = 1
    while len(at):
        group = rank[order[at]]
        key = group * (n + 2) + rank[np.minimum(order[at] + h, n)]
        by = np.argsort(key, kind="stable")
        order[at] = order[at[by]]
        key = key[by]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        firsts = np.flatnonzero(new)
        sizes = np.diff(np.append(firsts, len(at)))
        rank[order[at]] = 1 + np.repeat(at[firsts], sizes)
        at = at[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order[repeated]


def common_prefixes(t: list[int], order: list[int], place: list[int]) -> list[int]:
    """By place in the order: how many values the suffix shares with the one before it; place is -1 for a suffix that isn't in it.

    In text order, since a suffix shares at most one value less than the suffix one place before it.  ``t`` ends with a value that it has once.
    """
    out = [0] * len(order)
    shared = 0
    for i, k in enumerate(place):
        if k > 0:
            j = order[k - 1]
            while t[i + shared] == t[j + shared]:
                shared += 1
            out[k] = shared
            if shared:
                shared -= 1
        else:
            shared = 0
    return out


def nearest_smaller(values: list[int]) -> tuple[list[int], list[int]]:
    """By place: the last place before and the first place after that has a smaller value (-1 and the length if there is none)."""
    n = len(values)
    before, after, open_ = [-1] * n, [n] * n, []
    for k, v in enumerate(values):
        while open_ and values[open_[-1]] > v:
            after[open_.pop()] = k
        if open_:
            last = open_[-1]
            before[k] = before[last] if values[last] == v else last
        open_.append(k)
    return before, after


def branching_squares(t: np.ndarray) -> np.ndarray:
    """Rows (end, half) of every square of ``t`` whose halves are followed by different values; t[n-1] occurs once."""
    order = suffix_order(t)
    if not len(order):
        return np.empty((0, 2), np.int64)
    place = np.full(len(t), -1, np.int64)
    place[order] = np.arange(len(order))
    lcp = common_prefixes(t.tolist(), order.tolist(), place[:-1].tolist())
    before, after = (np.array(x) for x in nearest_smaller(lcp))
    depth = np.array(lcp)
    inner = np.flatnonzero(depth)
    if not len(inner):
        return np.empty((0, 2), np.int64)
    inner = inner[np.lexsort((inner, depth[inner], before[inner]))]
    left, d = before[inner], depth[inner]
    first = np.ones(len(inner), bool)
    first[1:] = (left[1:] != left[:-1]) | (d[1:] != d[:-1])
    last = np.append(first[1:], True)
    # children: the interval's first one up to its first split, and one from each split to the next
    lo = np.concatenate([left[first], inner])
    hi = np.concatenate([inner[first], np.where(last, after[inner], np.append(inner[1:], 0))])
    interval = np.cumsum(first) - 1
    interval = np.concatenate([np.arange(interval[-1] + 1), interval])
    size = hi - lo
    by = np.lexsort((size, interval))
    largest = by[np.append(np.flatnonzero(np.diff(interval[by])), len(by) - 1)]
    small = np.ones(len(lo), bool)
    small[largest] = False
    small = np.flatnonzero(small)
    begin, end = left[first], after[inner[first]]
    found = [np.empty((0, 2), np.int64)]
    upto = np.cumsum(size[small])
    k = 0
    while k < len(small):
        stop = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + TESTED, side="right")))
        some = small[k:stop]
        k = stop
        child = np.repeat(some, size[some])
        at = np.arange(len(child)) - np.repeat(np.cumsum(size[some]) - size[some], size[some]) + lo[child]
        i, half = order[at], d[first][interval[child]]
        for start, other in ((i, i + half), (i - half, i - half)):
            there = place[np.clip(other, 0, len(t) - 1)]
            ok = (other >= 0) & (other < len(t)) & (there >= begin[interval[child]]) & (there < end[interval[child]]) & ((there < lo[child]) | (there >= hi[child]))
            found.append(np.stack([start[ok] + 2 * half[ok], half[ok]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def runs_of(t: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of every maximal stretch of at least two smallest periods, by end and period."""
    out, values = [], t.tolist()
    known: list[tuple[int, int]] = []
    at = -1
    for end, half in branching_squares(t).tolist():
        if end != at:
            at, known = end, []
        start = end - 2 * half
        if any(half % period == 0 and begin <= start for begin, period in known):
            continue
        while start > 0 and values[start - 1] == values[start - 1 + half]:
            start -= 1
        known.append((start, half))
        out.append((start, end, half))
    return out


def text_runs(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """For each text its words, and (start, length, period) of its long runs by start and period."""
    words = [(x or b"").split() for x in texts]  # bytes split at the white space of [^\\x20\\x09-\\x0D]+
    numbers: list[int] = []
    firsts = []
    n = 0
    for own in words:
        seen: dict[bytes, int] = {}
        firsts.append(len(numbers))
        numbers += [seen.setdefault(w, n + len(seen)) for w in own]
        n += len(seen)
    numbers.append(n)
    found = [(s, e, p) for s, e, p in runs_of(np.array(numbers, np.int64)) if e - s >= max(LEAST_WORDS, LEAST_PERIODS * p)]
    owner = np.searchsorted(firsts, [s for s, _, _ in found], side="right") - 1
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (s, e, p) in zip(owner.tolist(), found, strict=True):
        runs[k].append((s - firsts[k], e - s, p))
    for own, of in zip(words, runs, strict=True):
        yield own, sorted(of, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those behind the first period of a run, joined by one space."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start and period) and collapsed (the text with one period of each run)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in B.text_chunks(batch.column(1)):
                raw = buf.tobytes()
                texts = [raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                counts, runs, rest = [], [], []
                for words, own in text_runs(texts):
                    counts.append(len(words))
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                    rest.append(collapsed(words, own))
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(runs, RUNS), pa.array(rest, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
