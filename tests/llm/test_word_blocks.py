"""Blocks of passages that are counted in words look at the starts of words only; hashes and orders are what they were."""

from __future__ import annotations

import random
import tracemalloc
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

from runloom.llm import _bytes as B
from runloom.llm import suffix_dedup as S

WORDS = 51


def pieces(seed: int, n: int, vocabulary: int) -> tuple[list[bytes], np.ndarray]:
    """Some pieces of words' codes and their numbers of starts in bytes; a few share whole passages."""
    rng = np.random.default_rng(seed)
    known = rng.integers(0, 2**63, vocabulary, dtype=np.uint64)
    shared = known[rng.integers(0, vocabulary, 70)]
    parts, sizes = [], []
    for k in range(n):
        words = known[rng.integers(0, vocabulary, rng.integers(WORDS + 4, 87))]
        if k % 3 == 0:
            words[: WORDS + k % 5] = shared[k % 7 : k % 7 + WORDS + k % 5]
        parts.append(S.coded(words).tobytes())
        sizes.append((len(words) - WORDS) * S.CODE + 1)
    return parts, np.array(sizes)


@pytest.mark.parametrize("vocabulary", [3, 500, 70_000])
def test_starts_of_words_repeat_as_bytes_do(vocabulary):
    parts, sizes = pieces(1, 60, vocabulary)
    piece, start, number, twice = S.word_repeats(parts, sizes, WORDS * S.CODE)
    texts = [p[a * S.CODE :][: WORDS * S.CODE] for p, a in ((parts[i], s) for i, s in zip(piece, start, strict=True))]
    assert len(texts) == sum((s - 1) // S.CODE + 1 for s in sizes) == len(set(zip(piece.tolist(), start.tolist(), strict=True)))
    assert len(set(zip(number.tolist(), texts, strict=True))) == len(set(texts)) == len(set(number.tolist()))
    assert twice.tolist() == [texts.count(t) > 1 for t in texts] and 0 < twice.sum()


def test_a_common_anchors_block_is_small():
    parts, sizes = pieces(2, 1500, 400)
    rows = pa.table({"anchor": [7] * 1500, "content": range(1500), "salt": pa.array([0] * 1500, pa.int32()), "hot": [False] * 1500, "size": pa.array(sizes, pa.int32()), "bytes": pa.array(parts, pa.binary())})
    tracemalloc.start()
    found = sum(b.num_rows for b in partial(S._blocks, WORDS * S.CODE, True)(iter(rows.to_batches())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found >= 500 and peak < 40 << 20  # bytes' starts took 8 times the rows, each 4 times as long


def test_suffixes_sorted_in_buckets(monkeypatch):
    rng = random.Random(4)
    text = np.frombuffer(bytes(rng.choice(b"abc") for _ in range(3000)), np.uint8)
    padded, places = np.concatenate([text, np.zeros(20, np.uint8)]), np.array(sorted(rng.sample(range(3000), 900)))
    want = sorted(places.tolist(), key=lambda p: padded[p : p + 20].tobytes())
    for size in (1, 50, 1 << 14):
        monkeypatch.setattr(S, "SORTED", size)
        assert S._sorted(padded, places, 20).tolist() == want
    assert S._sorted(padded, places[:0], 20).tolist() == []


def test_grams_have_the_hashes_of_their_ranges():
    buf = np.random.default_rng(6).integers(0, 256, 5000).astype(np.uint8)
    prefix = B.prefix_hash(buf)
    for width in (1, 16, 128, 5000):
        at = np.arange(len(buf) - width + 1)
        assert (B.gram_hash(prefix, width) == B.range_hash(prefix, at, at + width)).all()
