"""The join of three-word sets against all pairs that share a shingle."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("runloom.llm")
from runloom.llm import ngram_join as N  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < 3 else [tuple(w[i : i + 3]) for i in range(len(w) - 2)])


def brute(rows: list[tuple]) -> dict:
    members, root = defaultdict(list), {}
    for i, text in rows:
        members[shingles(text)].append(i)
    sets = [s for s in members if s]
    inside, parent = defaultdict(list), list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in inside[g]:
                shared[j] += 1
            inside[g].append(k)
        for j, both in shared.items():
            if 100 * both >= 90 * (len(s) + len(sets[j]) - both):
                parent[find(k)] = find(j)
    for k, s in enumerate(sets):
        root[find(k)] = min(root.get(find(k), 1 << 60), *members[s])
    found = {i: (len(s), root[find(k)]) for k, s in enumerate(sets) for i in members[s]}
    return found | {i: (0, i) for i in members[frozenset()]}


def changed(rng: random.Random, words: list[str]) -> list[str]:
    words = list(words)
    for _ in range(rng.randint(0, max(1, len(words) // 40))):
        i = rng.randrange(len(words))
        words[i : i + 1] = [f"w{rng.randint(0, 999)}"] if rng.random() < 0.7 else []
        words = words or ["q"]
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    sizes = [0, 1, 2, 5, 10, 11, 12, 13, 14, 20, 25, 40, 60, 100, 200, 300]
    base = [[f"w{rng.randint(0, 999)}" for _ in range(rng.choice(sizes))] for _ in range(40)]
    common = [f"line{i}" for i in range(60)]
    rows = []
    for i in range(700):
        words = rng.choice(base)
        words = changed(rng, changed(rng, words)) if words else words
        if rng.random() < 0.15:
            words = common + words[: rng.randint(0, 12)]
        rows.append((i, " ".join(words).upper() if rng.random() < 0.2 else "\n".join(words)))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_shingles string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.ngram_join(docs).collect()}
    assert got == brute(rows)


def test_threshold_and_odd_rows(spark):
    words = [f"v{i}" for i in range(40)]
    at = [(1, " ".join(words[:11])), (2, " ".join(words[:12]))]  # 9 of 10
    under = [(3, " ".join(words[20:30])), (4, " ".join(words[20:31]))]  # 8 of 9
    odd = [(5, None), (6, ""), (7, " \t"), (8, "one two"), (9, "ONE  two"), (9, "one two"), (9, words[0]), (None, "one two"), (None, None)]
    long = [(20, " ".join(f"u{i}" for i in range(30_000))), (21, " ".join(f"u{i}" for i in range(27_001))), (22, " ".join(f"u{i}" for i in range(26_999)))]
    docs = spark.createDataFrame(at + under + odd + long, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in N.ngram_join(docs).collect() if r.doc_id is not None)
    assert got == [(1, 9, 1), (2, 10, 1), (3, 8, 3), (4, 9, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (9, 1, 8), (9, 1, 8), (9, 1, 9), (20, 29998, 20), (21, 26999, 20), (22, 26997, 20)]
    none = [tuple(r) for r in N.ngram_join(docs.where("doc_id is null")).collect()]
    assert sorted(none) == [(None, 0, None), (None, 1, None)]
    assert N.ngram_join(docs.where("false")).count() == 0


def test_bands_hold_what_the_pigeonhole_needs():
    n = np.arange(1, 60_000)
    band, own, low, segments = N.shape(n)
    for k, size in enumerate(n.tolist()):
        partners = range(-(-9 * size // 10), size + 1)
        if size < N.SMALLEST:
            assert own[k] < 0
        elif k % 97 == 0:
            for y in {partners[0], partners[-1]} & set(range(N.SMALLEST, size + 1)):
                differ = size + y - 2 * -(-9 * (size + y) // 19)
                assert differ <= (own[k] if band[y - 1] == band[k] else low[k]) and band[k] - band[y - 1] <= 1
                assert differ <= own[y - 1] and differ < segments[band[y - 1]]
        assert max(own[k], 0) < segments[band[k]] and low[k] < segments[band[k] - 1]


def test_keys_less_a_shingle_meet():
    rng = np.random.default_rng(1)
    whole = np.unique(rng.integers(0, 2**63, 50, dtype=np.uint64))
    less = np.delete(whole, 17)
    band, segments = np.array([4, 4]), np.array([6, 6])
    (a, b), (of, _), (without, _) = N.segment_keys([whole, less], band, segments)
    assert (a != b).sum() == 1 and without[17] == b[of[17]] and a.tolist().index(a[a != b][0]) == of[17]
