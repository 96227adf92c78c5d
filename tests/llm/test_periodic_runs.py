"""Runs of words against every period tried in turn."""

import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("runloom.llm")
from runloom.llm import periodic_runs as P  # noqa: E402
from runloom.llm import queries  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w: list) -> list[tuple[int, int, int]]:
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)  # the smallest period of a stretch comes first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(600):
        texts = []
        for _ in range(rng.randint(1, 4)):
            letters, n = "abc"[: rng.randint(1, 3)], rng.randint(0, 50)
            w = [rng.choice(letters) for _ in range(n)]
            if n and rng.random() < 0.6:
                a, p = rng.randrange(n), rng.randint(1, 9)
                w = [w[i] if i < a else w[a + (i - a) % min(p, n - a)] for i in range(n)]
            texts.append(" ".join(w).encode())
        assert [r for _, r in P.text_runs(texts)] == [brute(t.split()) for t in texts], texts


def test_suffixes_are_sorted():
    import numpy as np

    rng = random.Random(3)
    for n in (1, 2, 30, 200):
        t = [rng.randrange(3) for _ in range(n)] + [99]
        want = [i for i in sorted(range(n), key=lambda i: t[i:]) if t.count(t[i]) > 1]
        assert P.suffix_order(np.array(t)).tolist() == want


def test_long_periodic_texts_stay_linear():
    (_, one), (_, three) = P.text_runs([b"a " * 100_000, b"a b c " * 30_000 + b"a"])
    assert one == [(0, 100_000, 1)] and three == [(0, 90_001, 3)]


def test_tests_in_parts_find_the_same(monkeypatch):
    texts = [b"a b a b a b a b c " * 20, b"x x x x x x x y " * 9]
    want = [r for _, r in P.text_runs(texts)]
    monkeypatch.setattr(P, "TESTED", 7)
    assert [r for _, r in P.text_runs(texts)] == want


def test_texts_of_every_kind(spark):
    rows = [(1, "a a a a a a a b", "x"), (1, "a a a a a a a b", "x"), (2, None, "x"), (3, "", "x"), (4, " \t\n", "x"), (None, "é é é é", "x"), (5, "u  v\tu v u v u v w", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in P.periodic_runs(docs).collect()), key=repr)
    one = (1, 8, [(0, 7, 1)], "a b")
    assert got == sorted([one, one, (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (0, 3, [], "é é é é"), (5, 9, [(0, 8, 2)], "u v w")], key=repr)
    assert P.periodic_runs(docs.where("false")).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "one"]) if i < 6 else " ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(rng.randint(1, 120)))) for i in range(150)]
    rows.append((None, "a a a a a a"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    damaged = 0
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        if doc_id is not None and w and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
            damaged += 1
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = brute(w)
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
        assert got[doc_id] == (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, *digests), doc_id
    assert damaged > 5
