"""Passages of over 50 words that are shorter than the 400 bytes that op7 removes."""

from __future__ import annotations

import random

from test_corpus_operators import brute_repeats, brute_words

from runloom.llm import suffix_dedup as S
from runloom.llm.queries import op7_suffix_array_dedup


def _texts() -> list[str | None]:
    rng = random.Random(31)
    make = lambda n, size: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(size)) for _ in range(n))
    short, wide, few = make(52, 4), make(80, 7), make(40, 12)  # 259, 639 and 519 bytes
    texts = [make(30, 5) + " " + short + " " + make(30, 5), make(9, 5) + "\n" + short, make(60, 5) + " " + wide, wide + " " + make(4, 5), make(20, 5) + " " + few, few + " " + make(20, 5), make(90, 6), None, "", " \n ", "x " * 200]
    return texts + [make(50, 4) + " . " + make(50, 4) for _ in range(20)]


def test_op7_reports_passages_under_400_bytes(spark, tmp_path):
    texts = _texts()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in op7_suffix_array_dedup(spark, str(tmp_path)).collect()}
    removed, passages = brute_repeats(texts), brute_words(texts, 51)
    assert {i: (r.n_bytes, r.n_removed, r.n_spans) for i, r in found.items()} == {i: w[:3] for i, w in enumerate(removed)}
    assert {i: (r.n_passages, r.passage_bytes) for i, r in found.items()} == {i: (w[2], w[1]) for i, w in enumerate(passages)}
    assert [found[i].n_removed > 0 for i in range(7)] == [False, False, True, True, True, True, False]
    assert [found[i].n_passages for i in range(7)] == [1, 1, 1, 1, 0, 0, 0]


def test_passages_of_one_anchor_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECES", 4)
    rng = random.Random(32)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(n))
    shared = make(70)
    texts = [make(12) + f" {i} " + shared + " " + make(12) for i in range(40)] + [make(90), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, bytes_ = brute_words(texts, 51), brute_repeats(texts)
    for r in S.remove_repeats(df, passage_words=50).collect():
        assert (r.n_passages, r.passage_bytes) == (want[r.doc_id][2], want[r.doc_id][1])
        assert (r.n_removed, r.n_spans) == bytes_[r.doc_id][1:3]


def test_long_texts_are_searched_in_stretches_of_words(spark, monkeypatch):
    monkeypatch.setattr(S, "STRETCH", 64)
    rng = random.Random(33)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(n))
    shared = make(120)
    texts = [make(300) + " " + shared + " " + make(200), make(7) + " " + shared, make(150)]
    rows = [(i, i, t) for i, t in enumerate(texts)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"id": a, "k": b, "text": t} for a, b, t in rows])
    found = [r for out in S._anchored(51 * S.CODE, True, iter([batch])) for r in out.to_pylist()]
    for i, t in enumerate(texts):  # every start of a passage once
        starts = sorted(s // S.CODE for r in found if r["id"] == i for s in range(r["first"], r["first"] + r["size"], S.CODE))
        assert starts == list(range(len(t.split()) - 50))
