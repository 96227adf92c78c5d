"""Operators across documents against brute force: URL filters, chats, decontamination, near-dedup, suffix dedup, pipeline."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from runloom.llm import suffix_dedup as S
from runloom.llm.chat_format import chat_digest, chat_examples
from runloom.llm.components import components
from runloom.llm.decontaminate import contamination, decontaminate
from runloom.llm.near_dup import drop_near_duplicates, near_duplicates
from runloom.llm.queries import CONTROL_TEXT, URL_RULES
from runloom.llm.url_filters import url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


# --- URL filters


def brute_url(url: str | None) -> tuple:
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [(h + p, a) for h, p, a in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, action = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, action


URLS = [None, "", "x", "http://", "HTTP://Example.COM/en/70?x", "http://a.example.com/en/7", "http://a.example.com/en/6#f", "http://com/en/", "http://notexample.com/en/7", "https://w.x.example.net/de/8/9", "https://w.net/de/", "https://a.org/es/", "https://a.org/ES/", "http://a.org?x=/es/", "http://a.com://b/en/", "http://a..com/en/", "http://[::1]/x", "http://é.com/en/é\nq", "a://b.com" + "/x" * 3000, "http://a.example.com/en/7"]


def test_urls(spark):
    rows = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)], "page_id int, url string, host string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters(rows, rules).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(URLS)}
    none = url_filters(rows, rules.where("false"))
    assert none.count() == len(URLS) and none.where("verdict != 'allow' or rule is not null").count() == 0
    assert url_filters(rows.where("false"), rules).count() == 0
    plan = url_filters(rows, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- chats


def test_chats(spark):
    rng = random.Random(2)
    odd = [None, "", CONTROL_TEXT, "\\", "\\\\h", "### user: x </turn>\n", "a:b\\c <", "\n", "x" * 5000, "\\b\\l\\h"]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", None, "a:b"]), rng.choice(odd)) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(100, 0, "user", "only"), (101, 3, "assistant", "same"), (101, 3, "assistant", "same"), (None, 1, "user", "q"), (None, 2, "assistant", "r")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, turns string").repartition(3)
    examples = chat_examples(df)
    size = {}
    for r in examples.collect():
        size[r.conv_id] = size.get(r.conv_id, 0) + len(r.text)
        assert r.text.count(" </turn>\n") == r.example
    got = {r.conv_id: r for r in chat_digest(examples).collect()}
    assert set(got) == {r[0] for r in rows}
    for c in got:
        turns = sorted((t, role or "", text or "") for cc, t, role, text in rows if cc == c)
        loss = "".join(t[2] for t in turns if t[1] == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size[c])
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == want
    assert chat_digest(chat_examples(df.where("false"))).count() == 0


# --- decontamination


def test_contamination(spark):
    rng = random.Random(4)
    items = [(i, " ".join(prose(rng, n))) for i, n in enumerate([6, 12, 20, 30, 55, 80])] + [(6, "one two three"), (7, None), (8, ""), (9, "a b c d e")]
    docs = []
    for i in range(60):
        w = prose(rng, rng.choice([0, 3, 30, 400]))
        k = rng.randrange(6)
        piece = items[k][1].split()
        if i % 3 == 0:
            piece = [x if rng.random() > 0.05 else "zz" for x in piece]
        at = rng.randint(0, len(w))
        docs.append((i, " ".join(w[:at] + ([x.upper() for x in piece] if i % 2 else piece) + w[at:])))
    docs += [(60, None), (61, "One  two\tthree"), (62, "x one two three"), (63, " ".join(prose(rng, 20000) + items[2][1].split())), (64, docs[5][1]), (None, items[1][1])]
    df = spark.createDataFrame([(*d, "e") for d in docs], "doc_id long, text string, item_id string").repartition(3)
    it = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in contamination(df, it).collect()}
    want = {}
    for d, t in docs:
        for i, x in items:
            s = shingles(x)
            n = len(s & shingles(t))
            if d is not None and s and n >= 0.75 * len(s):
                want[d, i] = (len(s), n)
    assert got == want and len(want) > 30
    kept = {r.doc_id for r in decontaminate(df, it).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert contamination(df, it.where("false")).count() == 0 and contamination(df.where("false"), it).count() == 0


# --- near-dedup


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == root(x) for x in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus(rng: random.Random) -> list[tuple]:
    bases = [prose(rng, n) for n in (8, 40, 200, 1000)]
    docs = []
    for i in range(90):
        w = list(rng.choice(bases)) if i % 3 else prose(rng, rng.randint(1, 80))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
        docs.append((i * 3, " ".join(w)))
    common = prose(rng, 60)
    docs += [(1000 + i, " ".join(common + prose(rng, rng.choice([3, 5, 10, 14])))) for i in range(40)]  # a common passage, many not linked
    return docs + [(5000, None), (5001, ""), (5002, " \n"), (5003, "a b"), (5004, "A  b"), (5005, docs[4][1]), (None, docs[4][1]), (12, docs[4][1])]


def test_near_duplicates(spark):
    docs = corpus(random.Random(6))
    df = spark.createDataFrame([(d, t, "e") for d, t in docs], "doc_id long, text string, component_id string").repartition(4)
    sets = [(d, shingles(t)) for d, t in docs if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if both and 100 * both >= 75 * (len(s) + len(t) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = near_duplicates(df).collect()
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (root(r.doc_id), root(r.doc_id) == r.doc_id), r
            assert r.n_shingles in {len(s) for d, s in sets if d == r.doc_id}
    left = drop_near_duplicates(df).collect()
    assert {r.doc_id for r in left} == {d for d in parent if root(d) == d} | {None}
    assert near_duplicates(df.where("false")).count() == 0


def test_near_duplicates_of_a_repeated_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (2, b + " two more"), (3, a + " more"), (4, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert sorted((r.doc_id, r.text) for r in drop_near_duplicates(df).collect()) == [(1, a), (1, b), (4, "other")]
    late = spark.createDataFrame([(9, a), (9, b), (5, b + " two more"), (7, a + " more")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(late).collect()} == {(9, 5), (9, 7), (5, 5), (7, 7)}


# --- suffix dedup


def test_block_repeats():
    rng = random.Random(1)
    base = bytes(rng.choice(b"abc") for _ in range(200))
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 12)):
            m = rng.randint(1, 20)
            at = rng.randint(0, 150)
            parts.append(rng.choice([base[at : at + m + 11], b"a" * (m + 11), bytes(rng.choice(b"ab") for _ in range(m + 11))]))
        sizes = np.array([len(p) - 11 for p in parts])
        count: dict[bytes, int] = {}
        for p in parts:
            for j in range(len(p) - 11):
                count[p[j : j + 12]] = count.get(p[j : j + 12], 0) + 1
        piece, start, number, twice = S.block_repeats(parts, sizes, 12)
        assert len(piece) == sizes.sum() and len(set(number.tolist())) == len(count)
        assert all((count[parts[i][j : j + 12]] > 1) == t for i, j, t in zip(piece, start, twice))


def brute_words(texts: list[str | None], words: int) -> list[tuple]:
    """As brute_repeats() of strings of so many whole words; a run goes up to the word after it."""
    raw = [(t or "").encode() for t in texts]
    at = [[m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in raw]
    count: dict[tuple, int] = {}
    for b in raw:
        w = b.split()
        for i in range(len(w) - words + 1):
            count[tuple(w[i : i + words])] = count.get(tuple(w[i : i + words]), 0) + 1
    out = []
    for b, starts in zip(raw, at, strict=True):
        w, on = b.split(), np.zeros(len(b), bool)
        for i in range(len(w) - words + 1):
            if count[tuple(w[i : i + words])] > 1:
                on[starts[i] : [*starts, len(b)][i + words]] = True
        out.append((len(b), int(on.sum()), int((np.diff(np.concatenate([[0], on.astype(int)])) == 1).sum()), np.frombuffer(b, np.uint8)[~on].tobytes()))
    return out


def brute_repeats(texts: list[str | None], length: int = 400) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    count: dict[bytes, int] = {}
    for b in raw:
        for s in range(len(b) - length + 1):
            count[b[s : s + length]] = count.get(b[s : s + length], 0) + 1
    out = []
    for b in raw:
        cover = np.zeros(len(b) + 1, np.int32)
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                cover[s] += 1
                cover[s + length] -= 1
        on = np.cumsum(cover[:-1]) > 0
        out.append((len(b), int(on.sum()), int((np.diff(np.concatenate([[0], on.astype(int)])) == 1).sum()), np.frombuffer(b, np.uint8)[~on].tobytes()))
    return out


def test_suffix_dedup(spark):
    rng = random.Random(9)
    word = lambda n: " ".join(prose(rng, n))
    shared, accent = word(150), "é" * 350
    texts = [None, "", "short", shared, word(40) + shared + word(40), shared[100:600] + word(60), word(90), word(20) + shared[:399], "a" * 399, "b" * 401, "c" * 5000, "line of text.\n" * 80, accent, "x" + accent + "y", shared + "|" + shared, "ab" * 300]
    texts += [word(rng.randint(0, 20)) + shared[200:900] + word(5) for _ in range(25)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_spans int").repartition(4)
    want = brute_repeats(texts)
    got = S.remove_repeats(df).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) == want[r.doc_id], r.doc_id
    for words in (5, 50):
        passages = brute_words(texts, words + 1)
        for r in S.remove_repeats(df, over_words=words).collect():
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) == passages[r.doc_id], r.doc_id
    again = S.remove_repeats(df.unionByName(df.where("doc_id = 6"))).where("doc_id = 6").collect()
    assert [r.n_removed for r in again] == [len(texts[6].encode())] * 2
    clean = {r.doc_id: r.text for r in S.dedup_text(df).collect()}
    assert clean == {i: w[3].decode("utf-8", "ignore") for i, w in enumerate(want)}
    assert {r.n_spans for r in S.dedup_text(df).collect()} == {1}  # the input's own column
    assert S.remove_repeats(df.where("false")).count() == 0
    assert S.remove_repeats(df.where("false"), over_words=50).count() == 0


def test_suffix_dedup_of_passages(spark):
    rng = random.Random(15)
    word = lambda n: " ".join(prose(rng, n))
    long, short = word(52), word(50)  # the shorter one repeats too, but isn't cut
    texts = [word(30) + " " + long + " " + word(30), word(9) + "\n" + long.replace(" ", "\t "), word(20) + " " + short + " " + word(20), short, None, ""]
    a, b = word(30), word(30)  # side by side in one text only
    texts += [a + " " + b, word(9) + " " + a, b + " " + word(9), "x " * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_words(texts, 51)
    assert [w[1] > 0 for w in want] == [True, True, False, False, False, False, False, False, False, True]
    for r in S.remove_repeats(df, over_words=50).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) == want[r.doc_id], r.doc_id


def test_passages_are_found_at_every_length_of_word(spark):
    rng = random.Random(16)
    letters = "".join(chr(c) for c in range(0x61, 0x7B)) + "éß日本"
    texts = []
    for size in range(1, 12):
        make = lambda n, size=size: " ".join("".join(rng.choice(letters) for _ in range(size)) for _ in range(n))
        passage = make(51)
        texts += [make(20) + " " + passage + " " + make(20), make(3) + " " + passage, make(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in S.remove_repeats(df, over_words=50).collect()}
    assert got == {i: w[1:3] for i, w in enumerate(brute_words(texts, 51))} and all((got[i][1] == 1) == (i % 3 < 2) for i in got)


def test_many_equal_rows_stay_small(spark):
    rng = random.Random(17)
    text = " ".join(prose(rng, 1200))
    df = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(8)
    spans = S.repeated_spans(df)
    assert spans.count() == 1 and spans.select(F.size("spans")).first()[0] < 200
    assert S.remove_repeats(df).where(F.col("n_removed") == len(text)).count() == 2000


def test_blocks_of_one_anchor_meet_by_hash(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECES", 4)
    rng = random.Random(12)
    shared = " ".join(prose(rng, 150))
    texts = [" ".join(prose(rng, 12)) + f" {i} " + shared + " ".join(prose(rng, 12)) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_repeats(texts)
    assert all((r.n_removed, r.n_spans) == want[r.doc_id][1:3] for r in S.remove_repeats(df).collect())


# --- pipeline


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(21)
    text = lambda n: "\n".join(" ".join(x).capitalize() + "." for x in (prose(rng, 12) for _ in range(n)))
    base, item, block = text(12), " ".join(prose(rng, 25)), text(9)
    rows = [(1, base), (2, base), (3, base.replace("a", "a", 1) + "\nOne more line here."), (4, text(10) + "\n" + item + "."), (5, text(8)), (6, "too short"), (7, "\n".join(["x | y | z"] * 60)), (8, text(6) + "\n" + block), (9, text(7) + "\n" + block), (10, None)]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {1, 5, 8, 9}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip([1, 4, 5, 8, 9], (w[3].decode() for w in brute_words([dict(rows)[d] for d in (1, 4, 5, 8, 9)], 51))))
    assert {d: texts[d] for d in (1, 5, 8, 9)} == {d: want[d] for d in (1, 5, 8, 9)}


def test_pipeline_of_rows_that_repeat(spark, tmp_path):
    """One row of equal ones stays, with its text, whatever its id; an empty table gives none."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(22)
    text = lambda n: "\n".join(" ".join(x).capitalize() + "." for x in (prose(rng, 12) for _ in range(n)))
    a, b = text(12), text(12)
    rows = [(1, a), (1, a), (None, b), (None, b), (2, text(11)), (3, None), (3, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, some in (("full", rows), ("none", [])):
        spark.createDataFrame([(d, t, None, None, None) for d, t in some], schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = [(r.doc_id, r.n_tokens > 50) for r in pipeline.run(spark, f"{tmp_path}/full").collect()]
    assert sorted(got, key=repr) == sorted([(1, True), (None, True), (2, True)], key=repr)
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
