"""Operators on single texts against brute force: quality rules, token counts, BPE, HTML, toxicity."""

from __future__ import annotations


import random
import re
import struct
import zlib
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from runloom.llm import html_text as H  # noqa: E402
from runloom.llm.bpe_automaton import Automaton, bpe_decode, bpe_encode, bpe_round_trip  # noqa: E402
from runloom.llm.quality import clean_documents, quality_rules  # noqa: E402
from runloom.llm.token_counts import token_counts  # noqa: E402
from runloom.llm.toxicity import held_out, toxicity  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "a b\n\na b\n", "é" * 300, "x " * 20_000, "<|endoftext|>", "a<|endoftext|> <|startoftext|>B", "don't I'LL 12½ ﬁ ÉCOLE Σσς İ\u0085\u200b", "a\x00b\x1cc\u2028d", "日本語 text 😀😀", "hahahaha" * 40, "|#$%&*<>" * 30]


def texts() -> list[str | None]:
    rng = random.Random(11)
    out = list(ODD)
    syllables = ["th", "an", "in", "er", "ion", "é", "st", "Ou", ",", ".", "\n", " ", "  ", "\t", "#", "|", "A", "!!"]
    for n in (3, 40, 200, 400, 900):
        out += ["".join(rng.choice(syllables) for _ in range(n)) for _ in range(6)]
    return out + [out[-1], out[-1]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts())], "doc_id long, text string, n_words string").repartition(3)


def brute_quality(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked), n < 50 or 100 * len(marked) > 50 * n


def test_quality_counts(docs):
    got = quality_rules(docs).collect()
    assert len(got) == len(texts())
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(texts()[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)


def test_quality_lines(spark):
    good = "The first line of this text has many words and ends with a stop, as lines of prose do. " * 5
    bad = ["home | about | news | contact | help", "HOME PAGE OF THE BEST SHOP IN TOWN BUY NOW", "All rights reserved.", "go go go go go go go go go.", "one two three four five six seven eight"]
    rows = [(0, good), (1, good + "\n" + "\n".join(bad)), (2, "\n".join(b + f" x{i}" for i in range(30) for b in bad)), (3, good[:-2])]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[0].base_failed  # says the same five times
    varied = " ".join(f"Word{i} number{i * 7} says thing{i * 3} here." for i in range(30))
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame([(0, varied), (1, varied + "\n" + "\n".join(bad)), (2, rows[2][1])], "doc_id int, text string")).collect()}
    assert got[0].kept and got[0].clean_text == varied and got[1].kept and got[1].clean_text == varied and not got[2].kept


def test_cleaned_documents_keep_their_columns(spark):
    varied = " ".join(f"Word{i} number{i * 7} says thing{i * 3} here." for i in range(30))
    df = spark.createDataFrame([(0, varied + "\na | b | c | d", "own", 5), (1, "short", "own", 5)], "doc_id int, text string, kept string, n_chars int")
    assert [tuple(r) for r in clean_documents(df).collect()] == [(0, varied, "own", len(varied))]


def test_quality_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_counts(docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect():
        t = texts()[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) and r.over_limit == (r.n_tokens > 1024)


def test_bpe_matches_the_library(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    encoded = bpe_encode(docs, path)
    back = {r.doc_id: r.decoded for r in bpe_decode(encoded, path).collect()}
    both = {r.doc_id: (bytes(r.ids), r.n_tokens, r.decoded) for r in bpe_round_trip(docs, path).collect()}
    for r in encoded.collect():
        assert both[r.doc_id] == (bytes(r.ids), r.n_tokens, back[r.doc_id])
        ids = tok.encode(texts()[r.doc_id] or "", add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
        assert back[r.doc_id] == tok.decode(ids, skip_special_tokens=False)


def test_automaton_rejects_what_merging_never_gives():
    a = Automaton(public_tokenizers.path("word_bpe_49k.json"))
    assert not a.step("t", "h") and a.path(list("th") + ["e</w>"]) == ["the</w>"]
    assert a.path(list("ha" * 3) + ["h", "a</w>"])  # self-overlapping merges
    assert [len(t) for t in a.path(["q"] * 5 + ["q</w>"])] == [len(t) for t in a.path(["q"] * 5 + ["q</w>"])]


LONG = "This is a long paragraph of the story, with more than forty letters and a full stop. " * 2


def page(i: int) -> str:
    return f"<html><head><title>t</title></head><body><nav><ul><li><a href=x>menu {i}</a></li></ul></nav><div class=\"ad\">Buy this thing now, it is {i} times better.</div><article><h1>Head {i}</h1><p><b>{LONG}<br><p>Be &amp; do&nbsp;it.</p></article><footer>foot {i}</footer></body></html>"


def test_html(spark):
    sets = [page(i) for i in range(30)]
    more = [
        (f"<body><div id='header'><a href=x>Home</a></div><div class='content'><h1>Title</h1><p>{LONG}</p><p>Short.</p><div class='ad'><p>{LONG}</p></div></div><div class='sidebar'><p>{LONG}</p></div><div class=comments><p>{LONG}</p></div></body>", "Title\n\n" + LONG.strip() + "\n\nShort."),
        (f"<main><h1>T</h1><p>{LONG}<aside>{LONG}</aside><p>last one.</main><form><p>{LONG}</p></form>", "T\n\n" + LONG.strip() + "\n\nlast one."),
        ("", ""), (None, ""), ("<script>if (a < b) {}", ""), ("<nav><a>x</a></nav>", ""),
    ]
    rows = [(i, "u", h, "old") for i, h in enumerate([*sets, *(m[0] for m in more)])]
    got = {r.page_id: r for r in H.html_text(spark.createDataFrame(rows, "page_id int, url string, html string, text string")).collect()}
    for i in range(30):
        assert got[i].text == f"Head {i}\n\n{LONG.strip()}\n\nBe & do it." and got[i].n_chars == len(got[i].text)
    for k, (_, want) in enumerate(more):
        assert got[30 + k].text == want
    assert H.html_text(spark.createDataFrame([], "page_id int, html string")).count() == 0


def test_tree_marginals_are_exact():
    model = H.TreeModel.of({"tag p": (3, 9), "given 2 0 1": (1, 9), "given 2 0 0": (9, 1), "given 0 0 0": (9, 2), "given 0 0 1": (1, 5), "text 1 0 1": (3, 7)})
    p = H.parse("<div><p>Some words that are here.</p><div><p>x</p></div></div>")
    n = len(p.tag)
    import itertools
    import math

    total, on = 0.0, [0.0] * n
    for state in itertools.product((0, 1), repeat=n):
        w = (0.02 if state[0] else 0.98) * math.exp(sum(model.ratio.get(f, 0.0) for i in range(n) if state[i] for f in H.feature_names(p, i)))
        for i in range(1, n):
            q = model.given[H.link(p, i)][state[p.parent[i]]]
            w *= q if state[i] else 1 - q
        total += w
        for i in range(n):
            on[i] += w * state[i]
    for i, odds in enumerate(model.marginals(p)):
        assert abs(1 / (1 + math.exp(-odds)) - on[i] / total) < 1e-9


def toxic_rows(n: int):
    rng = random.Random(5)
    plain = ["alpha", "bravo", "carol", "delta", "eagle", "fable", "grape", "house", "india", "joker"]
    bad = ["scumbag", "scumlord", "vileness", "vileling", "rottener"]
    out = []
    for i in range(n):
        toxic = rng.random() < 0.25
        words = [rng.choice(plain) + rng.choice("abcdef") for _ in range(60)]
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(60)] = rng.choice(bad)
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows(800)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (9002, "scumbag " * 5000), (3, rows[3][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == 804 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[9000].score == by[9001].score < 0.5 < by[9002].score


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity(docs, none).collect()] == [(0.5, 1)]
    assert toxicity(docs.where("false"), none).count() == 0
    assert spark.range(1).select(held_out(F.lit(None).cast("long"))).first()[0] is False


