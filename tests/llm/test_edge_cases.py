"""Empty tables, clashing columns, long inputs, and pages whose class names mislead."""

import random
import sys

import pytest

pytest.importorskip("runloom.llm")
pytest.importorskip("public_tokenizers")
sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[2]))

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from runloom.llm import _bytes as B  # noqa: E402
from runloom.llm.bpe_automaton import Encoder, bpe_round_trip  # noqa: E402
from runloom.llm.html_text import TreeModel, extract, html_text  # noqa: E402
from runloom.llm.token_counts import token_counts  # noqa: E402
from runloom.llm.toxicity import toxicity  # noqa: E402
from runloom.llm.url_filters import url_filters  # noqa: E402

WORD_BPE, BYTE_BPE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
SENTENCES = "<p>This is a long paragraph of the article, with a sentence that ends somewhere further on in the line. And one more sentence follows here, to be sure.</p>" * 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n_tokens string")
    assert bpe_round_trip(none, WORD_BPE).count() == token_counts(none, BYTE_BPE).count() == 0


def test_walk_equals_the_library():
    import numpy as np

    rng = random.Random(4)
    library = Tokenizer.from_file(WORD_BPE)
    library.no_truncation()
    library.no_padding()
    parts = ["the", "ing", "tion", "é", "日本", "Ω", "'s", "!!", "1234", "<|endoftext|>", "</w>", "x" * 47, "y" * 48, "z" * 49, "q" * 300, "\t", "\n", "\u00a0"]
    texts = ["".join(rng.choice([*parts, " ", chr(rng.randint(33, 0x2FFF))]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    encoder = Encoder(WORD_BPE)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_range_hash_tells_thue_morse_texts_apart():
    import numpy as np

    bits = np.array([bin(i).count("1") % 2 for i in range(1 << 12)], np.uint8)
    buf = np.concatenate([bits + 97, 98 - bits]).astype(np.uint8)
    x, y = B.range_hash(B.prefix_hash(buf), np.array([0, 1 << 12]), np.array([1 << 12, 1 << 13]))
    assert x != y
    twice = np.concatenate([buf, buf])
    h = B.range_hash(B.prefix_hash(twice), np.array([5, 5 + len(buf)]), np.array([900, 900 + len(buf)]))
    assert h[0] == h[1]


@pytest.mark.parametrize("page", [
    "<form id=aspnetForm><div class=nav><a href=x>Home</a></div>{}</form>", "<div class='content-with-sidebar'>{}</div>",
    "<article><section class='share-price'>{}</section></article>", "<article>{}</article><nav><a href=x>More</a></nav>",
])
def test_frames_around_the_article_are_no_menus(page):
    assert extract(f"<html><body>{page.format(SENTENCES)}</body></html>", TreeModel.of({})).count("long paragraph") == 3


def test_talk_and_sidebars_stay_out():
    page = f"<body><article>{SENTENCES}</article><div class=comments><div>{SENTENCES * 4}</div></div><aside>{SENTENCES[:150]}</p></aside></body>"
    assert extract(page, TreeModel.of({})).count("long paragraph") == 3


def test_long_page_is_read_whole(spark):
    words = " ".join(f"word{i}" for i in range(60_000))
    page = f"<article><p>{words}.</p></article>"
    rows = spark.createDataFrame([(1, page, "old"), (2, None, "old"), (3, "", "old")], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in html_text(rows, model=TreeModel.of({})).collect()}
    assert got == {1: f"{words}.", 2: "", 3: ""}


def test_toxicity_of_clashing_columns_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a text", "x", 0.3), (2, None, "x", 0.3), (None, "", "x", 0.3), (2, "a text", "y", 0.1)], "doc_id long, text string, held_out string, score double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == 4 and all((r.score, r.predicted) == (0.5, 1) for r in got)


def test_urls_that_repeat(spark):
    rules = spark.createDataFrame([("com", "/en/", "block")], "host string, path string, action string")
    url = "http://www.example.com/en/" + "x" * 5000
    pages = spark.createDataFrame([(1, url), (1, url), (2, None), (3, "")], "page_id long, url string")
    got = sorted((r.page_id, r.verdict) for r in url_filters(pages, rules).collect())
    assert got == [(1, "block"), (1, "block"), (2, "allow"), (3, "allow")]
