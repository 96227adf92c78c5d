"""Words in attributes that aren't marks, tags with open quotes, and pages against a plain reader."""

from __future__ import annotations

import html
import random
import time
from html.parser import HTMLParser

import pytest

pytest.importorskip("runloom.llm")
from runloom.llm.html_text import TreeModel, attributes_of, extract, html_text, parse  # noqa: E402

SENTENCES = "<p>This is a long paragraph of the article, with a sentence that ends somewhere further on in the line. And one more sentence follows here, to be sure.</p>" * 3
MODEL = TreeModel.of({})


@pytest.mark.parametrize("page", [
    '<article title="the hidden treasure">{}</article>', '<article class="prose w-full hidden md:block">{}</article>', '<article class="commentary">{}</article>',
    '<article><section class="discussion">{}</section></article>', '<article><section id="how-to-respond">{}</section></article>', '<article><section class="commentary">{}</section></article>',
    '<article><section data-note="use display: none">{}</section></article>', '<article data-hidden="no">{}</article>', '<div class="comments">{}</div>',
])
def test_words_that_are_no_marks(page):
    assert extract(f"<html><body>{page.format(SENTENCES)}</body></html>", MODEL).count("long paragraph") == 3


@pytest.mark.parametrize("mark", ["hidden", 'hidden=""', 'style="color:red; display : none"', 'class="comments"', 'id="comment-list"', 'id="disqus_thread"', 'class="x user-comments"'])
def test_marks_inside_an_article(mark):
    page = f"<body><article>{SENTENCES}<div {mark}><div>{SENTENCES * 2}</div></div></article></body>"
    assert extract(page, MODEL).count("long paragraph") == 3


def test_attributes():
    assert attributes_of(""" Class = "a b" id='x>y' HIDDEN data-a=1 data-b="it's" class=late /""") == {"class": "a b", "id": "x>y", "hidden": "", "data-a": "1", "data-b": "it's"}
    assert attributes_of("a='open b=2") == {"a": "", "open": "", "b": "2"}


@pytest.mark.parametrize("unit", ["<a '", '<a "', "<a '>", "<a \"'>", "<p x='\">y", "<a b=\"'", "<", "<!", "<a", "</"])
def test_open_quotes_are_read_in_linear_time(unit):
    began = time.perf_counter()
    parse(unit * (1_000_000 // len(unit)))
    parse(unit * (1_000_000 // len(unit)) + ">")
    assert time.perf_counter() - began < 20


def test_an_open_quote_ends_at_the_next_tag_end():
    assert [t for _, t in parse("<p>one</p><p title='x>two</p><p>three</p>").blocks] == ["one", "two", "three"]
    assert [t for _, t in parse("<p>a < b and c > d</p>").blocks] == ["a < b and c > d"]
    assert [t for _, t in parse("<p>one</p><a 'two").blocks] == ["one", "<a 'two"]


class Reader(HTMLParser):
    """Texts of the blocks of a well-formed article, read by the standard library."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.on = [""], False

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        if tag in ("p", "h1", "div", "article"):
            self.out.append("")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "div", "article"):
            self.out.append("")
        self.on &= tag != "article"

    def handle_data(self, data):
        if self.on:
            self.out[-1] += data


def test_articles_equal_a_plain_reader(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(2, 9)))
    rows = []
    for i in range(60):
        inner = []
        for _ in range(rng.randint(2, 7)):
            words = [rng.choice([html.escape(word()), "<b>" + word() + "</b>", "&amp;", "&lt;x&gt;", "&nbsp;", "caf&eacute;"]) for _ in range(rng.randint(30, 60))]
            inner.append(f"<p{rng.choice(['', ' class=lead', ' title=\"hidden > comment\"'])}>{rng.choice([' ', chr(10)]).join(words)}.</p>")
        ad = f'<div class="ad">{word()} now {word()}</div>'
        body = f'<nav><a href="/x">{word()}</a></nav>{ad}<article><h1>{word()} {word()}</h1>{"".join(inner)}</article><footer>{word()}</footer>'
        rows.append((i, f"<html><head><title>{word()}</title></head><body>{body}</body></html>"))
    got = {r.page_id: r.text for r in html_text(spark.createDataFrame(rows, "page_id int, html string")).collect()}
    for i, page in rows:
        reader = Reader()
        reader.feed(page)
        assert got[i] == "\n\n".join(t for t in (" ".join(x.split()) for x in reader.out) if t), i
