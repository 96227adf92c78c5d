"""Elements within a text that aren't block elements of it."""

from __future__ import annotations

import pytest

from runloom.llm.html_text import parse


def texts(source: str) -> list[str]:
    return [t for _, t in parse(source).blocks]


@pytest.mark.parametrize("name", "svg select template math object canvas audio video".split())
def test_without_end_tag_nothing_behind_is_lost(name):
    assert texts(f"<article><p>one</p><{name} class=x><p>two</p></article><p>three</p>") == ["one", "two", "three"]
    if name in ("svg", "select", "template"):
        assert texts(f"<p>one</p><{name}><p>two</p><p>a <{name}>gone</{name}>b</p>") == ["one", "two", "a b"]


@pytest.mark.parametrize("name", "math object canvas audio video".split())
def test_what_they_hold_is_text(name):
    assert texts(f"<p>a <{name}>x = 1</{name}> b</p>") == ["a x = 1 b"]


def test_unread():
    assert texts("<p>a <svg><svg>x</svg><title>t</title>y</svg>b</p><script>'<svg>'</script><p>c</p>") == ["a b", "c"]
