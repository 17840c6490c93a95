"""Main text of hand-made pages, names that training never saw, broken pages in linear time, and training against single trees."""

import random
import time

import numpy as np
import pytest

from gristmill.llm import pages

P = "The quick brown fox jumps over the lazy dog and then it sleeps."
Q = "Nobody saw it, but the old man at the mill heard a noise, he said."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav>'
FOOT = "<footer>&copy; site.example, all rights reserved</footer>"


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{NAV}{body}{FOOT}</body></html>"


@pytest.mark.parametrize(("body", "want"), [
    (f"<article><div><p>{P}</p></div></article>", [P]),
    (f"<article><div><div><div><p>{P}</p></div><div><p>{Q}</p></div></div></div></article>", [P, Q]),
    (f'<article data-hidden="false"><p>{P}</p></article>', [P]),
    (f'<article title="The hidden valley"><p>{P}</p></article>', [P]),
    (f'<article data-id="comments"><p>{P}</p></article>', [P]),
    (f"<article title='a class=\"comments\" b'><p>{P}</p></article>", [P]),
    (f'<article class="review"><p>{P}</p></article>', [P]),
    (f'<article class="more"><p>{P}</p></article>', [P]),
    (f'<article><p>{P}</p><p><a href="/x">Read the full report here</a></p><p>{Q}</p></article>', [P, "Read the full report here", Q]),
    (f"<article><p>{P}</p><ul><li><a href='/x'>First source</a></li><li>plain item</li><li><a href=/y>Second source</a></li></ul></article>", [P, "First source", "plain item", "Second source"]),
    (f"<article><p>{P}</p><svg width='1'/><p>{Q}</p><math/></article>", [P, Q]),
    (f"<article><p title=it's>{P}</p><p class=\"a'b\">{Q}</p></article>", [P, Q]),
    (f'<article hidden><p>{Q}</p></article><article><p>{P}</p></article>', [P]),
    (f'<article><p>{P}</p><div style="display: none"><p>{Q}</p></div></article>', [P]),
    (f'<article><p>{P}</p></article><section id="comments"><h2>Comments</h2><div class="comment"><p>{Q}</p></div></section>', [P]),
    (f'<div class="comments"><article><p>{Q}</p></article></div><article><p>{P} So it goes on.</p></article>', [f"{P} So it goes on."]),
    (f'<article><p>{P}</p><aside class="ad">Buy now, great offer today only!</aside><form><p>Sign up for our letter</p></form><p>{Q}</p></article><div class="cookie-banner"><p>We use cookies to improve this site.</p></div>', [P, Q]),
    ("<article><h1>Head &amp; tail</h1><p>Short.</p></article>", ["Head & tail", "Short."]),
    ("<div>" * 300 + f"<article><p>{P}</p></article>" + "</div>" * 300, [P]),
])
def test_shapes(body, want):
    assert pages.trained().extract(page(body)) == want


def test_pages_without_an_article():
    assert pages.trained().extract(f"<p>{P}</p>") == [P]
    assert pages.trained().extract("plain words only") == ["plain words only"]


def test_names_that_training_never_saw():
    other = {"menu": "topnav menuContainer nav-links sub_menu", "side": "aside-box widget_recent", "comment": "comments user-comment replyList", "foot": "footer_bottom foot", "top": "header-inner logo-header", "notice": "popup-modal cookie-notice", "advert": "adbox sponsor-block", "form": "search-form loginForm", "share": "sharing socialicons", "main": "prose articleText post main", "plain": "a b c d e zz q9 layout", "odd": "reviews feedback more tags"}
    assert pages.accuracy(pages.trained(), pages.labelled_pages(80, 5, other)) > 0.95


@pytest.mark.parametrize("part", ["<a ", "<", "<a \"", "<a b=\"", "<!", "</", "<p class=", "<svg>", "< ", "<a/", "<a b='x' ", "<!--", "<div>", "&", "<p", "='", "<title>"])
def test_a_million_letters_of_broken_markup(part):
    begun = time.time()
    pages.parse(part * (1_000_000 // len(part)))
    assert time.time() - begun < 3


def test_an_unclosed_quote_in_a_long_page():
    begun = time.time()
    pages.parse("<a " * 8000 + '"')
    assert time.time() - begun < 0.5
    assert [pages.words(b) for b in pages.parse('<p>one</p><p title="x>two</p><p>three</p>')[1]] == ["one", "two", "three"]


def test_parsing_never_fails():
    rnd = random.Random(6)
    pieces = ["<", ">", "/", "p", "div", "<p>", "</p>", "<div class=", '"', "'", "=", " ", "a", "<!--", "-->", "<script>", "</script>", "&amp;", "<li>", "<ul>", "</ul>", "<td>", "<a href=x>", "</a>", "x y", "<br/>", "<svg/>", "\n", "<body>", "hidden"]
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 40)))
        _, blocks = pages.parse(text)
        assert all(pages.words(b) for b in blocks)


def test_training_follows_the_messages_of_single_trees():
    """A step of fit() moves along the gradient that messages() of each tree gives."""
    made = pages.labelled_pages(12, 3)
    model, rate = pages.fit(made, rounds=1, rate=0.5), 0.5
    start, grad = pages.Model(), {}
    for p in made:
        root, blocks = pages.parse(p)
        texts = {b.order: pages.words(b) for b in blocks}
        nodes, content, joint, feats = start.beliefs(root, texts)
        share = {}
        for b in blocks:
            x = b
            while x is not None:
                share.setdefault(id(x), [0, 0])[int(bool(b.label))] += len(texts[b.order])
                x = x.parent
        for x, c, fs in zip(nodes, content, feats, strict=True):
            for f in fs:
                grad[f] = grad.get(f, 0.0) + float(share[id(x)][1] > share[id(x)][0]) - c
    for f, g in grad.items():
        # The first step's length is the rate, whatever the gradient's.
        assert model.weights[f] == pytest.approx(rate * np.sign(g) if abs(g) > 1e-6 else 0, abs=1e-2)
