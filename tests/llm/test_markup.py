"""Markup that names parts by words of page furniture, and what of it is article text."""

import pytest

from docforge.llm import wrappers

TEXT = "<h1>Title</h1><p>Whole text of the article.</p>"
WHOLE = "Title Whole text of the article."


def text(html):
    return wrappers.Reader(html).main_text(frozenset(), None)


@pytest.mark.parametrize(
    "html",
    [
        f"<head><link rel=stylesheet id='cookie-notice-front-css'><meta id=search></head><body><article>{TEXT}</article>",
        f"<head><link rel=stylesheet id='wp-block-search-css' /></head><body><div>{TEXT}</div>",
        f"<head class=hidden><body><article>{TEXT}</article>",
        f"<body><article><hr class='ad'>{TEXT}<input id=search></article>",
        f"<div class='content has-sidebar'><article>{TEXT}</article></div>",
        f"<div class='no-sidebar'><article>{TEXT}</article></div>",
        "<article><header class='entry-header'><h1>Title</h1></header><p>Whole text of the article.</p></article>",
        "<article><header class='header'><h1 class=header>Title</h1></header><p>Whole text of the article.</p></article>",
        "<article><h1 id=comments>Title</h1><section id='side-effects'><p>Whole text</p></section><section id='related-work'>of the article.</section></article>",
        f"<article class='comments-open'>{TEXT}</article>",
        f"<div class='overlay'><main>{TEXT}</main></div>",
        f"<div class='  ' id=''>{TEXT}</div>",
        f"<div data-id='search'><article>{TEXT}</article></div>",
        f"<table><tr><td class=sidebar>Menu<td>{TEXT}</table>",
    ],
)
def test_article_text_is_whole(html):
    assert text(html) == WHOLE


@pytest.mark.parametrize("part", ["<div class='site-header'>x</div>", "<div class='cookie-notice'>x</div>", "<div id='related-posts'><article>x</article></div>", "<div class='ad-slot-1'>x</div>", "<div class='comments'><article>x</article></div>", "<ul class='main-nav'><li>x</ul>"])
def test_furniture_is_left_out(part):
    assert text(f"<body>{part}<div>{TEXT}</div>{part}") == WHOLE
