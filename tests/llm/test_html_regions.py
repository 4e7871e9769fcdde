"""Regions of pages whose main text is not marked the usual way."""

from lexloom.llm import html

P1, P2 = "Text of the article that goes on for a while, and then some more.", "More of it here in a second paragraph, long enough to be prose."
TALK = "".join(f"<div><b>{who}</b><time>today</time><p>{'I have a very long opinion on all of this. ' * 9}</p></div>" for who in ("Ann", "Bob"))


def text(body: str) -> list[str]:
    return html.main_text(f"<html><body>{body}</body></html>").split("\n\n")


def test_a_lone_article_wins_over_a_longer_discussion():
    assert text(f"<article><h1>T</h1><p>{P1}</p><p>{P2}</p></article><section class='discussion'>{TALK}</section>") == ["T", P1, P2]
    assert text(f"<main><p>{P1}</p><p>{P2}</p></main><section class='talk'>{TALK}</section>") == [P1, P2]


def test_a_teaser_beside_the_main_part_is_no_region():
    got = text(f"<main><h1>T</h1><p>{P1}</p><p>{P2}</p></main><div><article><h2>Other</h2><p>Short.</p></article></div>")
    assert got == ["T", P1, P2]


def test_headers_of_entries_named_by_parts_stay():
    for name in ("article-body", "entry-content", "post-content", "articleBody", "post"):
        assert text(f"<div class='{name}'><header><h1>T</h1></header><p>{P1}</p><p>{P2}</p></div>") == ["T", P1, P2], name
    assert text(f"<header><h1>Site</h1><p>Slogan of it</p></header><div class='article-list'><h1>T</h1><p>{P1}</p><p>{P2}</p></div>") == ["T", P1, P2]


def test_words_of_size_are_no_second_meaning():
    assert text(f"<article><h1>T</h1><p>{P1}</p><div class='promo-box-large'>Buy our new product now.</div><p>{P2}</p></article>") == ["T", P1, P2]


def test_links_and_rights_in_the_bare_body_go():
    assert text(f"<a href='/'>Home</a> | <a href='/n'>News</a><div class='content2'><h1>T</h1><p>{P1}</p><p>{P2}</p></div>Copyright 2024 Imprint and privacy") == ["T", P1, P2]
    assert html.main_text("<body>Copyright law is a broad field.</body>") == "Copyright law is a broad field."
