from __future__ import annotations

import pytest

from clickfold.llm import htmltext

TEXT = "The article itself, which is long enough, has a first sentence. And, as it goes, a second."
FIRST, SECOND = "A first report on something, of two thousand and one", "Another report, by the same authors"


@pytest.mark.parametrize("tag", ["ul", "ol"])
def test_linked_references_of_an_article_stay(tag):
    page = f"<article><p>{TEXT}<p>{TEXT}<{tag}><li><a href=x>{FIRST}</a><li><a href=y>{SECOND}</a></{tag}></article>"
    assert htmltext.main_text(page).split("\n") == [TEXT, TEXT, FIRST, SECOND]


def test_menus_and_lists_outside_an_article_go():
    short = "<ul><li><a href=x>One</a><li><a href=y>Two</a></ul>"
    long = f"<ul><li><a href=x>{FIRST}</a><li><a href=y>{SECOND}</a></ul>"
    assert htmltext.main_text(f"<article><p>{TEXT}<p>{TEXT}{short}</article>") == f"{TEXT}\n{TEXT}"
    assert htmltext.main_text(f"<article><p>{TEXT}<p>{TEXT}</article>{long}") == f"{TEXT}\n{TEXT}"
    assert htmltext.main_text(f"<article><p>{TEXT}<p>{TEXT}<div class=related>{long}</div></article>") == f"{TEXT}\n{TEXT}"


def test_a_paragraph_goes_by_what_it_is():
    for name, stays in (("social-history", True), ("share-of-profits", True), ("social", False), ("advert", False)):
        page = f'<article><p>{TEXT}<p class="{name}">{TEXT}</article>'
        assert (htmltext.main_text(page) == f"{TEXT}\n{TEXT}") is stays, name
    assert htmltext.main_text(f'<article><p>{TEXT}<p class="share-links">Share this page</article>') == TEXT
