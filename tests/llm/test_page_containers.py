from __future__ import annotations

import pytest

from clickfold.llm import htmltext

TEXT = "The article itself, which is long enough, has a first sentence. And, as it goes, a second."
LONG = " ".join([TEXT] * 4)
BODY = f"<p>{TEXT}<p>{TEXT}"
SHORT = "Buy, now, cheap."
KEPT = [
    f'<div id="content" class="has-sidebar">{BODY}</div><div class="sidebar"><p>{SHORT}</div>',
    f'<main class="no-sidebar">{BODY}</main>', f'<main class="sidebar">{BODY}</main>',
    f'<article class="post category-social tag-advertising">{BODY}</article>',
    f'<div class="content-sidebar-wrap"><main>{BODY}</main><aside>{SHORT}</aside></div>',
    f'<div class="social"><article>{BODY}</article></div>',
    f'<div class="overflow-hidden">{BODY}</div>', f'<div class="promo">{BODY}</div>',
    f'<main><article><p>{TEXT}</article><article><p>{TEXT}</article></main>',
    f'<body><article><p>{TEXT}</article><article><p>{TEXT}</article>',
    f'<body><div><article><p>{TEXT}</article></div><div><article><p>{TEXT}</article></div>',
    f'<article><p>{TEXT}</p><section class="social-policy"><p>{TEXT}</section></article>',
]
GONE = [
    f'<div id="content">{BODY}</div><div class="comments-area"><p>{LONG}</div>',
    f'<article>{BODY}<div class="post-comments"><p>{TEXT}</div></article>',
    f'<article>{BODY}</article><div id="comments"><article class="comment-body"><p>{LONG}</article></div>',
    f'<article>{BODY}<div class="social-icons"><p>{SHORT}</div></article>',
    f'<article>{BODY}<div class="entry-footer">{SHORT}</div></article>',
    f'<article>{BODY}<ul><li><a href=x>One</a><li><a href=y>Two</a></ul></article>',
]


@pytest.mark.parametrize("page", KEPT + GONE)
def test_names_and_siblings(page):
    assert htmltext.main_text(page) == f"{TEXT}\n{TEXT}"


def test_references_and_tables_with_links_stay():
    page = f"""<article><p>{TEXT}<ol><li>Li, A. 2001. <a href=x>A title that is a good deal longer than the rest</a>.</ol>
    <table><tr><th>Town<th>People<tr><td><a href=x>A town with a long name</a><td>12 000</table></article>"""
    assert htmltext.main_text(page).split("\n") == [
        TEXT, "Li, A. 2001. A title that is a good deal longer than the rest.", "Town", "People", "A town with a long name", "12 000"]
