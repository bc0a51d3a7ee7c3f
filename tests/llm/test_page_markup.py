from __future__ import annotations

import pytest

from clickfold.llm import htmltext

TEXT = "The article itself, which is long enough, has a first sentence. And, as it goes, a second."
OMITTED_ENDS = [
    f'<div id="content"><p class="byline">By X<p>{TEXT}<p>{TEXT}</div>',
    f'<div id="content"><p class="share">Share<p>{TEXT}<p>{TEXT}</div>',
    f'<ul><li class="share">Share<li>{TEXT}<li>{TEXT}</ul>',
    f'<dl><dt class="ad">Ad<dd>{TEXT}<dd>{TEXT}</dl>',
    f'<table><tr><td class="ad">Ad<td>{TEXT}<tr><td>{TEXT}</table>',
    f'<table><tr class="ad"><td>Ad<tr><td>{TEXT}<tr><td>{TEXT}</table>',
    f'<div><ul><li class="share">Share</ul><p>{TEXT}<p>{TEXT}</div>',
    f'<div><span class="share">Share</div><div><p>{TEXT}<p>{TEXT}</div>',
    f'<head><meta charset="utf-8"><title>T</title><body><p>{TEXT}<p>{TEXT}',
    f'<div><noscript><p>Switch it on</noscript><p>{TEXT}<p>{TEXT}</div>',
    f'<div><div class="share"><div>a</div><div>b</div></div><p>{TEXT}<p>{TEXT}</div>',
]


@pytest.mark.parametrize("page", OMITTED_ENDS)
def test_unwanted_elements_end_where_html_says(page):
    assert htmltext.main_text(page) == f"{TEXT}\n{TEXT}"
