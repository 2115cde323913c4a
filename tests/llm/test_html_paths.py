"""Scores of tag paths against a plain version that compares every two paths."""

import random
import time
from math import exp

import pytest

from cobblestone.llm import html_extract
from cobblestone.llm.html_extract import content

LONG = "This is a long paragraph, with commas, points and many more words. It goes on, and on, until it ends."


def ancestors(path, parents):
    out = []
    while path >= 0 and len(out) <= html_extract.REACH:
        out.append(path)
        path = parents[path]
    return out


def plain_scores(found, parents):
    keys = sorted({(b.path, b.root) for b in found})
    own = {k: [b for b in found if (b.path, b.root) == k] for k in keys}
    ratio = {}
    for k, group in own.items():
        marks = sum(b.text.count(c) for b in group for c in ".,;:!?…。，！？、")
        ratio[k] = sum(len(b.text) for b in group) / len(group) * (1 + marks / len(group))
    out = {}
    for k in keys:
        value = weight = 0
        for step, trunk in enumerate(ancestors(k[0], parents)):
            near = [ratio[o] for o in keys if o[1] == k[1] and trunk in ancestors(o[0], parents)]
            value += exp(-step * step / 2) * sum(near) / len(near)
            weight += exp(-step * step / 2)
        linked = sum(b.linked * len(b.text) for b in own[k]) / sum(len(b.text) for b in own[k])
        out[k] = value / weight * (1 - linked)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_scores_equal_a_plain_version(seed):
    rng = random.Random(seed)
    tags = ["div", "p", "ul", "li", "section", "article", "table", "td", "a", "b", "h2", "span class=x", "div id=a", "div id=b"]
    page = ""
    for _ in range(120):
        tag = rng.choice(tags)
        page += rng.choice([f"<{tag}>", f"</{tag.split()[0]}>", "some words, here. ", "x "])
    found, parents = html_extract.blocks(page)
    assert html_extract.path_scores(found, parents) == pytest.approx(plain_scores(found, parents))


def test_of_two_articles_both_stay():
    page = f"<main><article><h1>One</h1><p>{LONG * 20}</p><p>x</p></article></main><article><h2>Two</h2><p>Short one.</p></article>"
    assert content(page) == f"One\n{LONG * 20}\nx\nTwo\nShort one."


def test_lists_of_links_inside_an_article_go():
    links = "<ul>" + "<li><a href=x>See this page</a>" * 5 + "</ul>"
    page = f"<article><p>{LONG}</p>{links}<p>{LONG} <a href=y>More</a>, he said.</p><ul><li>one<li>two</ul></article>"
    assert content(page) == f"{LONG}\n{LONG} More, he said.\none\ntwo"


def test_without_a_content_root_the_ratios_decide():
    page = f"<div><span>12</span></div><div class=c><p>{LONG}</p><p>{LONG}</p></div><table><tr><td>a<td>b</table>"
    assert content(page) == f"{LONG}\n{LONG}"


def test_many_paths_and_deep_pages_take_linear_time():
    start = time.time()
    page = "".join(f"<div id=x{i}><p>{LONG}</p></div>" for i in range(20_000))
    assert content(page).count("\n") == 19_999
    assert content("<div>" * 20_000 + LONG) == LONG
    assert time.time() - start < 20
