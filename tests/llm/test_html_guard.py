"""Operator 7: which neighbour is a copy, and what never goes by its name."""

import random

import pytest

from tessera.llm import html_extract
from tessera.llm.html_extract import blocks, is_copy, main_text


def texts(spark, rows):
    return {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def page(*lines):
    return "".join(f"<p>{x}</p>" for x in lines)


@pytest.mark.parametrize("menu", [10, 30, 300])
def test_short_articles_lose_long_menus(spark, menu):
    lines = [f"menu entry number {i}" for i in range(menu)]
    found = texts(spark, [(k, f"http://a/{k}", page(*lines, f"short text {k}")) for k in range(5)])
    assert found == {k: f"short text {k}" for k in range(5)}


@pytest.mark.parametrize("copies", [2, 3, 11, 40])
def test_copies_are_no_mates_however_many_stand_between(spark, copies):
    """Copies of one article, with a word of their own, stand together; far off stand pages with the same menu."""
    menu = [f"menu {i}" for i in range(4)]
    article = [f"paragraph {i} of an article that others carry as well" for i in range(12)]
    rows = [(k, f"http://a/{k:03d}", page(*menu, f"word {k}", *article)) for k in range(copies)]
    rows += [(100 + k, f"http://a/{100 + k}", page(*menu, *(f"own line {i} of page {k} here" for i in range(9)))) for k in range(copies)]
    found = texts(spark, rows)
    for k in range(copies):
        assert found[k] == "\n\n".join([f"word {k}", *article])
        assert found[100 + k] == "\n\n".join(f"own line {i} of page {k} here" for i in range(9))


def test_a_host_of_copies_only_keeps_their_text(spark):
    article = [f"paragraph {i} of an article" for i in range(12)]
    rows = [(k, f"http://a/{k}", page(*article, f"word {k}")) for k in range(2)] + [(7, "http://b/1", page(*article))] * 3
    found = texts(spark, rows)
    assert found == {0: "\n\n".join([*article, "word 0"]), 1: "\n\n".join([*article, "word 1"]), 7: "\n\n".join(article)}


def test_shared_lines_against_a_plain_version():
    rng = random.Random(8)
    for _ in range(300):
        make = lambda: [rng.randint(0, 6) for _ in range(rng.randint(0, 9))]
        own, near, wide = make(), make(), [x for x in range(7) if rng.random() < 0.3]
        sizes = [3 + x for x in own]
        this = {"hashes": own, "sizes": sizes, "content": 1, "wide": wide, "path": "/a"}
        best = longest(own, near)
        shared = html_extract.common_lines(own, near)
        assert len(shared) == best
        rest = [i for i, x in enumerate(own) if x not in wide] or list(range(len(own)))
        mirrored = sum(sizes[i] for i in rest if i in shared) > 0.8 * sum(sizes[i] for i in rest)
        assert is_copy(this, {"hashes": near, "content": 2}, shared) == mirrored
        got = html_extract.shared_lines(this, [{"hashes": own, "content": 1, "path": "/a"}, {"hashes": near, "content": 2, "path": "/a"}])
        assert got == (None if mirrored else shared)


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_headings_and_paragraphs_never_go_by_name():
    html = "<article><h2 id='menu'>Menu of the day</h2><p class='notice'>Soup is off.</p><div class='menu'><p>home</p></div><p>Fish is on and more of it.</p></article>"
    assert blocks(html)[0] == ["Menu of the day", "Soup is off.", "Fish is on and more of it."]


def test_form_around_the_page():
    article = "<article><h1>Title</h1><p>Some words of the article that are most of the page.</p></article>"
    search = "<form><p>search</p></form>"
    for start in ("<form action='/x'>", "<div class='menu'>", "<form><div id='sidebar'>"):
        html = f"<html><body>{search}{start}<nav><p>home</p></nav>{article}<footer><p>foot</p></footer>"
        assert blocks(html)[0] == ["Title", "Some words of the article that are most of the page."]
    assert blocks(f"<body>{article}<form><p>name</p><p>mail</p></form>")[0] == ["Title", "Some words of the article that are most of the page."]
    assert blocks("<form><p>only a form</p></form>")[0] == ["only a form"]
