"""Main text of pages without article elements, and of pages whose classes hold words that name something else elsewhere."""

import pytest

from careerlake.llm import templates

MENU, FOOT = "<nav><a>Home</a></nav>", "<div class='site-footer footer'>All rights</div>"
WORDS = "Long words of the text itself, told at length. " * 8


def texts(spark, pages):
    rows = [(k, url, html) for k, (url, html) in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def post(k):
    return f"<html><body>{MENU}<div class=post><h1>Title {k}</h1><div class=byline>By author {k}</div><div class=body><p>{WORDS}{k}</p></div><ul><li>point {k}</li></ul></div>{FOOT}</body></html>"


@pytest.mark.parametrize("n", [1, 12])
def test_short_parts_stay_without_an_article(spark, n):
    got = texts(spark, [("http://a.example.com/", post(k)) for k in range(n)])
    assert got == {k: f"Title {k} By author {k} {WORDS}{k} point {k}" for k in range(n)}


@pytest.mark.parametrize("n", [1, 12])
@pytest.mark.parametrize(
    "before,after",
    [
        ("<body class='has-sidebar'><article>", "</article></body>"),
        ("<body class='sidebar'><div id='page' class='with-sidebar no-ads'><article>", "</article></div></body>"),
        ("<body><article class='post share share-enabled'>", "</article></body>"),
        ("<body><div class='menu'><div class='widget'><article>", "</article></div></div></body>"),
    ],
)
def test_classes_around_the_text(spark, n, before, after):
    pages = [("http://b.example.com/", f"<html>{before}<h2 id='related-work'>Work {k}</h2><section id='search'><p>{WORDS}{k}</p></section>{after}</html>") for k in range(n)]
    assert texts(spark, pages) == {k: f"Work {k} {WORDS}{k}" for k in range(n)}


def test_what_stands_beside_the_text_goes(spark):
    page = f"<html><body class=sidebar>{MENU}<div class='sidebar left'>Beside</div><div class=post><p>{WORDS}</p><div class=comments>Said</div></div>{FOOT}</body></html>"
    assert texts(spark, [("http://c.example.com/", page)]) == {0: WORDS.strip()}


def test_comments_go_though_they_are_articles(spark):
    page = f"<html><body class=sidebar><article class='post share'><p>{WORDS}</p></article><div class='comments list'><article class=comment>Said</article></div><div id='page' class='with-sidebar'><p>x</p></div></body></html>"
    assert texts(spark, [("http://d.example.com/", page)]) == {0: WORDS.strip()}


def test_hyphenated_classes_are_no_asides(spark):
    page = f"<html><body class='has-sidebar'><div id='page' class='with-sidebar no-ads'><h2 id='related'>Work</h2><section id='search-results'><p>{WORDS}and <b>bo</b>ld</p></section></div></body></html>"
    assert texts(spark, [("http://e.example.com/", page)]) == {0: f"Work {WORDS}and bold"}
