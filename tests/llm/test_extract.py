from __future__ import annotations

import html
import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from satbill.llm import extract, queries

SCHEMA = "page_id long, url string, html string"
P = ["The first paragraph of the story has a few sentences. It goes on for a while, as stories do.", "Short one.", "And the last paragraph ends the story, with more words than any menu entry has."]
BODY = "".join(f"<p>{p}</p>" for p in P)
STORY = " ".join(P)
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Topic {i}</a></li>' for i in range(6)) + "</ul>"
ODDS = extract.prices({})

PAGES = {
    "article": f"<html><body><nav>{MENU}</nav><article><h1>Title</h1>{BODY}</article><footer>&copy; me</footer></body></html>",
    "classes": f'<body><div id="top-nav">{MENU}</div><div class="post-body content"><h1>Title</h1>{BODY}</div><div class="sidebar"><p>{P[0]}</p></div></body>',
    "comments": f'<main><h1>Title</h1>{BODY}<section id="comments"><article class="comment"><p>{P[0]}</p></article><h3>Replies</h3></section></main>',
    "within": f'<article><header class="entry-header"><h1>Title</h1></header><p>{P[0]}</p><div class="ad"><p>Buy this now. It is good.</p></div><p>{P[1]}</p><p>{P[2]}<aside>Related reading</aside></article>',
    "form": f'<form id="aspnetForm"><div class="header">{MENU}</div><article><h1>Title</h1>{BODY}</article><label>Name <input></label><button>Send</button></form>',
    "notice": f'<div class="cookie-notice"><p>We use cookies. Read on, please.</p></div><div role="main"><h1>Title</h1>{BODY}</div>',
    "layout": f'<body class="has-sidebar"><div class="page-with-sidebar"><div class="siteNav">{MENU}</div><div class="articleBody"><h1>Title</h1>{BODY}</div></div></body>',
    "no names": f"<body><div>{MENU}</div><div><h1>Title</h1>{BODY}</div><div>Copyright 2020 by someone</div></body>",
    "scripts": f"<head><title>x</title><style>p {{}}</style></head><article><h1>Title</h1><script>var t='<p>no</p>'</script>{BODY}<!-- <p>no</p> --></article><noscript><p>no no no</p></noscript>",
    "unclosed": f"<article><h1>Title</h1><p><b>{P[0]}<br><p>{P[1]}<p>{P[2]}</article><footer>foot",
    "controls": f"<article><h1>Title</h1>{BODY}<select><option>One<option>Two</select><button>Send<p>more</button></article><div hidden><p>no no</p></div>",
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    assert extract.main_text(PAGES[name], ODDS) == f"Title {STORY}"


def test_text_rules():
    page = "<article><p>a &amp;&lt;b&gt;\n\t c<i>d</i>&nbsp;e<br>f &copy g &#233;</p>\n<p> x<wbr>y </p></article>"
    assert extract.main_text(page, ODDS) == "a &<b> cd e f © g é xy"


@pytest.mark.parametrize("page", [None, "", " ", "<", "<<<a <b", "<p", "</p></div>", "<!--", "<script>", "<a href='x>y", "<table><tr><td><li></tr></ul>", "<p title=\"a>b\">", "\x00<\x00>", "<select><p>x"])
def test_broken_pages_are_read(page):
    assert isinstance(extract.main_text(page, ODDS), str)


def test_long_and_deep_pages_take_time_in_proportion():
    words = " ".join(f"w{i}" for i in range(200_000))
    assert extract.main_text(f"<article><p>{words}</p></article>", ODDS) == words
    assert extract.main_text("<article>" + "<div>" * 50_000 + f"<p>{P[0]}</p>", ODDS) == P[0]
    many = "<article>" + f"<p>{P[0]}" * 20_000 + "</article>"
    assert len(extract.main_text(many, ODDS)) == (len(P[0]) + 1) * 20_000 - 1
    assert extract.main_text("<" * 200_000 + "<!--" * 50_000 + "<a =\"" * 50_000, ODDS) is not None


def test_cut_is_the_cheapest_labelling():
    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.randrange(1, 8)
        gains = [rnd.randrange(-6, 7) for _ in range(n)]
        edges = [(i, j, rnd.randrange(0, 5)) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.5]

        def cost(labels):
            own = sum((g < 0) * -g if x else (g > 0) * g for g, x in zip(gains, labels, strict=True))
            return own + sum(c for i, j, c in edges if labels[i] != labels[j])

        best = min(cost(x) for x in product((False, True), repeat=n))
        largest = max((x for x in product((False, True), repeat=n) if cost(x) == best), key=sum)
        assert tuple(extract.min_cut(gains, edges)) == largest


def test_prices_move_neighbours():
    """A short block between long ones of an unnamed container is content by its neighbours alone."""
    page = f"<div><p>{P[0]}</p><p>Yes</p><p>{P[2]}</p></div>"
    (_, short, _) = extract.blocks(page)
    assert extract.gain(short, ODDS) < 0 and "Yes" in extract.main_text(page, ODDS)


def plain(page):
    inner = re.search("<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub("</?(?:p|br|h1)>", " ", re.sub("</?b>", "", inner))).split())


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in queries.op12_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(plain(r.html)) and got[r.page_id].url == r.url


def test_rows(spark):
    rows = [(1, "u", PAGES["article"]), (1, "u", PAGES["article"]), (None, None, PAGES["article"]), (2, "v", None), (3, "v", ""), (4, "", "<p>")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("clash"))
    got = extract.extracted(df, extract.fitted(df)).collect()
    story = f"Title {STORY}"
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, story, len(story)), (1, story, len(story)), (1, story, len(story)), (2, "", 0), (3, "", 0), (4, "", 0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert extract.extracted(empty, extract.fitted(empty)).count() == 0 and extract.fitted(empty) == ODDS
