"""Main text of pages that were written by hand, apart from the generator of the training pages; time; edge cases."""

import time

import pytest

from usage_trace.llm import html_extract

PROSE = [
    "The bridge over the river was closed on Monday after engineers found cracks in two of its supports.",
    "A spokesman said that repairs would take at least three weeks, and that buses would go another way until then.",
    "Shops on both sides fear for their business. Some of them have asked the council for help.",
    "In 1962 the same bridge had been shut for a whole summer, when a barge struck its middle pier.",
]
P = "".join(f"<p>{x}</p>" for x in PROSE)
ALL = "\n".join(PROSE)
PAGES = {
    "bare divs": (f"<html><body><div><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></div><div><h1>Bridge closed</h1>{P}</div><div>© 2020 The Paper. All rights reserved.</div></body></html>", "Bridge closed\n" + ALL),
    "bare nested divs": (f"<body><div><div><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></div><div><div><h2>Bridge closed</h2>{P}</div></div></div>", "Bridge closed\n" + ALL),
    "body alone": (f"<body><h1>Bridge closed</h1>{P}</body>", "Bridge closed\n" + ALL),
    "table layout": (f"<table><tr><td><a href=/a>One</a><br><a href=/b>Two</a><br><a href=/c>Three</a></td><td><h1>Bridge closed</h1>{P}</td></tr></table>", "Bridge closed\n" + ALL),
    "named": (f'<header class="site-header"><a href=/>Logo</a></header><div class="cookie-banner"><p>We use cookies to make this site better for you.</p></div><div id="main-content"><h1>Bridge closed</h1>{P}<div class="share-buttons"><a href=#>Tweet</a></div></div><div id="comments"><p>What a shame, I drive there each day and now must go round.</p></div>', "Bridge closed\n" + ALL),
    "math": (f"<article><p>{PROSE[0]}</p><p>Its load is <math><mi>F</mi><mo>=</mo><mn>9</mn></math> units, as was found in the long report of the engineers.</p></article>", PROSE[0] + "\nIts load is F=9 units, as was found in the long report of the engineers."),
    "noscript in an article": (f"<nav><a href=/>Home</a></nav><article><h1>Bridge closed</h1><p>{PROSE[0]}</p><noscript><p>{PROSE[1]}</p></noscript></article>", "Bridge closed\n" + PROSE[0] + "\n" + PROSE[1]),
    "noscript notice": (f"<noscript>Please enable JavaScript in your browser.</noscript><article><h1>Bridge closed</h1>{P}</article>", "Bridge closed\n" + ALL),
    "hidden": (f'<div style="display:none"><p>Sign up now and read what others can not read.</p></div><main><h1>Bridge closed</h1>{P}</main>', "Bridge closed\n" + ALL),
    "labels of a table": (f'<article><h1>Bridge closed</h1>{P}<table><tr><td data-label="Account">Three thousand cars each day</td><td data-label="7 x">Forty buses</td></tr></table></article>', "Bridge closed\n" + ALL + "\nThree thousand cars each day\nForty buses"),
    "definition list": (f"<main><h1>Bridge closed</h1><dl><dt>Pier<dd>{PROSE[0]}<dt>Barge<dd>{PROSE[3]}</dl></main><footer><p>Imprint</p></footer>", f"Bridge closed\nPier\n{PROSE[0]}\nBarge\n{PROSE[3]}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, want = PAGES[name]
    assert html_extract.default_model().extract(html) == want


ADVERSE = {
    "quote": lambda n: "<a " * n + '"',
    "quotes": lambda n: '<a "' * n,
    "unmatched": lambda n: "<b>" * n + "</i>" * n,
    "walls": lambda n: "<i><td>" + "<b>" * n + "</i>" * n,
    "paragraphs": lambda n: "<b>" * n + "<p>x</p>" * n,
    "html": lambda n: "<b>" * n + "<html>" * n,
    "comments": lambda n: "<!-- " * n,
    "cells": lambda n: "<td>" * n + "</table>" * n,
    "scripts": lambda n: "<script>" * n,
    "equals": lambda n: "<a x=' " * n,
}


@pytest.mark.parametrize("name", ADVERSE)
def test_time_is_linear(name):
    times = []
    for n in (5_000, 40_000):
        html = ADVERSE[name](n)
        began = time.process_time()
        html_extract.parse(html)
        times.append(time.process_time() - began)
    assert times[1] < 2 and times[1] < 30 * times[0] + 0.05


def test_edges(spark):
    rows = [(1, "u", PAGES["math"][0], 5), (1, "u", PAGES["math"][0], 5), (None, None, "<p>" + "Some words of prose. " * 50_000 + "</p>", 5), (2, "v", "<p data-label='x'>", 5), (3, "w", "</p></div>", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((x.page_id, x.n_chars, x.text) for x in html_extract.query(df).collect()), key=str)
    assert [x[:2] for x in got] == sorted([(1, len(PAGES["math"][1]))] * 2 + [(None, 1_049_999), (2, 0), (3, 0)], key=str)
    assert html_extract.query(df.limit(0)).count() == 0
