import itertools
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratum.llm import html as H

P1 = "The river had been rising for three days when the first families left. Nobody in the village had seen such water before."
P2 = "By Sunday the bridge was gone, and with it the only road to the market; people began to count what was left of the harvest."
P3 = "It took a year before the last house was rebuilt."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>x";</script></head><body>
<div id="cookie-notice"><p>We use cookies to give you the best experience on this site. By continuing you agree to our policy.</p></div>
<header><a href="/">Home</a><h1>The Daily</h1></header><nav><ul><li><a href="#">News</a><li><a href="#">Sport</a></ul></nav>
<aside class="sidebar"><h3>Most read</h3><p>Another long story about something else entirely, with sentences. And more of them here.</p></aside>
<article><h1>The &amp; flood</h1><p>{P1}<div class="ad">Buy now! The best offers of the season are waiting for you today.</div><p>{P2}</p>
<form><label>Email</label><input><textarea>t</textarea><button>Sign up</button></form><ul><li>first point</li><li>second point</li></ul>
<p>{P3}&nbsp; <b>Bold\n end</b></p></article>
<section class="comments"><h2>Comments</h2><div class="comment"><p>I was there and saw all of it. A terrible time for everyone in the valley.</p></div></section>
<footer>&copy; 2024 The Daily. All rights reserved.</footer></body></html>"""


def test_article_only():
    assert H.main_text(PAGE) == "\n\n".join(["The & flood", P1, P2, "first point", "second point", f"{P3} Bold end"])


def test_page_without_article_element():
    page = f'<body><div class="menu"><a href=1>One</a> <a href=2>Two</a></div><div id="content"><h2>Title</h2><p>{P1}</p><p>Short.</p><p>{P2}</p></div><div class="footer">All rights reserved by us.</div></body>'
    assert H.main_text(page) == "\n\n".join(["Title", P1, "Short.", P2])


def test_defined_edges():
    assert H.main_text(None) == H.main_text("") == H.main_text("<p>") == ""
    assert H.main_text(f"<article><p>{P1} 1 < 2 &am &#x41;<!-- no --> <a") == f"{P1} 1 < 2 &am A"
    assert H.main_text(f"<article><p title=\"a>b\">{P1}</p><script>never ends <p>x") == P1
    assert H.main_text(f"<article><p x=\">{P1}</p></article>") == P1


def test_long_pages_are_linear():
    began = time.time()
    H.main_text("<article>" + f"<p>{P1}</p>" * 5_000)
    H.main_text("<div>" * 20_000 + P1)
    H.main_text('<a "' * 3_000)
    H.main_text("<" * 100_000)
    H.main_text("<article>" + f"<p>{P1}</p><div class='ad'>Buy</div>" * 2_000)
    assert time.time() - began < 40


CAPACITY = st.integers(0, 9).map(float)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 7).flatmap(lambda n: st.tuples(st.lists(st.tuples(CAPACITY, CAPACITY), min_size=n, max_size=n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), CAPACITY), max_size=10))))
def test_cut_is_minimal(case):
    terminals, edges = case
    edges = [e for e in edges if e[0] != e[1]]
    source, sink = [a for a, _ in terminals], [b for _, b in terminals]

    def cost(keep):
        return sum(sink[i] if k else source[i] for i, k in enumerate(keep)) + sum(c for a, b, c in edges if keep[a] != keep[b])

    best = min(cost(k) for k in itertools.product([False, True], repeat=len(source)))
    assert cost(H.minimum_cut(source, sink, edges)) == best


def test_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "mine"), (2, None, None, "x"), (1, "u", PAGE, "mine"), (None, "v", "", "y")], "page_id long, url string, html string, text string")
    got = H.extract(pages).select("row.*", "n_chars").collect()
    assert len(got) == 4 and sorted(r.n_chars for r in got)[:2] == [0, 0]
    assert H.extract(pages.limit(0)).count() == 0


def test_head_without_end_tag():
    for start in (f"<head><title>T</title><meta name=a><body><article><p>{P1}</article>", f"<html><head>\n<script>x</script><article><p>{P1}</p></article>", f"<head><style>p</style>\n{P1}<p>{P2}"):
        assert P1 in H.main_text(start), start
    assert H.blocks("<head><title>T</title> <meta name=a>\n<style>p</style></head>") == []


@pytest.mark.parametrize("page", ["<div>x" * 30_000, "<b>" * 30_000 + "</i>" * 30_000, "<i><div>" + "<b>" * 30_000 + "</i>" * 30_000, "<b>" * 30_000 + "<li>x" * 30_000, "<p>" + "<b>" * 30_000 + "<hr>" * 30_000, "<table>" * 9_000 + "<td>x" * 9_000])
def test_deep_nesting_and_stray_ends_are_linear(page):
    began = time.process_time()
    H.main_text("<article>" + page)
    assert time.process_time() - began < 6


def test_text_that_is_neither_form_nor_furniture_stays():
    inner = "<p>Before it all.</p><math><mi>x</mi><mo>=</mo><mn>1</mn></math><object><p>Fallback words.</p></object><noscript>No script here.</noscript><xmp>a <b> c</xmp><label>A label text.</label>"
    got = H.main_text(f"<body><article><h1>Title</h1>{inner}<form><label>Your name</label></form></article></body>")
    for x in ("x=1", "Fallback words.", "No script here.", "a <b> c", "A label text."):
        assert x in got
    assert "Your name" not in got


@pytest.mark.parametrize("name", ["search", "legal", "tags", "notice", "alert", "side"])
def test_a_class_name_alone_does_not_outvote_an_article(name):
    sentence = "The council searched the whole valley for nine days before it gave the matter up."
    text = H.main_text(f'<article><p>First of all there was a long story to tell.</p><p class="{name}">{sentence}</p></article><div class="{name}"><a href="#">{name} here</a></div>')
    assert sentence in text and f"{name} here" not in text


def test_head_noscript_is_dropped():
    assert H.main_text("<head><noscript><style>x</style></noscript></head><body><article><p>Only this stays, whole and alone.</p></article>") == "Only this stays, whole and alone."
