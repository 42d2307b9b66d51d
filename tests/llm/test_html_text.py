import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from talus.llm import html_text as H

LONG = "This is a long enough paragraph with many plain words that no menu would ever hold in one item."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>x";</script></head><body class="nav-open">
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav><!-- <p>no</p> --><header><p>{LONG}</p></header>
<div class="ad top">{LONG}</div><article><h1>A &amp; B</h1><p><b>{LONG}<br><p>Short &lt;one&gt;.</p><p>two
  lines&nbsp;<a href=x>linked</a> w<i>or</i>d</p><div class="cookie-notice"><p>{LONG}</p></div><aside>{LONG}</aside>
<form><label>Name</label><input value=x></form><p>The end</p></article><section id="comments"><article><p>{LONG}</p></article></section>
<footer>&copy; {LONG}</footer></body></html>"""


def test_article_only():
    assert H.main_text(PAGE).split("\n") == ["A & B", LONG, "Short <one>.", "two lines linked word", "The end"]


def test_page_without_article():
    page = f"<div><a href=1>One</a></div><div><a href=2>Two</a></div><h2>Title of this</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p><div><a href=3>Next</a></div>"
    assert H.main_text(page).split("\n") == ["Title of this", LONG, "Yes.", LONG]


@pytest.mark.parametrize("page", [None, "", "   ", "<p>", "<", "<script>never closed", "<!-- open"])
def test_pages_without_text(page):
    assert H.main_text(page) == ""


def test_tree_fits_its_table():
    assert all(H.decide(H.tree(), r[:-1]) == r[-1] for r in H.LABELLED)


def test_extract(spark):
    schema = T.StructType([T.StructField(c, t) for c, t in (("page_id", T.LongType()), ("url", T.StringType()), ("html", T.StringType()), ("text", T.StringType()))])
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (2, None, None, None), (None, "v", "<p>" + "word " * 100_000, "")]
    out = {(r.page_id, r.url): r for r in H.extract(spark.createDataFrame(rows, schema)).collect()}
    assert out[1, "u"].text.startswith("A & B\n") and out[1, "u"].n_chars == len(out[1, "u"].text)
    assert (out[2, None].text, out[2, None].n_chars) == ("", 0)
    assert out[None, "v"].n_chars == 499_999
    assert H.extract(spark.createDataFrame([], schema)).count() == 0


class Plain(HTMLParser):
    """Blocks within <article>, by another parser: text between block tags, without scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.raw, self.held, self.out = 0, 0, "", []

    def flush(self):
        if self.held.split():
            self.out.append(" ".join(self.held.split()))
        self.held = ""

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.raw += tag in ("script", "style", "title")
        if tag == "br":
            self.held += " "
        elif tag not in ("b", "a", "i", "em"):
            self.flush()

    def handle_endtag(self, tag):
        if tag not in ("b", "a", "i", "em"):
            self.flush()
        self.inside -= tag == "article"
        self.raw -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if self.inside and not self.raw:
            self.held += data


def test_pages_equal_another_parser():
    """Held-out pages, none of which the tree was fitted to: the text of every page is that of its article."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    wrong = 0
    for row in pages:
        p = Plain()
        p.feed(row["html"])
        p.close()
        wrong += H.main_text(row["html"]).split("\n") != (p.out or [""])
    assert wrong == 0 and len(pages) == 250


@pytest.mark.parametrize("label", ['class="related-work"', 'class="form-factor"', 'class="social-history"', 'id="comment-letter"', "title=it's"])
def test_labels_within_the_article(label):
    page = f"<article><h1>Title</h1><p>{LONG}</p><div {label}><p>{LONG}</p></div><p {label}>Short.</p><p>It's {LONG}</p></article>"
    assert H.main_text(page).split("\n") == ["Title", LONG, LONG, "Short.", f"It's {LONG}"]


@pytest.mark.parametrize("label", ['class="related-posts"', 'class="cookie-notice"', 'id="comments-list"', 'class="x ad-slot-2"'])
def test_furniture_within_the_article(label):
    assert H.main_text(f"<article><p>{LONG}</p><div {label}><p>{LONG}</p></div><p>The end</p></article>").split("\n") == [LONG, "The end"]


def test_implied_end_tags():
    assert H.main_text(f"<article><p>{LONG}<ul><li class=share>Share<li>{LONG}</ul><table><tr><td class=ad>Buy<td>{LONG}<tr><td>{LONG}</table></article>").split("\n") == [LONG] * 4


def test_comments_without_a_label():
    assert H.main_text(f"<h1>The title of it</h1><p>{LONG}</p><p>{LONG}</p><h3>2 comments</h3><div><p>{LONG}</p></div><div><p>{LONG}</p></div>").split("\n") == ["The title of it", LONG, LONG]


@pytest.mark.parametrize("broken", ["<a ", "<a href='", "<a b=\"", "<div>", "<![CDATA[", "<li>", "<td>", "</p>", "<div></x>", "<script>", "<", "<p title=it's>"])
def test_broken_markup_takes_time_in_proportion(broken):
    began = time.time()
    H.main_text(f"<article><p>{LONG}</p>" + broken * 20_000)
    assert time.time() - began < 5


@pytest.mark.parametrize("name", ["Discussion", "Responses", "Replies", "Results", "Comments on the method"])
def test_sections_of_an_article_stay(name):
    page = f"<article><h1>Title</h1><p>{LONG}</p><h2>{name}</h2><p>{LONG}</p><h2>Conclusion</h2><p>{LONG}</p></article>"
    assert H.main_text(page).split("\n") == ["Title", LONG, name, LONG, "Conclusion", LONG]


def test_comments_end_with_the_next_heading():
    assert H.main_text(f"<article><h1>Title</h1><p>{LONG}</p><h2>3 comments</h2><p>{LONG}</p><h2>Sources</h2><p>{LONG}</p></article>").split("\n") == ["Title", LONG, "Sources", LONG]


@pytest.mark.parametrize("page", ["<p>Just one line.</p>", "Just one line.", "<html><body><div>Just <b>one</b> line.</div></body></html>"])
def test_pages_of_one_line(page):
    assert H.main_text(page) == "Just one line."
