"""Main text of pages: the article's text, pages without marks, odd markup, and linear work."""

import html as entities
import re
import time

import pytest

from quarry.llm import html

SF = "/root/testdata/sf0.001"
TREE = html.grow(html.LABELLED)
LONG = "This is a long paragraph of the story, with many words that say what happened on that day in the town."


def main(page):
    return html.main_text(page, TREE)


def wanted(page):
    article = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    return " ".join(entities.unescape(re.sub(r"</?(?:p|h1|br)>", " ", article.group(1) if article else "").replace("<b>", "")).split())


def unmarked(page):
    """The page with all that tells articles and furniture apart taken away."""
    return re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", page).replace(' class="ad"', "")


def test_pages(spark):
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = html.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert len(got) == len(raw) and all(r.text == wanted(raw[r.page_id]) and r.n_chars == len(r.text) for r in got)
    assert all(main(unmarked(h)) == wanted(h) for h in raw.values())


def test_page_with_all_kinds_of_furniture():
    page = (
        f"<html><head><title>T</title></head><body><header>Site <a href=/>Home</a></header><div class='cookie-notice'>We use cookies {LONG}</div><nav><a>One</a> <a>Two</a></nav>"
        f"<div id=wrap><h2>Head line</h2><p>{LONG} {LONG}</p><p>Yes.</p><p>{LONG} caf&eacute; &amp;  <b>bo</b>ld</p></div><form>Name <input> send it now please</form>"
        f"<aside><p>{LONG}</p></aside><aside>{LONG * 3}</aside><div class=ads>{LONG * 4}</div><section class=comments><p>{LONG}</p><article class=comment>{LONG * 2}</article></section>"
        f"<footer>&copy; 2024 someone</footer><script>var x='<p>no</p>'</script></body>"
    )
    assert main(page) == f"Head line {LONG} {LONG} Yes. {LONG} café & bold"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<head><title>T</title><body><article><p>{LONG}</p></article>", LONG),
        (f"<head><meta charset=utf-8><title>T</title><p>{LONG}</p><p>Yes.</p>", f"{LONG} Yes."),
        (f"<button><p>{LONG}</p>", LONG),
        (f"<select><option>x</option><p>{LONG}</p>", f"{LONG}"),
        (f"<svg/><iframe/><object/><textarea/><noscript/><p>{LONG}</p>", LONG),
        (f"<svg><p>{LONG}</p><p>{LONG}", f"{LONG} {LONG}"),
        (f"<article><p>{LONG} <math><mi>x</mi></math> <object>plan</object></p><p>and a <button>key</button></p></article>", f"{LONG} x plan and a key"),
        (f"<div class='post tag-news'><p>{LONG}</p><p>Yes.</p></div>", f"{LONG} Yes."),
        (f"<div class='content has-sidebar'><h1>Hm</h1><p>{LONG}</p></div>", f"Hm {LONG}"),
        (f"<div class='main-nav'><article><h1>Hm</h1><p>{LONG}</p></article></div>", f"Hm {LONG}"),
        (f"<article><header><h1>Hm</h1></header><p>{LONG}</p><footer>By them</footer></article>", f"Hm {LONG}"),
        (f"<article><p>{LONG}<a href=x>open <p>{LONG}</article>", f"{LONG}open {LONG}"),
        (f"<h1>Title here</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p>", f"Title here {LONG} Short. {LONG}"),
        (f"<p title=\"a > b\" class='x'>{LONG}</p></div></p></nav>", LONG),
        (f"<p>{LONG} 1 < 2 & 3 <4</p>", f"{LONG} 1 < 2 & 3 <4"),
        (f"<p>{LONG}</p><!-- never closed <p>{LONG}</p>", LONG),
        (f"<p>{LONG}</p><script>never closed <p>{LONG}</p>", LONG),
        (f"<p>a b &nbsp; c &#x41; &#65; {LONG}</p>", f"a b c A A {LONG}"),
        (f"<form id='aspnetForm'><article><p>{LONG}</p></article></form>", LONG),
        (f"<form id='aspnetForm'><div><h1>Hm</h1><p>{LONG}</p><p>{LONG}</p></div></form>", f"Hm {LONG} {LONG}"),
        (f"<article><div class='side-by-side'><p>{LONG}</p></div></article>", LONG),
        (f"<article id='newsletter-history'><p>{LONG}</p></article>", LONG),
        (f"<article><section id='reply-to-critics'><p>{LONG}</p></section></article>", LONG),
        (f"<nav><a href=x>Home</a><article><p>{LONG}</p></article>", LONG),
        (f"<p class='cookie-recipe'>{LONG}</p>", LONG),
        (f"<p>{LONG}</p><ul><li>Six eggs</li><li>Some milk and flour</li></ul><p>{LONG}</p>", f"{LONG} Six eggs Some milk and flour {LONG}"),
        (LONG, LONG),
        (f"<div class='cookie-notice'><p>{LONG}</p></div><p>{LONG} Yes.</p>", f"{LONG} Yes."),
        ("", ""),
        (None, ""),
        ("   ", ""),
    ],
)
def test_odd_markup(page, text):
    assert main(page) == text


@pytest.mark.parametrize("unit", ["<a ", "<", "<p>x", "<div>", "</x>", "<svg>", '<a href="', "<!--", "<li>x", "<p class='a>", "<a>x", "<title>", "<div class=a><article>", "&amp;", "x" * 10])
def test_work_is_linear(unit):
    began = time.time()
    main(unit * (400_000 // len(unit)))
    assert time.time() - began < 10


def test_words_and_links_decide_without_marks():
    """A tree that is grown without the columns of marks still tells links from prose."""
    tree = html.grow([((*x[:7], 0.0, 0.0), y) for x, y in html.LABELLED if not x[8]])
    page = f"<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul><h1>A title of some words</h1><p>{LONG}</p><p>{LONG}</p><p><a href=c>More</a></p><ul><li><a href=d>Three</a></li><li><a href=e>Four</a></li></ul>"
    assert html.main_text(page, tree) == f"A title of some words {LONG} {LONG}"


def test_odd_rows(spark):
    odd = spark.createDataFrame([(1, "u", None, 1), (None, None, "<p", 1), (2, "u", "x" * 100000, 1), (2, "u", "x" * 100000, 1)], "page_id long, url string, html string, text int")
    got = html.extract(odd).collect()
    assert sorted(str(r.page_id) for r in got) == ["1", "2", "2", "None"] and all(r.text == "" for r in got if r.page_id == 1)
    assert html.extract(odd.limit(0)).count() == 0
