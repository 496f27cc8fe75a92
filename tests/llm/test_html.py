"""Main text of small pages written out by hand."""
import time

import pytest

from trailweave.llm.htmltext import extract, main_text

LONG = "A first paragraph that is long enough to count as running text by the sum of the lengths around it."
PAGES = [
    (None, ""),
    ("", ""),
    ("plain words", "plain words"),
    (f"<div class='menu'><a href=x>Home</a></div><div><h2>Head</h2><p>{LONG} &amp; more&nbsp;x<p>Short.<ul><li>one<li>two</ul></div>"
     f"<div class=sidebar>{LONG}</div><div id=comments><p>{LONG}</p></div><form>{LONG}</form><script>var a='<p>no</p>'</script><footer>{LONG}</footer>",
     f"Head\n\n{LONG} & more x\n\nShort.\n\none\n\ntwo"),
    ("<nav>n</nav><article><header><h1>T</h1></header><p>a <b>b</b>c<br>d<div class='share'>s</div><aside>z</aside><!-- <p>x</p> --></article><p>out", "T\n\na bc d"),
    ("<article><p>cut of", "cut of"),
    ("<article><p>x &lt;b&gt; &#233; &am", "x <b> é &am"),
    (f"<div role=banner>{LONG}</div><p>{LONG}</p><div class='cookie-notice'>{LONG}</div><div style='display: none'>{LONG}</div>", LONG),
    ("<p title='a>b'>t</p><style>p{}</style>", "t"),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_page(page, want):
    assert main_text(page) == want


def test_table(rows):
    df = rows([(k, "u", p, "clash") for k, (p, _) in enumerate(PAGES)] + [(None, None, None, None)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in extract(df).collect()}
    assert got == {k: (w, len(w)) for k, (_, w) in enumerate(PAGES)} | {None: ("", 0)}
    assert extract(df.where("false")).count() == 0


def test_long_page():
    assert main_text("<article>" + f"<p>{LONG}</p>" * 20000).count("\n\n") == 19999


TEXT = "Here is a sentence of the article that is long enough to be told from menus and other short lines."
ARTICLE = f"<h1>Title</h1><p>{TEXT}</p><p>End.</p>"
WANT = f"Title\n\n{TEXT}\n\nEnd."
AD = "<div class=ad>Buy now, only today, and get another for nothing.</div>"
WHOLE = [
    (f"<article><h1>Title</h1><p class='related-work'>{TEXT}</p><div class='toc'>End.</div></article>", WANT),
    (f"<div class='page header-fixed'>{ARTICLE}</div>", WANT),
    (f"<div id='search-results'>{ARTICLE}</div>", WANT),
    (f"<form id=aspnet class=header>{ARTICLE}</form>", WANT),
    (f"<article><a href=x>One</a></article><article><a href=y>Two</a></article><div>{ARTICLE * 2}</div>", f"{WANT}\n\n{WANT}"),
    (f"<h1>Title</h1>{AD}{AD}{AD}<p>{TEXT}</p><p>End.</p>", WANT),
    (f"<h1>Title</h1><p>{TEXT}</p>{AD}{AD}{AD}{AD}<p>End.</p>", WANT),
    (f"<h1>Title</h1><p>{TEXT}</p><p><a href=x>All of it a link.</a></p><p>End.</p>", f"Title\n\n{TEXT}\n\nAll of it a link.\n\nEnd."),
    (f"<article><p>Short.</p></article><article>{ARTICLE}</article>{AD}", WANT),
    (f"<main><p>Short.</p></main><p>Outside.</p>", "Short.\n\nOutside."),
    (f"<ul><li><a href=a>A</a><li><a href=b>B</a><li><a href=c>C</a><li><a href=d>D</a></ul><div>{ARTICLE}</div><ul><li><a href=a>A</a><li><a href=b>B</a></ul>", WANT),
    (f"<div class='site-header'>{TEXT}</div><div id='post-comments'>{TEXT}</div><div class='ad_box_2'>{TEXT}</div>{ARTICLE}{ARTICLE}", f"{WANT}\n\n{WANT}"),
    (f"<footer>{TEXT}</footer>", ""),
    (f"<div hidden>{TEXT}</div>", ""),
    (f"<article><p>{TEXT}</p><div class=comments><p>{TEXT}</p><p>{TEXT}</p></div></article>", TEXT),
    (f"<table><tr><td>{TEXT}<td>one<tr><td>two</table>", f"{TEXT}\n\none\n\ntwo"),
]


@pytest.mark.parametrize("page, want", WHOLE)
def test_nothing_else_is_lost(page, want):
    assert main_text(page) == want


NESTED = [
    "<div>" * 200_000 + TEXT, "<select>" * 120_000 + TEXT, "<div>" * 90_000 + "</span>" * 90_000 + TEXT, "<p><b>" * 150_000 + TEXT, "<li><dd>" * 100_000 + TEXT, "<ul><li>" * 100_000 + TEXT,
    "<article class=ad>" * 60_000 + TEXT, "<div class=menu>" * 60_000 + TEXT, "<a>" * 250_000 + TEXT, "<" * 1_000_000, "<td>" * 200_000 + TEXT, "<!--" * 200_000, "&" * 1_000_000, "<div x='" * 100_000,
]


@pytest.mark.parametrize("page", NESTED, ids=lambda p: p[:12])
def test_time_is_linear(page):
    """A megabyte of open tags."""
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 4
