import re
import time
from html import unescape

import pytest

from recordlens.llm.html_text import extract_pages, main_text, parse

LONG = "This is a sentence of the article, long enough to count, with commas, and no links at all in it. " * 2


def clean(text):
    return " ".join(text.split())


@pytest.mark.parametrize("page, want", [
    ("<p>One &amp; two\n  three<br>four</p><p>Five", ["One & two three four", "Five"]),
    (f"<html><body><nav><ul><li><a href=/>Home</a></ul></nav><header>Site</header><div id=content><h2>Title</h2><p>{LONG}</p>"
     f"<p>{LONG}<p>short</div><div class='sidebar'><p>{LONG}</p></div><footer>c</footer></body></html>",
     ["Title", LONG, LONG, "short"]),
    (f"<div class='cookie-notice'><p>{LONG}{LONG}</p></div><article class='post has-sidebar'><header><h1>Head</h1></header><p>{LONG}"
     f"<form><p>{LONG}</p></form><aside>{LONG}</aside><div class='ad'>{LONG}</div><ul><li>a<li>b</ul></article>"
     f"<section class='comments'><article class='comment'><p>{LONG}{LONG}{LONG}</p></article></section>",
     ["Head", LONG, "a", "b"]),
    (f"<div><div class=menu><a href=1>{LONG}</a></div><div><p>{LONG}</p><script>var t='<p>no</p>';</script><style>p{{}}</style>"
     f"<!-- <p>no</p> --><p>{LONG}</p></div></div>", [LONG, LONG]),
    (f"<main><table><tr><td>{LONG}<td>b</table><blockquote>{LONG}</blockquote></main><div role=navigation>{LONG}</div>",
     [LONG, "b", LONG]),
    (f"<article><p>{LONG}</p><div hidden>{LONG}</div><p style='display: none'>{LONG}</p></article>", [LONG]),
    ("<p>a < b && c &lt; d &#233; &nosuch; &am", ["a < b && c < d é &nosuch; &am"]),
    ("<title>only a title</title><script>x", []),
    ("<nav><a href=x>only</a></nav>", []),
    ("<div><b>bold <i>and</b> more</i></div>", ["bold and more"]),
])
def test_pages(page, want):
    assert main_text(page) == "\n".join(clean(w) for w in want)


def test_odd_input_does_not_break():
    for page in (None, "", " ", "<", "<<<>>>", "</p></div>", "<p" * 2000, "<!--", "<![CDATA[x]]>", "<a href='x", "<script>", "&#0;", "<div>" * 3000 + "x"):
        assert isinstance(main_text(page), str)
    assert main_text("<div>" * 3000 + "x") == "x"
    assert len(main_text("<article>" + "<p>" + "word " * 200_000)) == 999_999
    assert parse("<p>x")[1][0].text == "x"


def test_rows(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, None, None, "x"), (None, "v", "", "x")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got), key=str) == sorted(
        [(1, "u", "a", 1), (1, None, "", 0), (None, "v", "", 0)], key=str
    )


def test_given_pages_equal_a_plain_reading(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S).group(1)
        parts = [clean(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", x)))) for x in re.split(r"</?(?:p|h1)>", body)]
        assert main_text(r["html"]) == "\n".join(p for p in parts if p)


@pytest.mark.parametrize("page, want", [
    (f"<article><h2 id='legal-basis'>Legal basis</h2><p>{LONG}</p><h2 id='search'>Search</h2><p>{LONG}</p></article>",
     ["Legal basis", LONG, "Search", LONG]),
    (f"<article><p>{LONG}</p><section id='related-work'><h2>Related work</h2><p>{LONG}</p></section>"
     f"<section id='search'><h2>Search</h2><p>{LONG}</p></section><div class='side-by-side'><p>{LONG}</p></div></article>",
     [LONG, "Related work", LONG, "Search", LONG, LONG]),
    (f"<div class='layout sidebar-right'><div class='content'><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div></div>",
     [LONG, LONG]),
    (f"<div class='layout sidebar-right'><article><p>{LONG}</p></article></div>", [LONG]),
    (f"<div class='notice'><p>{LONG}</p></div>", [LONG]),
    (f"<div class='widget'>{LONG}</div><div class='widget'>{LONG}</div>", [LONG, LONG]),
    (f"<article><p>{LONG}</p></article><div class='comment-list' id='comments'><h3>Comments</h3><p>{LONG}{LONG}{LONG}</p></div>", [LONG]),
    (f"<div class='post'><p>{LONG}</p><p>{LONG}</p><div class='related-posts'><p>{LONG}</p></div><span class=share-buttons>x</span></div>", [LONG, LONG]),
])
def test_names_drop_no_content(page, want):
    assert main_text(page) == "\n".join(clean(w) for w in want)


@pytest.mark.parametrize("page, want", [
    # The whole body in a form, as some server frameworks write it.
    (f"<body><form id='aspnetForm'><input type=hidden><div class=menu><a href=1>x</a></div><div id=content><h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
     "<select><option>no</option></select><button>no</button></div></form></body>", ["Title", LONG, LONG]),
    (f"<form><article><p>{LONG}</p></article></form>", [LONG]),
    # Forms beside or in the article still go, as do pages of a form alone.
    (f"<form><h3>Subscribe</h3><p>{LONG}</p><p>{LONG}</p></form><article><p>{LONG}</p></article>", [LONG]),
    (f"<form><p>{LONG}</p></form>", []),
    # Chapters in wrappers of their own.
    ("".join(f"<div class=wrap><div class=chapter><h2>Part {i}</h2><p>{LONG}</p><p>{LONG}</p></div></div>" for i in (1, 2)) + "<div class=wrap><a href=1>more</a></div>",
     ["Part 1", LONG, LONG, "Part 2", LONG, LONG]),
    (f"<div><div class=w><div><p>{LONG}</p></div></div><div class=other><div><p>short</p></div></div></div>", [LONG]),
])
def test_form_wrappers_and_sibling_wrappers(page, want):
    assert main_text(page) == "\n".join(clean(w) for w in want)


@pytest.mark.parametrize("page, blocks", [
    ("<div>" * 20_000 + f"<p>{LONG}</p>" * 2_000, 2_000),
    ("<div class='notice'>" * 20_000 + f"<p>{LONG}</p>" * 2_000, 2_000),
    ("<b>" * 20_000 + "x" + "</b>" * 20_000 + f"<p>{LONG}</p>" * 500, 501),
    ("<ul><li>" * 10_000 + f"<li>{LONG}" * 1_000, 1_000),
    ("<div>" * 10_000 + f"<p>{LONG}</p></span></i>" * 2_000, 2_000),
])
def test_deep_pages_take_linear_time(page, blocks):
    start = time.perf_counter()
    lines = main_text(page).split("\n")
    assert time.perf_counter() - start < 4
    assert abs(len(lines) - blocks) <= 1
