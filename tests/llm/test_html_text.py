import re
import html
import time
from pathlib import Path

import pytest
from tidemark.llm.common import read_table
from tidemark.llm.html_text import extract_text, main_text

LONG = "This is the story of a town that was on the river and it had a bridge. "


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>No</title>{head}</head><body>{body}</body></html>"


def test_structure_and_markup_are_left_out():
    body = (
        "<header><a href=/>Home</a> Site</header><nav><ul><li><a href=/a>A</a></li></ul></nav><!-- x <p>no</p> -->"
        f"<div class='cookie-notice'><p>{LONG}</p></div><div id=sidebar>{LONG}</div><div class=\"ad\">{LONG}</div>"
        f"<article><header><h1>Title &amp; more</h1><p>by someone</p></header><p>{LONG}</p><p>Short.</p><script>var t='</p>';</script>"
        f"<aside>{LONG}</aside><p>w<b>or</b>d&nbsp;\n two<br>lines &lt;p&gt; &#233;</p><form><label>Name</label><input></form></article>"
        f"<section class=comments><article class=comment>{LONG}</article></section><footer>&copy; x</footer><style>p{{}}</style>"
    )
    assert main_text(page(body)) == f"Title & more {LONG.strip()} Short. word two lines <p> é"


def test_pages_without_a_marked_article_use_the_text_rules():
    body = f"<div><a href=a>One link</a> <a href=b>Another link</a></div><div>{LONG * 3}</div><div>Short one.</div><div class=footer>Imprint</div>"
    assert main_text(page(body)) == f"{(LONG * 3).strip()} Short one."
    assert main_text("<p>Only a short one.</p>") == "Only a short one."
    assert main_text("plain text, no markup") == "plain text, no markup"


@pytest.mark.parametrize("text", ["", "<", "<p", "<!--", "<script>", "<p>" * 50_000, "<a href='" * 20_000, "x<" * 50_000, "&" * 100_000, "</div>" * 50_000, "<div>" * 3_000 + "a"])
def test_broken_and_long_pages(text):
    assert isinstance(main_text(text), str)


def test_a_very_long_article_is_whole():
    paragraphs = [f"Paragraph {i}." for i in range(20_000)]
    assert main_text(page("<article>" + "".join(f"<p>{p}" for p in paragraphs) + "</article>")) == " ".join(paragraphs)


def test_every_page_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    if not Path(sf).exists():
        pytest.skip("no test data")

    def brute(raw):
        inner = re.search(r"<article>(.*)</article>", raw, re.S).group(1)
        return " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", inner))).split())

    rows = read_table(spark, sf, "pages").select("html", extract_text("html").alias("text")).collect()
    assert [r.text for r in rows] == [brute(r.html) for r in rows]


def test_null_pages(spark):
    df = spark.createDataFrame([(None, "a"), ("", "b"), ("<p>x</p>", "c"), ("<p>x</p>", "c")], "html string, text string")
    assert [r[0] for r in df.select(extract_text("html")).collect()] == ["", "", "x", "x"]
    assert df.limit(0).select(extract_text("html")).count() == 0


BODY = f"<h1>Title</h1><p>{LONG}</p><p>{LONG * 2}</p><p>Short.</p>"
TEXT = f"Title {LONG.strip()} {(LONG * 2).strip()} Short."


@pytest.mark.parametrize("opening", ["<form id=aspnetForm>", "<div id='content-sidebar-wrap'>", "<div class='content has-sidebar'>",
                                     "<section class='related-work'>", "<div class='social-science'>", "<fieldset>"])
@pytest.mark.parametrize("body", [BODY, f"<article>{BODY}</article>", f"<main>{BODY}</main>", BODY.replace("h1", "h2")])
def test_wrappers_of_the_whole_text_are_kept(opening, body):
    tag = re.match(r"<(\w+)", opening).group(1)
    side = f"<nav>Menu</nav><div class=sidebar>{LONG}</div>"
    assert main_text(page(f"{opening}{side}{body}<label>Name</label><button>Send</button></{tag}><footer>x</footer>")) == TEXT
    assert main_text(page("<form><p>Short.</p></form>")) == "Short."


def test_wrappers_beside_the_text_stay_dropped():
    beside = f"<div class=comments>{LONG * 9}</div><div class='related-posts'><article>{LONG}</article></div><form>Search</form>"
    assert main_text(page(f"<article>{BODY}</article>{beside}")) == TEXT
    assert main_text(page(f"<div>{BODY}</div><div class='cookie-notice'>{LONG * 9}</div><p>A <span class=ad>b</span> c</p>")) == f"{TEXT} A c"


@pytest.mark.parametrize("card", ["Read on", LONG])
def test_a_teaser_card_does_not_mark_the_page(card):
    got = main_text(page(f"<div>{BODY}</div><article>{card}</article>"))
    assert got.startswith(TEXT)
    assert main_text(page(f"<article><p>Kurz.</p><p>Und kurz, etwas.</p></article><div>Imprint</div>")) == "Kurz. Und kurz, etwas."


def test_stray_quotes_in_a_tag_open_no_value():
    text = "<a href=x title=it's>link</a> whole article text here.</p><p>second par</p><p>it's third</p>"
    assert main_text(text) == "link whole article text here. second par it's third"
    assert main_text("<img alt=5\" src=x> whole article text.</p><p class=\"y\">more</p>") == "whole article text. more"
    assert main_text("<p title = 'a>b' lang=\"c>d\">one</p><p a=x?q=\"y>two</p><p \">three</p><p a=\"four>five</p>") == "one two three five"
    assert main_text("<p class=x'y id='sidebar'>side</p><p>text</p>") == "text"


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 50_000 + "</section>" * 50_000,
        "<center>" * 100_000,
        "<ul>" * 20_000 + "<p>" * 40_000 + "</td>" * 40_000,
    ],
)
def test_unmatched_tags_take_linear_time(page):
    start = time.process_time()
    assert main_text(page + "<article><p>The text of the page is here.</p></article>") == "The text of the page is here."
    assert time.process_time() - start < 10
