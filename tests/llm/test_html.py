"""Main text of pages: rules one by one, and the articles of the test pages."""

import re
import time
from html import unescape

import pytest

from eventlens.llm.html import BAD, GOOD, Block, blocks_of, decide, extract, main_text

LONG = "The cat is on the mat and it was there for the whole of the day with all of us."


def article(html):
    """What stands in the article element of a test page, block by block."""
    body = re.search(r"<article>(.*?)(</article>|\Z)", html, re.S)[1]
    parts = [" ".join(unescape(re.sub(r"<[^>]+>", "", p)).split())
             for p in re.split(r"</?(?:p|h1)[^>]*>", re.sub("<br>", " ", body))]
    return "\n".join(p for p in parts if p)


def test_articles_of_the_test_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    wanted = {r["page_id"]: article(r["html"]) for r in rows.collect()}
    found = extract(rows).collect()
    assert {r["page_id"]: r["text"] for r in found} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in found)


@pytest.mark.parametrize("html, text", [
    (f"<article><h1>A title</h1><p>{LONG}</p></article>", f"A title\n{LONG}"),
    (f"<nav><p>{LONG}</p></nav><main><p>{LONG}</p><aside>{LONG}</aside></main><footer>{LONG}</footer>", LONG),
    (f"<div class='cookie-notice'>{LONG}</div><article><p>Short.</p></article>", "Short."),
    (f"<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>{LONG}</p></article>", f"T\n{LONG}"),
    (f"<article><p>{LONG}</p><section id='comments'><p>{LONG}</p></section></article>", LONG),
    (f"<article><p>{LONG}</p><div class='ad'>{LONG}</div><p>End &amp; out&#33; &lt;b&gt;</p></article>", f"{LONG}\nEnd & out! <b>"),
    (f"<article><p>{LONG}</p><form><label>Name {LONG}</label><button>Go</button></form></article>", LONG),
    (f"<article><p>a<b>b</b>c&nbsp;d\n\t e<br>f</p><p>{LONG}</p></article>", f"abc d e f\n{LONG}"),
    (f"<article><script>if (a<b) {{ '</p>' }}</script><style>p {{}}</style><p>{LONG}</p><!-- <p>x</p> --></article>", LONG),
    (f"<article><p>{LONG}<p>{LONG}<ul><li>one<li>two</ul>", f"{LONG}\n{LONG}\none\ntwo"),
    (f"<div hidden><p>{LONG}</p></div><div style='display: none'>{LONG}</div><article>{LONG}</article>", LONG),
    (f"<body><p>{LONG}</p><p><a href='x'>{LONG}</a></p><p>{LONG}</p>", f"{LONG}\n{LONG}"),
    ("plain text without any markup", "plain text without any markup"),
    ("<<<>>> &lt; 1 < 2 &unknown;", "<<<>>> < 1 < 2 &unknown;"),
    ("<p", "<p"), ("<!-- never closed <p>x</p>", ""), ("<script>never closed", ""), ("", ""), (None, ""),
    ("<div class='\"><p>x</p>", "x"),
])
def test_pages(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("html, text", [
    (f"<body><form id='form1' runat='server'><nav>{LONG}</nav><div><p>{LONG}</p></div></form></body>", LONG),
    (f"<form id='form1'><div><main><p>{LONG}</p></main></div></form>", LONG),
    (f"<div><p>{LONG}</p></div><form><article><p>{LONG}</p></article></form>", LONG),
    (f"<main><form runat='server'><p>{LONG}</p></form></main>", LONG),
    (f"<form><div class='comments'><p>{LONG}</p></div><p>{LONG}</p><form><p>{LONG}</p></form></form>", f"{LONG}\n{LONG}"),
    (f"<div class='content-sidebar-wrap'><main><p>{LONG}</p></main></div>", LONG),
    (f"<div id='page' class='has-sidebar'><article><p>{LONG}</p></article></div>", LONG),
    (f"<div class='with-menu'><p>{LONG}</p></div>", LONG),
    (f"<div class='sidebar-right'><article><p>{LONG}</p></article><div class='widget'>{LONG}</div></div>", LONG),
    (f"<div class='page sidebar-right'><p>{LONG}</p><p>{LONG}</p><ul class='menu'><li>{LONG}</ul></div>", f"{LONG}\n{LONG}"),
    (f"<div class='promo'><article><p>{LONG}</p></article></div>", LONG),
    (f"<nav><main><p>{LONG}</p></main></nav><div role='main' class='menu'><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
    (f"<article class='post comments-open category-related'><p>{LONG}</p></article>", LONG),
    (f"<article><h2 id='related'>Of it</h2><section id='related-work'><p>{LONG}</p></section></article>", f"Of it\n{LONG}"),
    (f"<section id='social-life'><h2 id='notice'>Of it</h2><p>{LONG}</p></section>", f"Of it\n{LONG}"),
])
def test_marks_that_hold_the_page_do_not_lose_it(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("html", [
    f"<article><p>{LONG}</p><form class='newsletter'><p>{LONG}</p></form></article>",
    f"<article><p>{LONG}</p></article><div id='comments'><article><p>{LONG}</p></article><article>{LONG}</article></div>",
    f"<p>{LONG}</p><div class='site-footer'>{LONG}</div><div id='sidebar2'>{LONG}</div><p class='ad_slot'>{LONG}</p>",
    f"<div hidden><main><p>{LONG}</p></main></div><p>{LONG}</p>",
    f"<article><p>{LONG}</p></article><article class='comment-body'><p>{LONG}</p></article>",
    f"<div class='related'><article>{LONG}</article><article>{LONG}</article></div><p>{LONG}</p>",
    f"<p>{LONG}</p><aside><form><p>{LONG}</p><p>{LONG}</p></form></aside>",
])
def test_marked_parts_stay_outside(html):
    assert main_text(html) == LONG


def test_many_marks_in_each_other():
    assert main_text("<div class='menu'>" * 3000 + LONG) == LONG
    assert main_text("<form><div class='menu'>" * 1500 + LONG + "<nav>" * 1500 + LONG) == LONG


@pytest.mark.parametrize("link", [
    "".join(f"&#{ord(c)};" for c in "Привет"), "&eacute;&amp;&eacute;&amp;&eacute;", "one" + "\n" + " " * 60 + "two",
])
def test_linked_characters_are_counted_as_they_are_read(link):
    text = " ".join(unescape(link).split())
    block, = blocks_of(f"<p>{LONG} <a href='x'>\n  {link}\n</a> of it.</p>")
    assert block.linked == len(text) and block.chars == len(block.text)
    assert main_text(f"<article><p>{LONG} <a href='x'>{link}</a> of it.</p></article>") == f"{LONG} {text} of it."
    assert main_text(f"<p>{LONG}</p><p><a href='x'>{link * 9}</a></p><p>{LONG}</p>") == f"{LONG}\n{LONG}"


STRANGE = "zxq vbn " * 20


@pytest.mark.parametrize("html, text", [
    # the body in plain elements, and a card or a remark in the only article
    (f"<div>{LONG}</div><div>Short.</div><div>{LONG}</div><article><h3>More</h3><p>A card.</p></article>",
     f"{LONG}\nShort.\n{LONG}\nMore\nA card."),
    (f"<div><p>{LONG}</p><p>{LONG}</p></div><article><p>{LONG}</p></article>", "\n".join([LONG] * 3)),
    (f"<p>{LONG}</p><article><p>{STRANGE}</p></article><nav>{LONG}</nav>", f"{LONG}\n{STRANGE.strip()}"),
    (f"<nav>{LONG}</nav><p>{STRANGE}</p><p>vbn</p><p>{STRANGE}</p><nav>{LONG}</nav><article><p>zxq</p></article>",
     f"{STRANGE.strip()}\nvbn\n{STRANGE.strip()}\nzxq"),
    # the article holds the text: the rest goes
    (f"<p>{LONG}</p><article><p>{LONG}</p><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
    (f"<p>Words of a site.</p><article><p>{STRANGE}</p></article>", STRANGE.strip()),
    # frequent words decide in an article, too
    (f"<article><p>{LONG}</p><p><a href='x'>{LONG}</a></p><p>{STRANGE}</p><p><a href='x'>{LONG}</a></p></article>", LONG),
    (f"<article><p>{LONG}</p><p>{STRANGE}</p><p>{LONG}</p></article>", f"{LONG}\n{STRANGE.strip()}\n{LONG}"),
])
def test_an_article_is_evidence_beside_words_and_links(html, text):
    assert main_text(html) == text


def labels(*blocks):
    made = [Block(tag, in_article, outside, text=t, chars=len(t)) for t, tag, in_article, outside in blocks]
    decide(made)
    return [b.label for b in made]


def test_open_blocks_take_the_nearest_label():
    long, short = (LONG, "p", False, False), ("Short.", "p", False, False)
    out = ("Menu", "p", False, True)
    assert labels(long, short, long) == [GOOD] * 3
    assert labels(out, short, out, long) == [BAD, BAD, BAD, GOOD]
    assert labels(long, short, short, short, out) == [GOOD, GOOD, BAD, BAD, BAD]  # nearer, and the tie is bad
    assert labels(out, ("Head", "h2", False, False), long) == [BAD, GOOD, GOOD]
    assert labels(short, short) == [GOOD, GOOD]  # nothing is decided: nothing is lost
    strange = ("zxq vbn " * 20, "p", False, False)
    assert labels(long, strange, long) == [GOOD] * 3  # long, but without known words: open
    assert labels(out, strange, out) == [BAD, GOOD, BAD]


def test_long_and_deep_pages():
    assert main_text("<div>" * 3000 + LONG + "</div>" * 3000) == LONG
    assert main_text("<article>" + f"<p>{LONG}</p>" * 3000) == "\n".join([LONG] * 3000)
    assert len(blocks_of("<p>x" * 5000)) == 5000


def test_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>text</p>"), (2, "v", "")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    assert sorted(map(str, map(tuple, extract(pages).collect()))) == sorted(map(str, [
        (1, "u", "", 0), (1, "u", "", 0), (None, None, "text", 4), (2, "v", "", 0)]))
    assert extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("page", [
    "<a '" * 250_000, "<b>" * 150_000 + "<p>" * 150_000, "<div>" + "<b>" * 100_000 + "<h1></h1>" * 60_000,
    '<a b=">"' * 120_000 + "'", "<b>" * 100_000 + "</i>" * 150_000, "<p>a</p>" * 120_000,
    "<a " + "a" * 1_000_000 + " =>", "<a" + " " * 1_000_000 + "=>", "<!--" * 250_000, "<a \"'" * 200_000 + ">",
], ids=range(10))
def test_hostile_pages_take_linear_time(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 5


RIVER = "It was the first time that the people of the town had seen the river so high in the middle of the summer."


@pytest.mark.parametrize("before, part, after", [
    ("", "<h1><a href='x'>Linked title</a></h1>", RIVER),
    (RIVER, "<p><a href='x'>The whole report of the commission</a></p>", RIVER),
    (f"{RIVER}</p><p>{RIVER}</p><h2>Sources</h2><p>",
     "<ul><li><a href='1'>Report of the town</a></li><li><a href='2'>The river in numbers</a></li></ul>", ""),
    (RIVER, f"<section class='social'><h2>The social side</h2><p>{RIVER} {RIVER}</p></section>", RIVER),
    (RIVER, f"<div class='newsletter-study'><p>{RIVER} {RIVER}</p></div>", RIVER),
])
def test_parts_of_an_article_that_look_like_others_stay(before, part, after):
    page = f"<body><nav><a href='/'>Home</a></nav><article><p>{before}</p>{part}<p>{after}</p></article><footer>End</footer></body>"
    found = main_text(page)
    wanted = [" ".join(re.sub("<[^>]*>", " ", x).split()) for x in re.split("</?(?:p|li|ul|h1|h2|section|div)[^>]*>", f"{before}<p>{part}<p>{after}")]
    assert found.split("\n") == [w for w in wanted if w]


@pytest.mark.parametrize("part", [
    f"<div class='comments'><p>{RIVER} {RIVER}</p><p>{RIVER} {RIVER}</p></div>",
    f"<div class='advert'><p>{RIVER} {RIVER}</p></div>",
    f"<section class='sponsored'><p>{RIVER} {RIVER}</p></section>",
    "<div class='newsletter'><p>Sign up for our newsletter and get the best of the week in your inbox.</p></div>",
    "<div class='share'><a href='1'>Share this</a> <a href='2'>Tell your friends</a></div>",
    "<nav><ul><li><a href='1'>Home</a></li><li><a href='2'>News of the town</a></li></ul></nav>",
    f"<aside><p>{RIVER}</p></aside>",
])
def test_parts_of_an_article_that_are_others_go(part):
    assert main_text(f"<article><p>{RIVER}</p>{part}<p>{RIVER}</p></article>") == f"{RIVER}\n{RIVER}"


def test_an_article_of_links_is_a_list_of_links():
    links = "".join(f"<li><a href='{i}'>The story number {i}</a></li>" for i in range(40))
    assert "story number 3" not in main_text(f"<main><p>{RIVER}</p><ul>{links}</ul></main>")
