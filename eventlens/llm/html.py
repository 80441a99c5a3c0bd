"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from eventlens.llm.common import with_fields
from eventlens.llm.rules import FREQUENT

#: How a comment, a declaration or a tag starts.
START = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?])|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*))")
QUOTE = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![\w-])(hidden)(?![\w-])")

# ---------------------------------------------------------------------------
# Names of HTML elements, of roles, and usual names of page parts.
# ---------------------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTSIDE = frozenset("nav footer aside form button select option head dialog menu object canvas label".split())
OUTSIDE_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form".split())
#: As a whole word of a class or an id.
OUTSIDE_NAME = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored sponsors promo promotion banner cookie cookies "
    "consent gdpr notice notices notification popup modal newsletter subscribe subscription sidebar sidebars "
    "menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus respond replies "
    "reply share sharing social related recommended widget widgets toolbar pagination pager login signup".split()
)
#: Also as the first or the last part of a word, as in ``cookie-bar`` and ``site-footer``.
OUTSIDE_PART = frozenset(
    "ad ads advert advertisement sponsored promo banner cookie cookies gdpr popup modal newsletter subscribe sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs footer comment comments related recommended share sharing "
    "social widget widgets pagination pager login signup".split()
)
#: A word with such a part says what a page has or is about, as ``has-sidebar``, ``comments-open``, ``tag-menu``.
STATE = frozenset(
    "has with without no not is hide show open closed enabled disabled on off free supported layout content "
    "category tag topic type format status".split()
)
#: Names that may also stand on the article as a whole, where they do not tell it from the rest.
OUTSIDE_ARTICLE = frozenset("ad ads advert sponsored promo comment comments reply replies related teaser".split())
HEADER_NAME = frozenset("header masthead topbar".split())
#: Names of what stands beside the text: an element with one that holds most of a page's text is laid out so,
#: as ``<div class='sidebar-right'>`` around all of it.
LAYOUT_NAME = HEADER_NAME | frozenset("sidebar sidebars menu menus nav navbar navigation widget widgets toolbar banner".split())
#: Names of what is paid for; inside an article too, whatever it is like.
PAID_NAME = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored sponsors promo promotion".split())
#: Names of what others write, often more than the text.
OTHERS_NAME = frozenset("comment comments disqus respond replies reply related recommended teaser".split())

GOOD, BAD, OPEN = 1, -1, 0


#: Why an element is outside: it cannot be seen, its element or role tells, what its names tell, or it is a form.
HIDDEN, PLACE, OTHERS, NAMED, LAYOUT, FORM = range(6)
#: A long block has so many words, a dense one this share of frequent ones; a block of links has this share of them.
LONG, DENSE, LINKED = 12, 0.12, 0.35


@dataclass
class Block:
    tag: str
    in_article: bool
    outside: bool
    parts: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    chars: int = 0
    linked: int = 0
    text: str = ""
    label: int = OPEN
    region: int = 0

    @cached_property
    def words(self) -> int:
        return len(self.text.split())

    @cached_property
    def frequent(self) -> int:
        return sum(w.strip(".,;:!?\"'()").lower() in FREQUENT for w in self.text.split())


@dataclass
class Region:
    """An element that is outside as far as its start tag tells. The first one stands for the whole page."""

    parent: int
    reason: int | None
    chars: int = 0
    article: bool = False
    outside: bool = True
    #: Inside an article: how many words of dense blocks it takes to outweigh its name. None: it is the name that tells.
    text_wanted: int | None = None
    text_words: int = 0
    text_chars: int = 0


def _names(value: str, parts_too: bool, whole: frozenset[str], part: frozenset[str]) -> set[str]:
    """The names among the words of a class or an id: those that are the whole word but for digits, and
    with ``parts_too`` those that are its first or last part."""
    found = set()
    for word in value.split():
        parts = re.findall(r"[a-z]+", word)
        if len(parts) == 1:
            found.update(whole.intersection(parts))
        elif parts and parts_too and STATE.isdisjoint(parts):
            found.update(part.intersection((parts[0], parts[-1])))
    return found


def _reason(tag: str, attributes: str, in_article: bool, is_main: bool) -> tuple[int | None, frozenset[str]]:
    """Why an element is outside, None if it is not, and its names that tell so."""
    reason, none = None, frozenset()
    if tag in OUTSIDE or (tag == "header" and not in_article):
        reason = FORM if tag == "form" else PLACE
    if "=" not in attributes and "hidden" not in attributes:
        return reason, none
    names: set[str] = set()
    whole = OUTSIDE_NAME if in_article else OUTSIDE_NAME | HEADER_NAME
    for key, a, b, c, hidden in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if hidden or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return HIDDEN, none
        if key == "role" and value.strip() in OUTSIDE_ROLE:
            reason = FORM if value.strip() == "form" and reason is None else PLACE if value.strip() != "form" else reason
        if key not in ("class", "id") or is_main or tag in ("html", "body") or (key == "id" and tag in HEADING):
            continue
        if tag == "article":
            names |= _names(value, key == "class", OUTSIDE_ARTICLE, OUTSIDE_ARTICLE)
        else:  # ids of sections, and of all parts of an article, are often made from their titles
            made = key == "id" and (in_article or tag == "section")
            names |= _names(value, not made, whole, OUTSIDE_PART if in_article else OUTSIDE_PART | HEADER_NAME)
    if reason == PLACE or not names:
        return reason, none
    return OTHERS if names & OTHERS_NAME else LAYOUT if names <= LAYOUT_NAME else NAMED, frozenset(names)


def _text_wanted(tag: str, attributes: str, names: frozenset[str]) -> int | None:
    """How much text it takes for a part of an article not to be what its names say. A section, or a word of which the name
    is a part, as in ``newsletter-study``, is more likely to be about it than to be it."""
    if names & PAID_NAME:
        return None
    about = tag == "section" or not any(
        names & set((a or b or c).lower().split()) for key, a, b, c, _ in ATTRIBUTE.findall(attributes)
        if key.lower() in ("class", "id"))
    return 2 * LONG if about else 6 * LONG


def _place(blocks: list[Block], regions: list[Region]) -> None:
    """Settles which blocks are outside. A form, an element with a layout's name, or one with another name in which
    an article starts, is not outside if it holds more than half of the text that is not outside by
    any other reason: then it holds the page. Nor is a part of an article with a name in which dense blocks
    of text have the words that the name takes to be outweighed, and three quarters of the characters."""
    def counts(b: Block) -> bool:
        return regions[b.region].reason not in (HIDDEN, PLACE)

    for b in blocks:
        if counts(b):
            regions[b.region].chars += b.chars
            if b.words >= LONG and b.frequent >= DENSE * b.words and b.linked <= LINKED * b.chars:
                regions[b.region].text_words += b.words
                regions[b.region].text_chars += b.chars
    for r in reversed(regions[1:]):
        regions[r.parent].chars += r.chars
        regions[r.parent].article |= r.article
    regions[0].outside = False
    for r in regions[1:]:
        holds = r.reason in (FORM, LAYOUT) or (r.reason == NAMED and r.article)
        is_text = r.text_wanted is not None and r.text_words >= r.text_wanted and 4 * r.text_chars >= 3 * r.chars
        r.outside = regions[r.parent].outside or not (is_text or holds and 2 * r.chars > regions[0].chars)
    for b in blocks:
        b.outside = regions[b.region].outside
        b.in_article = b.in_article and not b.outside


def _tags(html: str) -> Iterator[tuple[str, bool, str, str]]:
    """The text before each tag, whether it is an end tag, its name and the rest of it; in the end what is left,
    without a tag. Comments, declarations and what is inside raw elements are left out.

    A tag ends at the first ``>`` outside of quotes or, if there is none, at the first one. Each place is looked at a
    bounded number of times: quotes from which no such ``>`` is found are remembered."""
    at, size, last = 0, len(html), html.rfind(">")
    last_quote = {q: html.rfind(q) for q in "\"'"}
    lost: set[int] = set()  # quotes that open on the way to a quote that nothing closes

    def end_of(start: int) -> int:
        p, passed = start, []
        while True:
            match = QUOTE.search(html, p)
            if match and match[0] == ">":
                return match.start()
            if not match or match.start() in lost or last_quote[match[0]] == match.start():
                lost.update(passed)
                if match:
                    lost.add(match.start())
                return html.find(">", start)
            passed.append(match.start())
            p = html.find(match[0], match.end()) + 1

    since = 0  # where the text before the next tag starts
    while True:
        match = START.search(html, at)
        if not match:
            break
        if match["comment"]:
            yield html[since:match.start()], False, "", ""
            close = html.find("-->", match.end())
            at = since = close + 3 if close >= 0 else size
            continue
        if match.end() > last:  # no tag ends any more; a comment may still start
            at = html.find("<!--", match.start())
            if at < 0:
                break
            continue
        if match["other"]:
            yield html[since:match.start()], False, "", ""
            at = since = html.find(">", match.end()) + 1
            continue
        stop, tag = end_of(match.end()), match["tag"].lower()
        yield html[since:match.start()], bool(match["end"]), tag, html[match.end():stop]
        at = since = stop + 1
        if tag in RAW and not match["end"]:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, at)
            at = since = html.find(">", close.end()) + 1 or size if close else size
    yield html[since:], False, "", ""


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page in order: text between starts and ends of block elements, references decoded
    and white space made one space, with what their place in the page says of them. Markup that is
    not closed ends where its parent ends; a block element closes an open paragraph. A ``main`` is outside only
    if it cannot be seen, whatever it stands in; an ``article`` is not outside because of a form."""
    found: list[Block] = []
    regions = [Region(0, None)]
    stack: list[tuple[str, int, bool, bool, int]] = []  # tag, region, in article, in link, place of the nearest block
    opened: Counter[str] = Counter()  # tags in the stack
    region, in_article, in_link = 0, False, False
    block = Block("", False, False)

    def add(raw: str) -> None:
        if raw:
            block.parts.append(raw)
            if in_link:
                block.links.append(raw)

    def plain(parts: list[str]) -> str:
        return " ".join(unescape("".join(parts)).split())

    def finish() -> None:
        nonlocal block
        if block.parts:
            block.text = plain(block.parts)
            if block.text:
                block.chars, block.linked = len(block.text), len(plain(block.links))
                found.append(block)
        k = nearest()
        block = Block(stack[k][0] if k >= 0 else "", in_article, False, region=region)

    def nearest() -> int:
        return stack[-1][4] if stack else -1

    def state() -> None:
        nonlocal region, in_article, in_link
        _, region, in_article, in_link, _ = stack[-1] if stack else ("", 0, False, False, -1)

    def close(k: int) -> None:
        opened.subtract(s[0] for s in stack[k:])
        del stack[k:]
        state()

    def enter(tag: str, rest: str, is_main: bool) -> int:
        """The region inside a start tag."""
        at = region
        reason, names = _reason(tag, rest, in_article, is_main)
        if regions[at].reason == HIDDEN:
            return at
        if is_main:
            at = 0
        if tag == "article":
            while regions[at].reason == FORM:
                at = regions[at].parent
            regions[at].article |= not in_article and reason is None
        # nothing inside of an outside place is judged again, nor a form in a form
        if reason is None or (reason != HIDDEN and regions[at].reason in (PLACE, reason if reason == FORM else PLACE)):
            return at
        wanted = _text_wanted(tag, rest, names) if in_article and reason in (NAMED, LAYOUT) else None
        regions.append(Region(at, reason, text_wanted=wanted))
        return len(regions) - 1

    for before, end_tag, tag, rest in _tags(html):
        add(before)
        if not tag:
            continue
        if end_tag:
            # what is walked over here is closed
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1) if opened[tag] else -1
            if k >= 0:
                close(k)
            if tag in BLOCK or (k >= 0 and region != block.region):
                finish()
            continue
        if tag in RAW:
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            closes = {"p"} | ({tag} if tag in ("li", "dt", "dd", "tr", "td", "th") else set())
            if nearest() >= 0 and stack[nearest()][0] in closes:
                close(nearest())
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            if tag in BLOCK:
                finish()
            continue
        is_main = tag == "main" or re.search(r"role\s*=\s*['\"]?main\b", rest, re.I) is not None
        inner = enter(tag, rest, is_main)
        changed = inner != region
        opened[tag] += 1
        stack.append((tag, inner, in_article or is_main or tag == "article", in_link or tag == "a",
                      len(stack) if tag in BLOCK else nearest()))
        state()
        if tag in BLOCK or changed:
            finish()
    finish()
    _place(found, regions)
    return found


def decide(blocks: list[Block]) -> None:
    """Labels blocks. First pass, each block alone: parts of the page that are outside and blocks of links are bad;
    long blocks with frequent words are good. What is short or without frequent words stays open, and so do linked
    headings and blocks of links in an article that is not made of links.

    Then the article is looked at: if it has at least as much good text as the rest of the page (or, on a
    page without any, at least as much long text), what is not in it is bad; else the rest is judged as it
    is. An article without any good block has its long blocks good (a language or a notation
    that the list does not know).

    Second pass: an open block takes the label of the nearest decided block before and after it; if they
    differ, of the nearer by blocks, and at equal distance the good one for headings and in an article,
    else the bad one. Within an article only its own blocks count as neighbours; an article without
    a decided block, or a page without any good block, keeps its open blocks, and so does a page
    without frequent words whose text is not in its article."""
    size = {True: 0, False: 0}  # of good text, in an article or not
    rest = {True: 0, False: 0}  # of other long text
    long_open = []
    own = [b for b in blocks if b.in_article and not b.outside]
    of_links = sum(b.linked for b in own) > LINKED * sum(b.chars for b in own)
    for b in blocks:
        if b.outside:
            b.label = BAD
        elif b.linked > LINKED * b.chars:
            b.label = OPEN if b.in_article and not of_links else BAD
        elif b.words >= LONG:
            if b.frequent >= DENSE * b.words:
                b.label = GOOD
                size[b.in_article] += b.chars
            else:
                rest[b.in_article] += b.chars
                long_open.append(b)
    unknown = not any(size.values())
    weight = rest if unknown else size
    inside = any(b.in_article and not b.outside for b in blocks)
    exclusive = inside and weight[True] >= weight[False]
    if inside and not size[True]:
        for b in long_open:
            if b.in_article:
                b.label = GOOD
    if exclusive:
        for b in blocks:
            if not b.in_article:
                b.label = BAD
    first = [b.label for b in blocks]
    # the nearest decided block, and the nearest that is not of an article, on either side
    sides = []
    for places in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        decided, border, seen = None, None, [(None, None)] * len(blocks)
        for i in places:
            seen[i] = decided, border
            if first[i] != OPEN:
                decided = i
            if not blocks[i].in_article or blocks[i].outside:
                border = i
        sides.append(seen)
    for i, b in enumerate(blocks):
        if first[i] != OPEN:
            continue
        near = {}
        for side, seen in zip(("before", "after"), sides):
            decided, border = seen[i]
            beyond = b.in_article and border is not None and decided is not None and abs(border - i) <= abs(decided - i)
            if decided is not None and not beyond:
                near[side] = (abs(decided - i), first[decided])
        labels = {label for _, label in near.values()}
        if not near:
            b.label = GOOD
        elif len(labels) == 1:
            b.label = labels.pop()
        else:
            (d1, l1), (d2, l2) = near["before"], near["after"]
            lean = GOOD if b.in_article or (b.tag in HEADING and l2 == GOOD) else BAD
            b.label = l1 if d1 < d2 else l2 if d2 < d1 else lean
    if not any(b.label == GOOD for b in blocks) or (unknown and inside and not exclusive):
        for b, label in zip(blocks, first):
            if label == OPEN:
                b.label = GOOD


def main_text(html: str | None) -> str:
    """The main text of a whole page, blocks joined by a newline; empty if the page has none, is null or
    empty."""
    if not html:
        return ""
    blocks = blocks_of(html)
    decide(blocks)
    return "\n".join(b.text for b in blocks if b.label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, from its whole ``html``. Null ids and
    urls stay null, repeated rows give equal rows, an empty table none; other columns are not looked at."""
    kept = ["page_id", "url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"],
            )

    return pages.select(*kept, "html").mapInArrow(
        run, with_fields(pages, kept, "text string, n_chars long")
    )
