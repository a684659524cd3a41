"""Main-text extraction: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks. Each block has its word count and link density, those of its
neighbours, whether it is a heading, and a hint from the names of its containers. A CART tree, trained on the small
labelled table below (blocks of crawled pages, half of them with their containers' names hidden, and written cases),
says which blocks are article text; their texts are joined in page order by a blank line. Names that always mean
boilerplate (menus, footers, comments, adverts, hidden text) decide in the tree, unless an article's own tag bears them as one word among others; all others only
lower or raise a block's odds: an article inside a layout or form is one, long unlinked text flanked by such text is kept, lists of
links inside an article are dropped, and pages without names are read by words and links alone.

White space inside a block (any Unicode white space, after decoding character references) becomes one
space. Scripts, styles, templates, form fields, drawings, frames, noscript notices and comments are markup, not blocks;
formulas are text. Defined results:
null or empty html gives an empty text; unclosed, stray and truncated tags are tolerated; rows that repeat a
page_id each get their text; empty tables give empty results; extra columns are ignored. Nothing is capped.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.runtime import ship_code, spread

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title|annotation|annotation-xml)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|</?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",  # a tag whose quotes don't pair
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden|aria-label)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mspace mstyle munder mover munderover mpadded mphantom menclose mtable mtr mtd semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
AUTO_CLOSED = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option"))
#: Container tags and the words of class, id and role that mark what isn't article text.
BOILERPLATE_TAGS = frozenset("nav footer header aside form menu dialog fieldset button select option head".split())
ARTICLE_WORDS = frozenset("article main content entry post story body text".split())
BOILERPLATE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer header masthead sidebar aside ad ads advert adverts advertisement banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments reply replies discussion disqus "
    "related recommended recommendations widget form search pagination pager toolbar copyright legal disclaimer complementary contentinfo hidden".split()
)


#: Those of them that layouts and forms around an article bear too; the others always mean what they say.
LAYOUT_WORDS = frozenset("header masthead banner notice notices form search widget toolbar".split())
#: Words of a class name after which it says what a layout has, and last words of names of layouts and settings.
COMMENT_WORDS = frozenset("comment comments reply replies discussion disqus".split())
#: Words that say nothing of what a container holds; a name of such and of boilerplate words alone is sure.
PART_WORDS = frozenset(
    "area bar block body bottom box btn button card cell col column container content cta details fixed float footer frame grid group header heading holder icon icons id image img inline inner item items label layer layout left "
    "link links list main message module panel part pane placeholder primary region right root row secondary section side site slot small sticky story strip tab table template text top unit view wrap wrapper wrapping zone page post article entry global local sub the".split()
)
HAVING, LAYOUTS = frozenset("has no with without".split()), frozenset("layout page grid open closed enabled disabled".split())
NEUTRAL, SOFT, ARTICLE, HARD, HIDDEN = range(5)
#: The feature "mark" of a place: what its containers' names hint at, from boilerplate to article.
MARK = {NEUTRAL: 0, SOFT: -1, ARTICLE: 1, HARD: -2, HIDDEN: -2}
LANDMARK = re.compile(r"</form\b|<(?P<mark>main|article|nav|header|footer|aside|h1)\b", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    place: int  # neutral, inside a container with a doubtful mark, an article, one with a sure mark, or a hidden one
    heading: bool


def _hint(name: str, tag: str = "div") -> int:
    """What one class, id or role hints at. A name of boilerplate words, and of words for parts of pages, is sure, and so is any that speaks of comments.

    Beside other words (``legal-news``, ``cookie-recipes``) a boilerplate word is a doubt, which words and links may overrule. On an ``article`` or ``main`` tag
    only a name that is one word, or begins with comments, counts: the others name its kind, category and format."""
    parts = [x for x in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", name).lower()) if x]
    parts = parts[: next((i for i, x in enumerate(parts) if x in HAVING), len(parts))]
    if not parts or (parts[-1] in LAYOUTS and len(parts) > 1):
        return NEUTRAL
    words = set(parts)
    if tag in ("article", "main") and len(parts) > 1 and parts[0] not in COMMENT_WORDS:
        return ARTICLE if words & {"article", "main"} else NEUTRAL
    if words & BOILERPLATE_WORDS - LAYOUT_WORDS:
        known = all(x in BOILERPLATE_WORDS or x in PART_WORDS or x.isdigit() or len(x) < 3 for x in parts)
        return HARD if known or words & COMMENT_WORDS else SOFT
    if words & LAYOUT_WORDS:
        return NEUTRAL if words & ARTICLE_WORDS else SOFT
    return ARTICLE if words & {"article", "main"} else NEUTRAL


def _container(tag: str, attrs: str, place: int) -> int:
    """What a container makes of the place it stands in."""
    hints: set[int] = set()
    for name, value in ATTRIBUTE.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            hints |= {_hint(x, tag) for x in value.split()}
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return HIDDEN
    if place == HIDDEN:
        return HIDDEN
    if tag in ("html", "body", "main"):  # their classes speak of the page
        return ARTICLE if tag == "main" else place
    sure = HARD in hints and not (ARTICLE in hints and tag != "article")  # a main column beside a sidebar bears both names
    marked = tag == "article" or (ARTICLE in hints and HARD not in hints)
    if place in (SOFT, HARD):
        if marked and not sure and place == SOFT:
            return ARTICLE
        return HARD if place == HARD or sure or tag in BOILERPLATE_TAGS - {"form", "header", "fieldset"} else SOFT
    if sure:
        return HARD
    if marked:
        return ARTICLE
    if tag in BOILERPLATE_TAGS and not (tag == "header" and place == ARTICLE):
        return SOFT if tag == "form" else HARD
    return SOFT if SOFT in hints and not (place == ARTICLE and tag == "header") else place


def _wide_forms(page: str) -> Callable[[int], bool]:
    """Tells of a form's place whether the form is the page: it holds landmarks or more than half of the page."""
    ends: list[int] = []
    marks: list[int] = []
    for match in LANDMARK.finditer(page):
        (marks if match["mark"] else ends).append(match.start())

    def wide(at: int) -> bool:
        i = bisect_right(ends, at)
        end = ends[i] if i < len(ends) else len(page)
        return bisect_left(marks, at) < bisect_left(marks, end) or 2 * (end - at) > len(page)

    return wide


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    runs: list[str] = []
    linked = words_linked = 0
    at, heading = 0, False
    wide: Callable[[int], bool] | None = None

    def flush() -> None:
        nonlocal runs, words_linked
        text = " ".join(html.unescape("".join(runs)).split()) if runs else ""
        if text:
            words = text.count(" ") + 1
            out.append(Block(text, words, min(words_linked, words), stack[-1][1] if stack else NEUTRAL, heading))
        runs, words_linked = [], 0

    def add(text: str) -> None:
        nonlocal words_linked
        if text:
            runs.append(text)
            if linked:
                words_linked += len(text.split())

    for match in TOKEN.finditer(page):
        add(page[at : match.start()])
        at = match.end()
        tag = (match["tag"] or "").lower()
        if match["raw"] or not tag:
            continue
        closing = page.startswith("</", match.start())
        if tag == "br":
            runs.append(" ")
        elif tag == "a":
            linked = 0 if closing else 1
        elif tag in INLINE:
            place = stack[-1][1] if stack else NEUTRAL
            if not closing and match["attrs"] and tag not in VOID and place in (NEUTRAL, ARTICLE) and (inner := _container(tag, match["attrs"], place)) in (SOFT, HARD, HIDDEN):
                flush()
                stack.append((tag, inner))
            elif closing and any(t == tag for t, _ in stack) and stack[-1][0] == tag:
                flush()
                stack.pop()
        else:
            flush()
            linked = 0 if tag != "a" else linked
            if tag in HEADINGS:
                heading = not closing
            elif closing:
                if any(t == tag for t, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
            elif tag == "body":
                stack[:] = [(tag, _container(tag, match["attrs"], NEUTRAL))]  # also ends an open head
            elif tag not in VOID:
                if tag in AUTO_CLOSED and stack and stack[-1][0] == tag:
                    stack.pop()
                place = stack[-1][1] if stack else NEUTRAL
                if tag == "form" and place in (NEUTRAL, SOFT):
                    wide = wide or _wide_forms(page)
                    stack.append((tag, _container("div" if wide(match.start()) else tag, match["attrs"], place)))
                else:
                    stack.append((tag, _container(tag, match["attrs"], place)))
    add(page[at:])
    flush()
    return out


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "mark", "heading")
#: The labelled table: a row a block, features in the order above, then 1 for article text.
LABELLED = np.array(
    [
        # blocks of crawled pages: menus, titles and paragraphs, adverts, footers; half of them with their containers' names hidden
        (1, 1.00, 0, 0.00, 1, 1.00, 0, 0, 0), (1, 1.00, 0, 0.00, 1, 1.00, -2, 0, 0), (1, 1.00, 1, 1.00, 4, 0.00, -2, 0, 0), (1, 1.00, 1, 1.00, 1, 1.00, -2, 0, 0),
        (1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 0), (1, 1.00, 1, 1.00, 13, 0.00, -2, 0, 0), (10, 0.00, 8, 0.00, 136, 0.00, 0, 1, 1), (6, 0.00, 13, 0.00, 49, 0.00, 0, 1, 1),
        (12, 0.00, 10, 0.00, 110, 0.00, 0, 1, 1), (14, 0.00, 13, 0.00, 34, 0.00, 0, 1, 1), (9, 0.00, 5, 0.00, 28, 0.00, 0, 1, 1), (10, 0.00, 13, 0.00, 71, 0.00, 0, 1, 1),
        (10, 0.00, 10, 0.00, 19, 0.00, 0, 1, 1), (1, 0.00, 12, 0.00, 1, 0.00, 0, 1, 1), (1, 0.00, 17, 0.00, 77, 0.00, 0, 0, 1), (4, 0.00, 9, 0.00, 9, 0.00, 0, 0, 1),
        (5, 0.00, 99, 0.00, 14, 0.00, 0, 0, 1), (1, 0.00, 31, 0.00, 31, 0.00, 0, 0, 1), (6, 0.00, 31, 0.00, 28, 0.00, 0, 0, 1), (4, 0.00, 19, 0.00, 7, 0.00, 0, 0, 1),
        (6, 0.00, 100, 0.00, 9, 0.00, 0, 0, 1), (6, 0.00, 19, 0.00, 10, 0.00, 0, 0, 1), (4, 0.00, 4, 0.00, 150, 0.00, 0, 0, 1), (69, 0.00, 160, 0.00, 47, 0.00, 0, 0, 1),
        (17, 0.00, 11, 0.00, 8, 0.00, 0, 0, 1), (114, 0.00, 50, 0.00, 1, 0.00, 0, 0, 1), (11, 0.00, 90, 0.00, 17, 0.00, 0, 0, 1), (51, 0.00, 19, 0.00, 89, 0.00, 0, 0, 1),
        (16, 0.00, 149, 0.00, 35, 0.00, 0, 0, 1), (13, 0.00, 4, 0.00, 31, 0.00, 0, 0, 1), (11, 0.00, 54, 0.00, 9, 0.00, 0, 0, 1), (107, 0.00, 6, 0.00, 16, 0.00, 0, 0, 1),
        (98, 0.00, 92, 0.00, 26, 0.00, 0, 0, 1), (136, 0.00, 10, 0.00, 8, 0.00, 0, 0, 1), (186, 0.00, 10, 0.00, 104, 0.00, 0, 0, 1), (118, 0.00, 10, 0.00, 77, 0.00, 0, 0, 1),
        (52, 0.00, 24, 0.00, 33, 0.00, 0, 0, 1), (6, 0.00, 1, 1.00, 4, 0.00, 0, 0, 0), (6, 0.00, 1, 1.00, 9, 0.00, -2, 0, 0), (4, 0.00, 1, 1.00, 11, 0.00, 0, 0, 0),
        (8, 0.00, 1, 1.00, 11, 0.00, -2, 0, 0), (10, 0.00, 1, 1.00, 8, 0.00, 0, 0, 0), (11, 0.00, 1, 1.00, 2, 0.00, -2, 0, 0), (8, 0.00, 1, 1.00, 6, 0.00, 0, 0, 0),
        (4, 0.00, 1, 1.00, 11, 0.00, -2, 0, 0), (8, 0.00, 1, 1.00, 10, 0.00, -2, 0, 0), (8, 0.00, 1, 1.00, 5, 0.00, -2, 0, 0), (4, 0.00, 1, 1.00, 8, 0.00, 0, 0, 0),
        (7, 0.00, 1, 1.00, 7, 0.00, 0, 0, 0), (12, 0.00, 1, 1.00, 11, 0.00, -2, 0, 0), (12, 0.00, 1, 1.00, 10, 0.00, -2, 0, 0), (10, 0.00, 1, 1.00, 7, 0.00, 0, 0, 0),
        (14, 0.00, 66, 0.00, 0, 0.00, -2, 0, 0), (14, 0.00, 17, 0.00, 0, 0.00, 0, 0, 0), (14, 0.00, 26, 0.00, 0, 0.00, 0, 0, 0), (15, 0.00, 12, 0.00, 0, 0.00, -2, 0, 0),
        (14, 0.00, 17, 0.00, 0, 0.00, -2, 0, 0), (12, 0.00, 9, 0.00, 0, 0.00, -2, 0, 0), (9, 0.00, 46, 0.00, 0, 0.00, -2, 0, 0), (8, 0.00, 33, 0.00, 0, 0.00, -2, 0, 0),
        (14, 0.00, 135, 0.00, 0, 0.00, 0, 0, 0), (11, 0.00, 13, 0.00, 0, 0.00, 0, 0, 0), (12, 0.00, 28, 0.00, 0, 0.00, 0, 0, 0), (15, 0.00, 5, 0.00, 0, 0.00, -2, 0, 0),
        (8, 0.00, 211, 0.00, 0, 0.00, -2, 0, 0), (10, 0.00, 9, 0.00, 0, 0.00, -2, 0, 0), (13, 0.00, 62, 0.00, 0, 0.00, 0, 0, 0), (12, 0.00, 6, 0.00, 0, 0.00, -2, 0, 0),
        (9, 0.00, 8, 0.00, 39, 0.00, 1, 1, 1), (6, 0.00, 101, 0.00, 35, 0.00, 1, 0, 1), (1, 0.00, 35, 0.00, 44, 0.00, 1, 0, 1), (5, 0.00, 83, 0.00, 18, 0.00, 1, 0, 1),
        (56, 0.00, 22, 0.00, 54, 0.00, 1, 0, 1), (9, 0.00, 9, 0.00, 7, 0.00, 1, 0, 1), (45, 0.00, 14, 0.00, 6, 0.00, 1, 0, 1),
        # articles, and lists of links inside them
        (120, 0.00, 80, 0.00, 90, 0.00, 1, 0, 1), (60, 0.05, 12, 0.00, 40, 0.00, 1, 0, 1), (8, 0.00, 0, 0.00, 70, 0.00, 1, 1, 1), (1, 0.00, 60, 0.00, 50, 0.00, 1, 0, 1),
        (3, 0.00, 20, 0.00, 0, 0.00, 1, 0, 1), (14, 0.00, 2, 1.00, 60, 0.00, 1, 1, 1), (25, 0.40, 30, 0.00, 40, 0.00, 1, 0, 1), (4, 0.00, 5, 0.00, 4, 0.00, 1, 0, 1),
        (300, 0.01, 9, 0.00, 15, 0.00, 1, 0, 1), (2, 0.00, 2, 0.00, 2, 0.00, 1, 0, 1), (10, 0.90, 40, 0.00, 30, 0.00, 1, 0, 1), (1, 1.00, 30, 0.00, 30, 0.00, 1, 0, 1),
        (45, 0.00, 20, 0.00, 9, 0.10, 1, 0, 1), (7, 0.00, 10, 0.00, 100, 0.00, 1, 1, 1), (1, 0.00, 0, 0.00, 0, 0.00, 1, 0, 1), (11, 0.00, 10, 0.50, 12, 0.00, 1, 0, 1),
        (60, 0.00, 40, 0.00, 3, 1.00, 1, 0, 1), (200, 0.00, 90, 0.00, 1, 1.00, 1, 0, 1), (12, 0.00, 60, 0.00, 2, 1.00, 1, 0, 1), (2, 0.00, 30, 0.00, 2, 1.00, 1, 0, 1),
        (36, 0.50, 5, 0.90, 6, 0.90, 1, 0, 1), (3, 0.00, 2, 1.00, 2, 1.00, 1, 1, 1), (34, 0.00, 3, 1.00, 2, 0.80, 1, 0, 1), (90, 0.00, 0, 0.00, 5, 0.60, 1, 0, 1),
        (3, 1.00, 2, 1.00, 3, 1.00, 1, 0, 0), (4, 1.00, 3, 1.00, 2, 1.00, 1, 0, 0), (6, 0.95, 5, 1.00, 4, 1.00, 1, 0, 0), (12, 1.00, 9, 1.00, 11, 1.00, 1, 0, 0),
        (1, 1.00, 1, 1.00, 1, 1.00, 1, 0, 0), (2, 1.00, 4, 1.00, 60, 0.00, 1, 0, 0), (3, 1.00, 5, 1.00, 0, 0.00, 1, 0, 0), (5, 1.00, 80, 0.00, 12, 0.00, 1, 0, 1),
        (4, 0.00, 3, 1.00, 6, 0.00, 1, 0, 1), (1, 0.00, 12, 0.60, 4, 0.00, 1, 0, 1), (9, 0.00, 5, 1.00, 0, 0.00, 1, 0, 1), (2, 0.10, 40, 0.50, 3, 0.20, 1, 0, 1),
        (6, 0.00, 1, 1.00, 2, 1.00, 1, 0, 1), (12, 0.20, 8, 0.90, 30, 0.90, 1, 0, 1), (3, 0.00, 20, 0.30, 1, 0.00, 1, 0, 1), (5, 0.30, 2, 0.90, 90, 0.50, 1, 0, 1),
        (6, 0.50, 12, 0.00, 9, 0.00, 1, 0, 1), (10, 0.40, 5, 0.00, 20, 0.00, 1, 0, 1), (4, 0.50, 4, 0.00, 0, 0.00, 1, 0, 1), (20, 0.45, 3, 0.30, 8, 0.00, 1, 0, 1),
        (3, 0.00, 2, 1.00, 30, 0.00, 1, 0, 1), (5, 0.00, 1, 1.00, 60, 0.00, 1, 0, 1), (1, 0.00, 3, 1.00, 12, 0.00, 1, 0, 1),
        (2, 0.00, 3, 1.00, 90, 0.00, 1, 0, 1), (12, 0.00, 10, 0.50, 90, 0.00, 1, 0, 1), (2, 0.30, 40, 1.00, 30, 0.00, 1, 0, 1), (2, 0.00, 40, 1.00, 0, 0.00, 1, 0, 1),
        (2, 0.00, 3, 0.00, 8, 1.00, 1, 0, 1), (12, 0.30, 10, 1.00, 90, 1.00, 1, 0, 1), (2, 0.10, 0, 0.00, 2, 1.00, 1, 0, 1), (2, 0.10, 10, 0.50, 30, 1.00, 1, 0, 1),
        (12, 0.10, 40, 1.00, 90, 0.00, 1, 0, 1), (4, 0.00, 3, 0.00, 8, 0.00, 1, 0, 1), (25, 0.00, 40, 0.50, 8, 0.00, 1, 0, 1), (1, 0.30, 10, 0.00, 8, 0.00, 1, 0, 1),
        (7, 0.00, 0, 0.50, 30, 1.00, 1, 0, 1), (60, 0.00, 0, 0.00, 30, 0.40, 1, 0, 1), (12, 0.10, 40, 0.00, 0, 0.40, 1, 0, 1), (1, 0.00, 0, 0.00, 2, 1.00, 1, 0, 1),
        (4, 0.10, 1, 0.00, 8, 0.40, 1, 0, 1), (4, 0.00, 10, 1.00, 30, 1.00, 1, 0, 1), (25, 0.00, 40, 0.50, 30, 0.00, 1, 0, 1), (4, 0.30, 3, 0.50, 90, 0.40, 1, 0, 1),
        (1, 0.30, 40, 0.50, 0, 1.00, 1, 0, 1), (12, 0.00, 0, 0.50, 30, 0.40, 1, 0, 1), (25, 0.10, 40, 0.50, 30, 0.00, 1, 0, 1), (12, 0.00, 0, 0.50, 8, 1.00, 1, 0, 1),
        # menus, headers, footers, sidebars, notices, adverts, forms and comments
        (1, 1.00, 0, 0.00, 1, 1.00, -2, 0, 0), (2, 1.00, 1, 1.00, 1, 1.00, -2, 0, 0), (10, 0.00, 1, 1.00, 14, 0.00, -2, 0, 0), (22, 0.00, 120, 0.00, 0, 0.00, -2, 0, 0),
        (60, 0.00, 80, 0.00, 12, 0.00, -2, 0, 0), (5, 0.20, 90, 0.00, 3, 1.00, -2, 0, 0), (3, 0.00, 4, 1.00, 90, 0.00, -2, 1, 0), (150, 0.02, 90, 0.00, 30, 0.00, -2, 0, 0),
        (30, 0.10, 2, 1.00, 2, 1.00, -2, 0, 0), (9, 0.00, 9, 0.00, 100, 0.00, -2, 1, 0), (14, 0.60, 14, 0.60, 14, 0.60, -2, 0, 0), (45, 0.00, 45, 0.00, 45, 0.00, -2, 0, 0),
        (36, 0.00, 5, 0.50, 2, 1.00, -2, 0, 0), (90, 0.00, 3, 1.00, 2, 1.00, -2, 0, 0), (200, 0.00, 100, 0.00, 3, 0.90, -2, 0, 0), (1, 0.00, 0, 0.00, 90, 0.00, -2, 1, 0),
        (120, 0.00, 90, 0.00, 100, 0.00, -2, 0, 0), (80, 0.02, 120, 0.00, 70, 0.00, -2, 0, 0), (200, 0.01, 100, 0.00, 150, 0.00, -2, 0, 0), (20, 0.00, 20, 0.00, 20, 0.00, -2, 0, 0),
        (1, 1.00, 1, 1.00, 1, 1.00, -2, 0, 0), (3, 0.00, 2, 1.00, 90, 0.00, -2, 1, 0),
        # doubtful names around long unlinked paragraphs
        (120, 0.00, 90, 0.00, 100, 0.00, -1, 0, 1), (80, 0.02, 120, 0.00, 70, 0.00, -1, 0, 1), (200, 0.01, 100, 0.00, 150, 0.00, -1, 0, 1), (70, 0.00, 70, 0.00, 70, 0.00, -1, 0, 1),
        # pages without names: long or flanked by long blocks, few links; then lists of links and scraps
        (90, 0.00, 60, 0.00, 70, 0.00, 0, 0, 1), (40, 0.05, 8, 0.00, 30, 0.00, 0, 0, 1), (18, 0.00, 60, 0.00, 60, 0.00, 0, 0, 1), (9, 0.00, 2, 1.00, 60, 0.00, 0, 1, 1),
        (35, 0.00, 2, 1.00, 3, 1.00, 0, 0, 1), (12, 0.00, 40, 0.00, 45, 0.00, 0, 0, 1), (6, 0.00, 70, 0.00, 80, 0.00, 0, 1, 1), (250, 0.10, 3, 0.90, 5, 0.30, 0, 0, 1),
        (14, 0.10, 30, 0.00, 25, 0.00, 0, 0, 1), (22, 0.00, 1, 1.00, 22, 0.00, 0, 0, 1), (5, 0.00, 45, 0.00, 50, 0.00, 0, 0, 1), (28, 0.20, 20, 0.00, 0, 0.00, 0, 0, 1),
        (80, 0.00, 60, 0.00, 2, 1.00, 0, 0, 1), (55, 0.05, 30, 0.00, 4, 0.90, 0, 0, 1), (120, 0.00, 1, 1.00, 2, 1.00, 0, 0, 1), (30, 0.00, 60, 0.00, 3, 1.00, 0, 0, 1),
        (2, 1.00, 2, 1.00, 2, 1.00, 0, 0, 0), (4, 0.80, 3, 0.90, 30, 0.00, 0, 0, 0), (12, 0.90, 10, 0.90, 11, 0.80, 0, 0, 0), (3, 0.00, 2, 1.00, 2, 1.00, 0, 0, 0),
        (6, 0.00, 3, 0.80, 4, 0.70, 0, 0, 0), (25, 0.70, 5, 0.60, 6, 0.60, 0, 0, 0), (1, 0.00, 1, 0.00, 2, 1.00, 0, 0, 0), (8, 0.50, 3, 0.50, 2, 0.80, 0, 0, 0),
        (5, 0.00, 60, 0.00, 0, 0.00, 0, 0, 0), (7, 0.40, 30, 0.00, 3, 1.00, 0, 0, 0), (2, 0.00, 0, 0.00, 2, 1.00, 0, 0, 0), (40, 0.80, 90, 0.00, 4, 1.00, 0, 0, 0),
        # short paragraphs of pages without names; scraps under doubtful names; long blocks under sure ones
        (6, 0.00, 0, 0.00, 9, 0.00, 0, 1, 1), (9, 0.00, 6, 0.00, 12, 0.00, 0, 0, 1), (12, 0.00, 9, 0.00, 7, 0.00, 0, 0, 1), (7, 0.00, 12, 0.00, 0, 0.00, 0, 0, 1),
        (4, 0.00, 0, 0.00, 5, 0.00, 0, 0, 1), (5, 0.00, 4, 0.00, 0, 0.00, 0, 0, 1), (15, 0.00, 0, 0.00, 0, 0.00, 0, 0, 1), (3, 0.00, 0, 0.00, 8, 0.00, 0, 1, 1),
        (3, 0.00, 2, 1.00, 90, 0.00, -1, 0, 0), (6, 0.00, 3, 0.50, 4, 0.50, -1, 0, 0), (12, 0.00, 0, 0.00, 8, 0.00, -1, 0, 0), (40, 0.00, 12, 0.00, 20, 0.00, -2, 0, 0),
        (150, 0.00, 150, 0.00, 150, 0.00, -2, 0, 0), (90, 0.00, 90, 0.00, 0, 0.00, -2, 0, 0), (15, 0.00, 0, 0.00, 15, 0.00, -2, 0, 0), (8, 0.00, 8, 0.00, 120, 0.00, -2, 1, 0),
        (25, 0.00, 60, 0.00, 25, 0.00, -2, 0, 0), (500, 0.00, 20, 0.00, 300, 0.00, -2, 0, 0),
        (2, 1.00, 150, 0.00, 2, 1.00, 0, 0, 0), (2, 1.00, 80, 0.00, 1, 1.00, 0, 0, 0), (3, 1.00, 40, 0.00, 3, 1.00, 0, 0, 0), (12, 0.90, 60, 0.00, 9, 0.90, 0, 0, 0),
        (17, 0.00, 17, 0.00, 0, 0.00, -1, 0, 0), (25, 0.00, 20, 0.00, 3, 1.00, -1, 0, 0), (16, 0.00, 0, 0.00, 0, 0.00, -1, 0, 0), (30, 0.10, 40, 0.00, 4, 0.00, -1, 0, 0),
        (36, 0.00, 0, 0.00, 2, 0.00, -1, 0, 0), (20, 0.00, 2, 1.00, 1, 1.00, -1, 0, 0),
    ]
)


def train(table: np.ndarray, depth: int = 12) -> tuple | float:
    """CART by Gini impurity: (feature, threshold, low side, high side), or the share of article text in a leaf."""
    x, y = table[:, :-1], table[:, -1]
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = (2 * share * (1 - share) * len(y), None, None)
    for feature in range(x.shape[1]):
        values = np.unique(x[:, feature])
        for threshold in (values[1:] + values[:-1]) / 2:
            low = x[:, feature] <= threshold
            cost = sum(2 * part.mean() * (1 - part.mean()) * len(part) for part in (y[low], y[~low]))
            if cost < best[0] - 1e-9:
                best = (cost, feature, float(threshold))
    if best[1] is None:
        return share
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], train(table[low], depth - 1), train(table[~low], depth - 1)


@cache
def tree() -> tuple | float:
    return train(LABELLED)


def classify(node: tuple | float, x: tuple) -> bool:
    while isinstance(node, tuple):
        feature, threshold, low, high = node
        node = low if x[feature] <= threshold else high
    return node >= 0.5


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    shape = [(0, 0.0), *((b.words, b.linked / b.words) for b in found), (0, 0.0)]
    kept, node = [], tree()
    for i, b in enumerate(found, 1):
        if classify(node, (*shape[i], *shape[i - 1], *shape[i + 1], MARK[b.place], b.heading)):
            kept.append(b.text)
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    ship_code(pages.sparkSession)
    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*columns).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))


SQL = None
