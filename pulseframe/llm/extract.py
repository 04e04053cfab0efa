"""Main text of web pages: streaming parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams start tags, end tags and text once. Block tags cut the page into lines; each line knows
its text, its number of tags, its innermost article or main element and its container. An element that is never article
text (menu, advert, form, comment, ...) is a span of lines from its start tag to its end tag; spans are judged when the page is
read. The text-to-tag ratios of all lines are smoothed with a Gaussian; lines above the threshold (the standard deviation of
the smoothed ratios) are content. Article and main elements with a content line are content regions as a whole if
their content outweighs that of the lines outside of them. Else the regions are the runs of content lines outside, with
the lines between two of them, the headings before them and the other lines of their containers, so that short paragraphs stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.words import slices, text_rows

#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0
#: Lines between two content lines that belong to the same region at most.
GAP = 3
#: Characters outside of all dropped elements that make a page's text; with fewer, a dropped element may hold it.
OUTSIDE = 100

# HTML element names and words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
DROPPED = frozenset(
    "head title script style noscript template nav header footer aside form button select textarea iframe object svg canvas audio video menu dialog "
    "search datalist".split())
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav widget widgets nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs header masthead footer comment comments commentlist disqus reply replies respond cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations toolbar pagination pager search complementary contentinfo".split())

#: Words that may stand beside one of them in a compound such as "comment-list"; "no-sidebar" or "has-header" is no such compound.
COMPOUND_WORDS = frozenset("area bar block box button buttons container content form group inner item items link links list outer panel section site text title wrap wrapper".split())

#: Words for what readers or advertisers add; SUBJECT_WORDS may stand before one of the first of them, as in "post-comments".
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
ADDED_WORDS = COMMENT_WORDS | frozenset("ad ads advert adverts related recommended recommendations promo promoted sponsored widget widgets".split())
SUBJECT_WORDS = frozenset("post user reader visitor entry article page blog".split())
#: Elements whose lines stay together, and elements that drop whatever they hold.
CONTAINERS = frozenset("div section td blockquote ul ol dl".split())
HARD = frozenset("head title script style noscript template button select textarea iframe object svg canvas audio video datalist".split())
#: Elements that run to the end of the page if they are not closed.
UNENDING = frozenset("script style title textarea".split())

_VERSION = re.compile(r"v?[0-9]+")
_SPLIT = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Line(NamedTuple):
    text: str
    tags: int
    article: int  # innermost article or main element, from 1
    container: int
    heading: bool


@dataclass
class Span:
    """Lines from the start tag of an element to its end tag (None: never closed)."""

    tag: str
    first: int
    hard: bool = False
    added: bool = False  # a comment, an advert or a teaser by its words
    end: int | None = None


class _Lines(HTMLParser):
    """Cuts a page into lines while its events stream by, and notes the spans of articles and of elements to drop."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = 0
        self.heading = False
        self.drops: list[Span] = []
        self.articles: list[Span] = []  # those without a word that drops them
        self.open: dict[str, list[list]] = {}  # per tag: [drop, article, container] of each open element
        self.within: dict[str, list[list]] = {"article": [], "container": []}  # open ones, outermost first: [number, is open]
        self.containers = 0
        self.numbered = 0

    def _cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self._inner("article"), self._inner("container"), self.heading))
            self.tags = 0
        self.parts, self.heading = [], False

    def _inner(self, kind: str) -> int:
        entries = self.within[kind]
        while entries and not entries[-1][1]:
            entries.pop()
        return entries[-1][0] if entries else 0

    def handle_starttag(self, tag, attrs):
        drop = None if tag in VOID else self._drop(tag, attrs)
        if tag in BLOCK or drop:
            self._cut()
        elif tag in ("br", "td", "th"):
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        self.heading = self.heading or tag in HEADINGS
        entry = [drop, None, None, None]
        if drop:
            drop.first = len(self.lines)
            self.drops.append(drop)
        if tag in ARTICLE:
            self.numbered += 1
            entry[2] = [self.numbered, True]
            self.within["article"].append(entry[2])
            if not drop:
                entry[1] = Span(tag, len(self.lines))
                self.articles.append(entry[1])
        elif tag in CONTAINERS:
            self.containers += 1
            entry[3] = [self.containers, True]
            self.within["container"].append(entry[3])
        self.open.setdefault(tag, []).append(entry)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        entries = self.open.get(tag)
        if tag in BLOCK or entries and entries[-1][0]:
            self._cut()
        if not entries:
            return
        drop, article, in_article, in_container = entries.pop()
        for span in (drop, article):
            if span:
                span.end = len(self.lines)
        for state in (in_article, in_container):
            if state:
                state[1] = False

    def handle_data(self, data):
        self.parts.append(data)

    def _drop(self, tag, attrs) -> Span | None:
        if not attrs and tag not in DROPPED:
            return None
        if tag in HARD or tag not in ("html", "body") and self._hidden(attrs):
            return Span(tag, 0, hard=True)
        words = None if tag in ("html", "body", "main") else self._marked(attrs)
        return Span(tag, 0, added=bool(words and not ADDED_WORDS.isdisjoint(words))) if words or tag in DROPPED else None

    @staticmethod
    def _hidden(attrs) -> bool:
        return any(name == "hidden" or name == "aria-hidden" and (value or "").lower() == "true" or name == "style" and _HIDDEN.search((value or "").lower())
                   for name, value in attrs)

    @staticmethod
    def _marked(attrs) -> list[str] | None:
        """The words of a class, id or role that is one of DROPPED_WORDS, or a compound of them and COMPOUND_WORDS."""
        for name, value in attrs:
            if name in ("class", "id", "role"):
                for token in (value or "").lower().split():
                    parts = [p for p in _SPLIT.split(token) if p and not _VERSION.fullmatch(p)]
                    beside = COMPOUND_WORDS if COMMENT_WORDS.isdisjoint(parts) else COMPOUND_WORDS | SUBJECT_WORDS
                    if not DROPPED_WORDS.isdisjoint(parts) and all(p in DROPPED_WORDS or p in beside for p in parts):
                        return parts
        return None


def _covered(n: int, spans) -> np.ndarray:
    """Which of ``n`` lines lie in one of the spans."""
    edges = np.zeros(n + 1, np.int64)
    for span in spans:
        edges[span.first] += 1
        edges[span.end] -= 1
    return np.cumsum(edges)[:n] > 0


def page_lines(html: str) -> tuple[list[Line], np.ndarray]:
    """The lines of a page, and which of them lie in an element that is dropped.

    An element that is never closed drops nothing. One that holds every article of the page drops nothing either if there
    is no text outside (below OUTSIDE characters), or, unless its words name comments, adverts or teasers, less than
    inside. Articles dropped for a word count only where no other article and no text is left.
    """
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._cut()
    lines, n = parser.lines, len(parser.lines)
    for span in parser.drops:
        if span.end is None and span.tag in UNENDING:
            span.end = n
    for span in parser.articles:
        span.end = n if span.end is None else span.end
    drops = [s for s in parser.drops if s.end is not None and s.end > s.first]
    sums = np.concatenate([[0], np.cumsum([len(x.text) for x in lines], dtype=np.int64)])
    sizes = np.diff(sums)
    hard = _covered(n, (s for s in drops if s.hard))
    seen = np.concatenate([[0], np.cumsum(~hard)])
    shown = lambda spans: [s for s in spans if seen[s.end] > seen[s.first]]
    dropped = _covered(n, drops)
    marked = [s for s in drops if not s.hard and s.tag == "article"]
    for articles in (shown(parser.articles), shown(marked)):
        if not articles:
            continue
        outside = sizes[~dropped].sum()
        first, end = min(s.first for s in articles), max(s.end for s in articles)
        own = {id(s) for s in articles}

        def holds(span) -> bool:
            if span.hard or id(span) not in own and (span.first > first or span.end < end):
                return False
            return outside < OUTSIDE or not span.added and outside < sums[span.end] - sums[span.first]

        drops = [s for s in drops if not holds(s)]
        dropped = _covered(n, drops)
        if not dropped[first:end].all():
            break
    return lines, dropped


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights inside the page count."""
    reach = max(1, int(np.ceil(2 * sigma)))
    weight = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma**2))
    full = np.convolve(ratios, weight)[reach : reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), weight)[reach : reach + len(ratios)]


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, white space inside a block as one space, joined by a line feed."""
    lines, dropped = page_lines(html or "")
    if not lines:
        return ""
    ratio = smoothed(np.where(dropped, 0.0, [len(x.text) / max(1, x.tags) for x in lines]))
    content = (ratio >= ratio.std()) & ~dropped
    article = np.array([x.article for x in lines])
    sizes = np.array([len(x.text) for x in lines])
    inside = content & (article > 0)
    if inside.any() and sizes[inside].sum() >= sizes[content & (article == 0)].sum():
        return "\n".join(lines[i].text for i in np.flatnonzero(np.isin(article, article[inside]) & ~dropped))
    free = ~dropped & (article == 0)
    chosen = content & free
    keep = np.flatnonzero(chosen)
    for i, j in zip(keep[:-1], keep[1:]):
        if j - i <= GAP + 1:
            chosen[i:j] |= free[i:j]
    container = np.array([x.container for x in lines])
    chosen |= free & (container > 0) & np.isin(container, container[keep])
    for i in np.flatnonzero(chosen):
        while i and lines[i - 1].heading and free[i - 1] and not chosen[i - 1]:
            i -= 1
            chosen[i] = True
    return "\n".join(lines[i].text for i in np.flatnonzero(chosen))


def _extract_batches(batches):
    for rows, texts in slices(batches, "html"):
        out = [main_text(t.decode("utf-8", "replace") if t else None) for t in texts]
        yield pa.record_batch({"page_id": rows.column("page_id"), "url": rows.column("url"), "text": pa.array(out, pa.string()),
                               "n_chars": pa.array([len(t) for t in out], pa.int64())})


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages(page_id, url, html)``.

    Null or empty html, and pages without article text, give an empty text. Null urls and ids stay null, repeated rows give
    repeated rows, markup that is cut off is read as far as it goes. An empty table gives no rows.
    """
    kinds = dict(pages.dtypes)
    rows = text_rows(pages, "page_id", "url", "html").withColumn("html", F.col("html").cast("string"))
    return rows.mapInArrow(_extract_batches, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
