"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams events; block-level tags cut the page into
lines, each with its text and its number of tags.  A line's ratio of text to tags is
weighed by what its markup tells: nothing in menus, footers, forms and the like, a
tenth outside the article elements of a page that has some.  The ratios are smoothed
with a Gaussian and split by a threshold at their standard deviation; the runs above
it, less low ends, are the content lines.

Content lines are kept wherever they stand.  They also choose the elements that the
article fills: article elements that they fill by half, and the deepest container of
most of them.  Of the lines there that the ratios leave out (headings, short
paragraphs, lists) all are kept in an article element, and in another container those
that are running text.

A page takes time and memory in proportion to its length, however deep it is nested.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.llm.common import pieces

#: Elements that begin and end a line (fixed by HTML).
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page.
SILENT_TAGS = frozenset("script style template noscript svg math head title textarea select button iframe object canvas audio video".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog search".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Parts of class names and ids that tell boilerplate.
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner banners breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies copyright dialog disclaimer disqus feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion promotions recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split()
)
#: A start tag on the left ends an open element on the right, up to a block around both.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
REGION_TAGS = frozenset(("article", "main"))
#: Elements that can hold an article where no article element tells.
CONTAINERS = frozenset("article body center div main section td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text.
TEXT_TAGS = HEADINGS | frozenset("blockquote dd dt figcaption li p pre td th".split())
#: Of the names, those that wrappers and sections of an article bear too.
BROAD_NAMES = frozenset("dialog header login notice notices related share sharing social widget widgets".split())
#: Share of the content that the chosen container must hold; share of an article element that must be content.
REGION_SHARE, ARTICLE_SHARE = 0.7, 0.5
#: Weight of a line outside the article elements of a page that has some.
OUTSIDE = 0.1
_NAME_PARTS = re.compile(r"[^a-z0-9]+")


class Line(NamedTuple):
    """``tags``: start and end tags since the last line; ``element``: number of the
    innermost open element, -1 for none; ``block``: tag of the innermost block;
    ``links``: characters within links; ``dropped``: an element around it is
    boilerplate by its markup."""

    text: str
    tags: int
    element: int
    block: str
    links: int
    dropped: bool


class _Open(NamedTuple):
    """An open element.  ``block`` and ``wall``: places in the stack of the innermost
    block, and of the innermost block other than a paragraph, up to this one."""

    tag: str
    number: int
    silent: bool
    dropped: bool
    block: int
    wall: int


class _Events(HTMLParser):
    """Collects lines, and of every element its tag, its parent's number and whether
    it or an element around it is an article element (``regions``)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[_Open] = []
        self.where: dict[str, list[int]] = {}  # tag -> places in the stack of open elements
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.regions: list[bool] = []
        self.doubtful: list[int] = []  # elements with a broad name only
        self.parts: list[str] = []
        self.tags = self.links = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            last = self.open[-1] if self.open else None
            block = self.open[last.block].tag if last and last.block >= 0 else ""
            self.lines.append(Line(text, self.tags, last.number if last else -1, block, self.links, bool(last and last.dropped)))
            self.tags = 0
        self.parts.clear()
        self.links = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID_TAGS:
            if tag == "hr":
                self.flush()
            else:
                self.parts.append(" " if tag == "br" else "")
            return
        block = tag in BLOCK_TAGS
        if block:
            self.flush()
            self._imply(tag)
        last = self.open[-1] if self.open else _Open("", -1, False, False, -1, -1)
        found = self._is_boilerplate(tag, attrs)
        here, number = len(self.open), len(self.tag)
        if found is None:
            self.doubtful.append(number)
        self.tag.append(tag)
        self.parent.append(last.number)
        self.regions.append(tag in REGION_TAGS or (last.number >= 0 and self.regions[last.number]))
        self.where.setdefault(tag, []).append(here)
        self.open.append(_Open(tag, number, last.silent or tag in SILENT_TAGS, last.dropped or found is True, here if block else last.block, here if block and tag != "p" else last.wall))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and tag in ("svg", "path", "use", "script", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br" or tag in VOID_TAGS:
            self.parts.append(" ")
            return
        block = tag in BLOCK_TAGS
        if block:
            self.flush()
        places = self.where.get(tag)
        if places and (block or self.open[-1].block < places[-1]):  # an inline end tag closes no block
            self._close(places[-1])

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1].silent):
            self.parts.append(data)
            if self.where.get("a"):
                self.links += len(data)

    def _close(self, place: int) -> None:
        while len(self.open) > place:
            self.where[self.open.pop().tag].pop()

    def _imply(self, tag: str) -> None:
        """Close what a start tag ends by itself."""
        if self.open:
            place = max((self.where[t][-1] for t in CLOSED_BY.get(tag, ("p",)) if self.where.get(t)), default=-1)
            if place >= max(0, self.open[-1].wall):
                self._close(place)

    def _is_boilerplate(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool | None:
        """None where only a broad name tells so."""
        if tag in BOILERPLATE_TAGS:
            return True
        inside = bool(self.open) and self.regions[self.open[-1].number]
        if tag == "header" and not inside:
            return True
        if not attrs or tag in ("html", "body"):
            return False
        doubtful = False
        for name, value in attrs:
            if not value:
                continue
            if name == "role" and value.strip().lower() in BOILERPLATE_ROLES:
                return True
            if name in ("class", "id"):
                value = value.lower()
                if tag == "main" or (tag == "article" and not ("comment" in value or "reply" in value)):
                    continue
                parts = BOILERPLATE_NAMES.intersection(_NAME_PARTS.split(value))
                if inside:
                    parts -= {"header"}  # as the tag
                if parts - BROAD_NAMES:
                    return True
                doubtful = doubtful or bool(parts)
            elif name in ("hidden", "aria-modal") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                return True
        return None if doubtful else False


def smoothed(ratios: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing; the kernel is cut at two deviations and at the ends."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        weight = total = 0.0
        for k, w in zip(range(i - reach, i + reach + 1), kernel, strict=True):
            if 0 <= k < len(ratios):
                weight += w
                total += w * ratios[k]
        out.append(total / weight)
    return out


def content_lines(ratios: list[float]) -> list[bool]:
    """Lines whose smoothed ratio reaches the standard deviation of all of them (or
    their mean, if that is less).  Smoothing joins short lines to long neighbours; at
    the ends of a run it also adds what merely stands beside one, so lines there that
    miss the threshold by themselves go.  A line without weight is never content; of
    lines with weight the greatest always is."""
    if not ratios:
        return []
    smooth = smoothed(ratios)
    mean = sum(smooth) / len(smooth)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    bar = min(deviation, mean)
    flags = [x >= bar and r > 0 for x, r in zip(smooth, ratios, strict=True)]
    for order in (range(len(flags)), range(len(flags) - 1, -1, -1)):
        within = False
        for i in order:
            if flags[i] and not within:
                flags[i] = ratios[i] >= bar
            within = flags[i]
    if not any(flags) and max(ratios) > 0:
        flags[ratios.index(max(ratios))] = True
    return flags


def _summed(events: _Events, values: dict[int, float]) -> list[float]:
    """Sums over elements and all elements within them, of values by element."""
    sums = [float(values.get(k, 0)) for k in range(len(events.tag))]
    for k in range(len(sums) - 1, -1, -1):  # an element's number is above its parent's
        if events.parent[k] >= 0:
            sums[events.parent[k]] += sums[k]
    return sums


def _by_element(lines: list[Line], value) -> dict[int, float]:
    out: dict[int, float] = {}
    for k, line in enumerate(lines):
        if line.element >= 0 and (x := value(k, line)):
            out[line.element] = out.get(line.element, 0) + x
    return out


def _within(events: _Events, chosen: set[int]) -> list[bool]:
    """Whether each element is one of the chosen or stands within one."""
    out = []
    for k, parent in enumerate(events.parent):
        out.append(k in chosen or (parent >= 0 and out[parent]))
    return out


def _refuted(events: _Events, flags: list[bool]) -> set[int]:
    """Doubtful elements that their text says are boilerplate too: those whose
    lines, headings aside, hold less than half as much text a tag as the median
    content line.  Elements of headings alone are no boilerplate."""
    lines = events.lines
    usual = sorted(len(x.text) / max(1, x.tags) for x, flag in zip(lines, flags, strict=True) if flag and not x.dropped)
    bar = usual[len(usual) // 2] / 2 if usual else 0.0
    chars = _summed(events, _by_element(lines, lambda k, x: len(x.text) * (x.block not in HEADINGS)))
    tags = _summed(events, _by_element(lines, lambda k, x: x.tags * (x.block not in HEADINGS)))
    return {k for k in events.doubtful if chars[k] and chars[k] / max(1, tags[k]) < bar}


def main_text(html: str) -> str:
    """The article's lines joined by newlines, '' if there are none."""
    events = _Events()
    events.feed(html)
    events.close()
    events.flush()
    lines = events.lines
    if not lines:
        return ""
    inside = [x.element >= 0 and events.regions[x.element] for x in lines]
    marked = any(i and not x.dropped for i, x in zip(inside, lines, strict=True))
    weights = [0.0 if x.dropped else OUTSIDE if marked and not i else 1.0 for i, x in zip(inside, lines, strict=True)]
    flags = content_lines([w * len(x.text) / max(1, x.tags) for w, x in zip(weights, lines, strict=True)])
    gone: list[bool] = [False] * len(events.tag)
    if events.doubtful:
        gone = _within(events, _refuted(events, flags))
    lost = [x.dropped or (x.element >= 0 and gone[x.element]) for x in lines]
    flags = [f and not (x.element >= 0 and gone[x.element]) for f, x in zip(flags, lines, strict=True)]

    total = sum(len(x.text) for x, f in zip(lines, flags, strict=True) if f)
    if not total:
        return ""
    content = _summed(events, _by_element(lines, lambda k, x: len(x.text) * flags[k]))
    text = _summed(events, _by_element(lines, lambda k, x: len(x.text) * (not lost[k])))
    articles = {k for k, tag in enumerate(events.tag) if tag in REGION_TAGS and content[k] >= max(1, ARTICLE_SHARE * text[k])}
    # a child's number is above its parent's, so the last one is the deepest of a nested chain
    region = max((k for k, tag in enumerate(events.tag) if tag in CONTAINERS and content[k] >= REGION_SHARE * total), default=-1)
    in_article, in_region = _within(events, articles), _within(events, {region})

    def kept(k: int, x: Line) -> bool:
        if flags[k] or lost[k] or x.element < 0:
            return flags[k]
        return in_article[x.element] or (not articles and in_region[x.element] and x.block in TEXT_TAGS and 2 * x.links < len(x.text))

    return "\n".join(x.text for k, x in enumerate(lines) if kept(k, x))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page ``page_id, url, text, n_chars`` (code points).

    Null, empty and text-free pages give '' and 0.  Broken pages (unclosed tags,
    cut ends) are read as far as the parser's events go.  Very long and very deeply
    nested pages are read whole, in time in proportion to their length.  Repeated
    rows give repeated results; an empty table gives no rows; other columns are
    ignored.  Each page is worked on by itself in one narrow pass.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for some in pieces(rows, 2):
                texts = [main_text(x.as_py() or "") for x in some.column(2)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
