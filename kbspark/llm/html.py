"""Main text of web pages by text-to-tag ratio over the standard library's parser events.

The parser's events are folded into lines, one per block. Each line has its text length per tag; the ratios are smoothed
with a Gaussian over neighbouring lines and split into two clusters by a threshold between the clusters' means. The high
lines select the content regions:

* Lines in elements that can't be main text (menus, forms, scripts, what is marked as an advert or as comments ...) go
  beforehand. A mark that may as well name a part of the article ("related-work", "discussion", a header) is only
  evidence: such an element goes unless most of its text is high, but for a header's headings.
* Articles with high lines are main text as a whole, each of them. Of a main element around articles, and of pages where
  no article or main element has a high line, those blocks are, of whose text most is high, and the headings before them;
  on such pages also lines elsewhere that are high by themselves.

Defined cases: null, empty and text-free pages give an empty text; markup that is cut off or not closed is read as far
as it goes (a tag, a comment or a script without an end takes the rest of the page with it, as in browsers); repeated rows, null keys and other columns pass through, but for one named text, which is replaced; no ties
arise; an empty table gives an empty table. A very long page is one value of a task; time and memory are in proportion.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions.html import feed
from kbspark.llm.common import slices, text_or_empty

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are never main text, and those that hold it.
DROPPED = frozenset("script style noscript template nav header footer aside form button select textarea iframe svg canvas object menu dialog head title".split())
REGIONS = frozenset(("article", "main"))
#: Words in a class, id or role that mark menus, sidebars, notices, adverts, forms and reader comments, those that may
#: also name parts of an article, and those that may stand beside a mark without changing its meaning.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices alert popup modal newsletter subscribe subscription comment comments disqus replies share sharing social widget toolbar pagination contentinfo complementary signup login".split())
PERHAPS = frozenset("discussion related search header reply".split())
BESIDE = frozenset("list box section area bar left right top bottom container wrapper wrap inner outer slot block unit item items links link form post page site article entry main thread count panel group holder primary secondary mobile desktop js".split())
_FREE = re.compile(r"^(?:no|not|non|without|has|have|with|hide)[-_]|[-_](?:free|less|none|off)$")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTAINERS = frozenset("article main section div aside nav header footer form ul ol table body html figure blockquote details fieldset".split()) | DROPPED
_WORDS = re.compile(r"[a-z]+")
CLEAR, UNSURE, MARKED = 0, 1, 2


def mark(attributes: list[tuple[str, str | None]]) -> int:
    """Whether an element is marked as no main text: CLEAR, UNSURE or MARKED."""
    most = CLEAR
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return MARKED
        for token in (value or "").lower().split() if name in ("class", "id", "role") else ():
            words = _WORDS.findall(token)
            if MARKS.isdisjoint(words) and PERHAPS.isdisjoint(words) or _FREE.search(token):
                continue
            # With other words beside it a mark may mean something else.
            sure = not MARKS.isdisjoint(words) and all(w in MARKS or w in PERHAPS or w in BESIDE for w in words)
            most = max(most, MARKED if sure else UNSURE)
    return most


class Line(NamedTuple):
    text: str
    tags: int
    heading: bool
    place: int  # the innermost container


class Container(NamedTuple):
    """An element around lines. `parent` is a smaller number; `name` is main for elements of that role too."""

    parent: int
    tag: str
    name: str
    mark: int
    region: bool  # whether it is in or is an article or a main element


class Lines(HTMLParser):
    """Folds parser events into lines outside dropped elements. Inline elements don't end a line.

    Lines and containers refer to each other by number, so that depth costs neither time nor memory. Container 0 is the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.containers = [Container(0, "", "", CLEAR, False)]
        self.place = 0
        self.open: dict[str, int] = {}  # open containers by tag
        self.parts: list[str] = []
        self.muted, self.depth = "", 0  # an inline element that is marked as boilerplate
        self.tags, self.heading = 0, False

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text and self.containers[self.place].mark != MARKED:
            self.lines.append(Line(text, self.tags, self.heading, self.place))
        if text:
            self.tags = 0
        self.parts, self.muted = [], ""

    def opened(self, tag: str, name: str, how: int) -> None:
        # What is inside a dropped element is dropped with it.
        around = self.containers[self.place]
        self.containers.append(Container(self.place, tag, name, MARKED if around.mark == MARKED else how, around.region or name in REGIONS))
        self.place = len(self.containers) - 1
        self.open[tag] = self.open.get(tag, 0) + 1

    def closed(self) -> str:
        around = self.containers[self.place]
        self.place = around.parent
        self.open[around.tag] -= 1
        return around.tag

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in INLINE:
            if tag == self.muted:
                self.depth += 1
            elif not self.muted and tag not in VOID and mark(attrs) == MARKED:
                self.muted, self.depth = tag, 1
            return
        self.end_line()
        self.heading = tag in _HEADINGS
        if self.place and self.containers[self.place].tag in ("p", tag) and tag not in _CONTAINERS:
            self.closed()  # a marked paragraph or item that wasn't closed
        if tag in VOID:
            return
        how = CLEAR if tag in ("body", "html", "main") or ("role", "main") in attrs else mark(attrs)
        if tag == "header" and self.containers[self.place].region:
            self.opened(tag, tag, max(how, UNSURE))
        elif tag in _CONTAINERS:
            self.opened(tag, "main" if ("role", "main") in attrs else tag, MARKED if tag in DROPPED else how)
        elif how:
            self.opened(tag, tag, how)

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag not in INLINE:
            self.end_line()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in INLINE:
            if tag == self.muted:
                self.depth -= 1
                self.muted = self.muted if self.depth else ""
            return
        self.end_line()
        self.heading = False
        if self.open.get(tag):
            while self.closed() != tag:
                pass

    def handle_data(self, data):
        if not self.muted:
            self.parts.append(data)


def smoothed(ratios: np.ndarray, sigma: float = 1.5) -> np.ndarray:
    """Gaussian mean of each line's neighbours within three deviations, with the weights that fall inside the page."""
    reach = int(3 * sigma)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    inside = slice(reach, reach + len(ratios))
    return np.convolve(ratios, weights)[inside] / np.convolve(np.ones(len(ratios)), weights)[inside]


def high(values: np.ndarray) -> np.ndarray:
    """The lines of the upper of two clusters: the threshold moves to the middle of the clusters' means until it rests."""
    threshold = values.mean()
    for _ in range(50):
        upper = values >= threshold
        if upper.all():
            return upper
        moved = (values[upper].mean() + values[~upper].mean()) / 2
        if moved == threshold:
            break
        threshold = moved
    return values >= threshold


def selected(lines: list[Line], containers: list[Container], is_high: np.ndarray, alone: np.ndarray) -> list[bool]:
    """Which lines are main text, by the cluster that each is in; `alone`: those high without their neighbours too.

    What lies below a container is summed up from the last one to the first, what lies above it is handed down from the
    first to the last.
    """
    n = len(containers)
    own, balance, votes = [0] * n, [0] * n, [False] * n
    for line, yes in zip(lines, is_high):
        own[line.place] += len(line.text) if yes else -len(line.text)
        votes[line.place] |= bool(yes)
    balance[:] = own
    article_below = [False] * n
    for i in range(n - 1, 0, -1):
        c = containers[i]
        article_below[i] |= votes[i] and c.name == "article"
        balance[c.parent] += balance[i]
        votes[c.parent] |= votes[i]
        article_below[c.parent] |= article_below[i]
    voted = [votes[i] and c.name in REGIONS for i, c in enumerate(containers)]
    any_voted = any(voted)
    # Of a main element around or inside an article that counts, not all is main text.
    article_above, region, whole, doubtful, only_headers = ([False] * n for _ in range(5))
    only_headers[0] = True
    for i in range(1, n):
        c = containers[i]
        article_above[i] = article_above[c.parent] or voted[i] and c.name == "article"
        region[i] = region[c.parent] or voted[i]
        whole[i] = whole[c.parent] or voted[i] and (c.name == "article" or not (article_above[i] or article_below[i]))
        bad = c.mark == UNSURE and balance[i] < 0
        doubtful[i] = doubtful[c.parent] or bad
        only_headers[i] = only_headers[c.parent] and (not bad or c.name == "header")
    out, after = [False] * len(lines), False  # whether the line after this one in its block is kept
    for i in range(len(lines) - 1, -1, -1):
        line, at = lines[i], lines[i].place
        block = own[at] >= 0
        if doubtful[at] and not (line.heading and region[at] and only_headers[at]):
            kept = False
        elif any_voted:
            kept = whole[at] or region[at] and (block or line.heading and after)
        else:
            kept = bool(is_high[i] and alone[i]) or block or line.heading and after
        out[i] = after = kept
    return out


def main_text(html: str) -> str:
    parser = Lines()
    feed(parser, html)
    parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    ratios = np.array([len(x.text) / max(1, x.tags) for x in lines])
    smooth = smoothed(ratios)
    is_high = high(smooth)
    return " ".join(x.text for x, yes in zip(lines, selected(lines, parser.containers, is_high, ratios >= smooth[is_high].min())) if yes)


def extracted(html: Column) -> Column:
    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in slices(batches):
            yield pages.map(main_text)

    return extract(html)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with `text`, the main text of the whole `html`."""
    return pages.withColumn("text", extracted(text_or_empty(html)))
