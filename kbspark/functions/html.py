"""Main text of a page as markdown (F12): per-row work that Spark has no function for."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that are dropped, and ids and classes that hold a page's text.
DROPPED = ("script", "style", "nav", "footer", "header", "iframe", "form", "aside", "noscript")
REGIONS = ("article", "main")
IDS = ("content", "main-content", "article", "post")
LEAST = 200


#: Sections that the parser knows by name; it raises an error for any other.
_SECTION = re.compile(r"<!\[(?!(?:temp|cdata|ignore|include|rcdata|if|else|endif)(?![-_.a-z0-9]))", re.I)
#: Numeric references: zeros before the number, and numbers beyond all code points (Python reads 4300 digits at most).
_ZEROS, _BEYOND = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[1-9][0-9]{8,};?")


def feed(parser: HTMLParser, page: str) -> None:
    """Passes the whole page to the parser in time in proportion to it, whatever is left open.

    The parser stops at the first markup without an end, and closing it there would search to the end of the page once for
    each that follows. Here a comment, an element of raw text or a tag that nothing ends takes the rest of the page with it;
    a tag whose quote isn't closed ends at its first '>', which happens at most once for each kind of quote; sections that
    aren't closed end at their first '>', all of them at once.
    """
    rest = _BEYOND.sub("\ufffd", _ZEROS.sub("&#", _SECTION.sub("<!x[", page)))
    while True:
        parser.feed(rest)
        rest = parser.rawdata
        if not re.match("<[a-zA-Z/!?]", rest) or parser.cdata_elem:
            break
        parser.rawdata = ""
        if rest.startswith("<!--"):
            return
        if rest.startswith("<!["):
            rest = rest.replace("<![", "<!x[")
            continue
        end = rest.find(">")
        if end < 0:
            return
        rest = rest[end + 1 :]
    if parser.cdata_elem:
        parser.rawdata = ""
    parser.close()


class _Markdown(HTMLParser):
    """Collects markdown of the whole body and of each region, by the region's rank (0 is best)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.dropped, self.open, self.link = 0, {}, None  # open regions' ranks by tag
        self.ranks = dict.fromkeys((0, 1, 2), 0)
        self.texts: dict[int, list[str]] = {}

    def add(self, text: str) -> None:
        if not self.dropped:
            for rank in (*(r for r, n in self.ranks.items() if n), 9):
                self.texts.setdefault(rank, []).append(text)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in DROPPED:
            self.dropped += 1
        rank = 0 if tag == "article" else 1 if tag == "main" or a.get("role") == "main" else 2 if a.get("id") in IDS else None
        if rank is not None:
            self.open.setdefault(tag, []).append(rank)
            self.ranks[rank] += 1
        if re.fullmatch("h[1-6]", tag):
            self.add("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "ul", "ol", "table", "section", "blockquote", "pre"):
            self.add("\n\n")
        elif tag in ("br", "tr"):
            self.add("\n")
        elif tag == "li":
            self.add("\n* ")
        elif tag in ("b", "strong"):
            self.add("**")
        elif tag == "a":
            self.link = a.get("href") or ""
            self.add("[")

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        if tag in ("b", "strong"):
            self.add("**")
        elif tag == "a" and self.link is not None:
            self.add(f"]({self.link})")
            self.link = None
        elif re.fullmatch("h[1-6]", tag) or tag == "p":
            self.add("\n\n")
        if self.open.get(tag):
            self.ranks[self.open[tag].pop()] -= 1

    def handle_data(self, data):
        self.add(re.sub(r"\s+", " ", data))


def markdown(html: str) -> str:
    """The first of article, main and known ids with more than LEAST characters, else the body; blank runs closed."""
    p = _Markdown()
    feed(p, html)
    texts = {r: "".join(t) for r, t in p.texts.items()}
    chosen = next((texts[r] for r in sorted(texts) if r < 9 and len(texts[r].strip()) > LEAST), texts.get(9, ""))
    lines = [x.strip() for x in chosen.split("\n")]
    kept = [x for x in lines if not re.fullmatch(r"\*?\s*\[[^\]]*\]\([^)]*\)", x)]  # lines of a link alone
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


def main_markdown(html: Column) -> Column:
    @F.pandas_udf("string")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(lambda h: markdown(h or ""))

    return convert(html)
