"""Main text on pages of several shapes, and that the clusters decide it."""

import time

import numpy as np
import pytest

from kbspark.llm import html

TEXT = [f"This is sentence number {i} of the story and it goes on for a good while, as sentences of stories do." for i in range(12)]
P = [f"<p>{t}</p>" for t in TEXT]
LINKS = "<ul>" + "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(8)) + "</ul>"
MENU, SIDE = f"<nav>{LINKS}</nav>", f"<div>{LINKS}</div>"


def joined(*numbers):
    return " ".join(TEXT[i] for i in numbers)


SHAPES = {
    "no article": (f"<body>{SIDE}<div>{P[0]}{P[1]}<p>Short one.</p>{P[2]}</div>{SIDE}<div>{LINKS}</div></body>", f"{joined(0, 1)} Short one. {TEXT[2]}"),
    "heading before text": (f"<body>{SIDE}{SIDE}<div><h1>Head</h1><div>{P[0]}{P[1]}</div></div>{SIDE}</body>", f"Head {joined(0, 1)}"),
    "two articles": (f"<body>{MENU}<article>{P[0]}{P[1]}</article><article>{P[2]}<p>End.</p></article>{SIDE}</body>", f"{joined(0, 1, 2)} End."),
    "article of links": (f"<body>{MENU}<article>{P[0]}{P[1]}{P[2]}{P[3]}</article>{SIDE}<article>{LINKS}{LINKS}</article></body>", joined(0, 1, 2, 3)),
    "main around article": (f"<body>{MENU}<main><h1>Head</h1><p>{TEXT[0]}</p><article>{P[1]}{P[2]}</article>{SIDE}{SIDE}</main></body>", f"Head {joined(0, 1, 2)}"),
    "header in main": (f"<body><header>Site name</header><main><header><h1>Title</h1><a href=1>By X</a> <a href=2>Y</a></header>{P[0]}{P[1]}</main></body>", f"Title {joined(0, 1)}"),
    "discussion is a section": (f"<article>{P[0]}<section class='discussion'><h2>Discussion</h2>{P[1]}{P[2]}</section></article>", f"{TEXT[0]} Discussion {joined(1, 2)}"),
    "search methods": (f"<article>{P[0]}<div id='search-methods'>{P[1]}</div></article>", joined(0, 1)),
    "no sidebar": (f"<body>{MENU}<div class='content no-sidebar'>{P[0]}{P[1]}</div>{SIDE}</body>", joined(0, 1)),
    "related work": (f"<article>{P[0]}<section class='related-work'>{P[1]}{P[2]}</section><div class='related'>{LINKS}{LINKS}</div></article>", joined(0, 1, 2)),
    "sidebar and comments": (f"<article>{P[0]}{P[1]}<div class='sidebar-left'>{P[2]}</div><div id='comments-list'><article>{P[3]}</article></div></article>", joined(0, 1)),
    "notices and adverts": (f"<article>{P[0]}<p class='notice'>{TEXT[1]}</p><div class='ad-slot'>{P[2]}</div>{P[3]}<div hidden>{P[4]}</div></article>", joined(0, 3)),
    "empty article": (f"<body>{MENU}<article></article><div>{P[0]}{P[1]}</div>{SIDE}</body>", joined(0, 1)),
    "role": (f"<body>{SIDE}<div role=main><div>{P[0]}</div>{P[1]}</div>{P[2]}</body>", joined(0, 1)),
    "muted spans": (f"<article><p>{TEXT[0]} <span class=ad>buy <span>it</span> now</span></p>{P[1]}</article>", joined(0, 1)),
    "references": ("<article><p>a &lt;b&gt; &amp;amp; &#8364;&nbsp;&hellip;</p></article>", "a <b> &amp; € …"),
    "cut off": (f"<article>{P[0]}<p>{TEXT[1][:40]}", f"{TEXT[0]} {TEXT[1][:40]}"),
}


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(name):
    page, want = SHAPES[name]
    assert html.main_text(page) == want


def test_clusters_decide(monkeypatch):
    """With every line high, pages keep their link lists; with no smoothing, some lose lines between the text."""
    monkeypatch.setattr(html, "high", lambda values: np.ones(len(values), bool))
    changed = {name for name, (page, want) in SHAPES.items() if html.main_text(page) != want}
    assert {"no article", "article of links", "main around article", "related work", "no sidebar"} <= changed


def test_ratio_and_smoothing():
    values = html.smoothed(np.array([0.0, 0.0, 90.0, 80.0, 85.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]))
    assert abs(html.smoothed(np.full(9, 7.0)) - 7).max() < 1e-9 and values.argmax() == 3
    assert html.high(values).tolist() == [False, False, True, True, True, False, False, False, False, False, False] or html.high(values)[2:5].all()


def test_odd_pages(spark):
    rows = [(1, None, "x", 5), (2, "", "x", 5), (None, "<p>é \x00 &bogus; <", "x", 5), (2, "<article>" + "<p>word " * 200_000, "x", 5), (3, "<div>" * 3000 + "deep", "x", 5), (3, "<div>" * 3000 + "deep", "x", 5)]
    out = html.extract(spark.createDataFrame(rows, "page_id long, html string, text string, lines int"))
    got = sorted((r.page_id or 0, len(r.text), r.lines) for r in out.collect())
    assert got == sorted([(1, 0, 5), (2, 0, 5), (0, len(html.main_text(rows[2][1])), 5), (2, 5 * 200_000 - 1, 5), (3, 4, 5), (3, 4, 5)])
    assert html.extract(out.drop("text").limit(0)).count() == 0


HOSTILE = ["<div>some text here ", "<a ", "<!--", "</", "<![CDATA[", "<![CDATA[>", "<![if ", "<?", "<a b='", "<a b='>", "<script>", "<div></p>", "<div class=discussion>t ", "<article><main>x ", "<", "&#", "<![ "]


@pytest.mark.parametrize("unit", HOSTILE)
def test_a_megabyte_of_open_markup(unit):
    start = time.time()
    html.main_text(unit * (1_000_000 // len(unit)))
    assert time.time() - start < 20


def test_open_markup_ends_with_the_page():
    kept = f"<article>{P[0]}{P[1]}"
    for tail in ("<a href=x", "<!-- not closed <p>x</p>", "<script>x<p>y</p>", "</p", "<!doctype", "<?x"):
        assert html.main_text(kept + tail) == joined(0, 1), tail
    assert html.main_text(f"{kept}<a href='x>{TEXT[2]}") == joined(0, 1, 2)
    assert html.main_text("<article><p>&#" + "0" * 9000 + "65; &#" + "9" * 9000 + "; <![odd[x]>y") == "A � y"
