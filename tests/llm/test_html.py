"""Main text of pages, and the cut against all labellings."""

import re
from itertools import product

import numpy as np
import pytest

from turbula.llm import html_mincut as H

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<header><nav><a href=/>Home</a> <a href=/b>News</a></nav></header><div class="cookie-banner">We use cookies.</div>
<article><h1>A &amp; B</h1><p>The first   paragraph, with <b>bold</b> words and enough of them to be one.</p>
<script>var x = "<p>no</p>";</script><p>The second paragraph&nbsp;has a <a href=x>link</a>, too. It also ends well.</p></article>
<aside>Related: <a href=1>one</a></aside><div class="comments"><p>Nice text, I liked it a lot, really.</p></div>
<form><label>Mail</label><button>Send</button></form><footer>All rights reserved</footer></body></html>"""


def test_article_without_its_surroundings():
    assert H.main_text(PAGE, H.DEFAULT_WEIGHTS) == (
        "A & B\nThe first paragraph, with bold words and enough of them to be one.\nThe second paragraph has a link, too. It also ends well."
    )


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!-- ", "<script>x", "</p></div>", "<p>" * 3000, "<div class='>"])
def test_broken_pages(page):
    assert isinstance(H.main_text(page, H.DEFAULT_WEIGHTS), str)


def test_the_cut_is_the_cheapest():
    rng = np.random.default_rng(6)
    costs = H.CutCosts()

    def half(a, b):
        return 1.0 if a.teller == b.teller else 0.5

    for _ in range(60):
        n = int(rng.integers(1, 9))
        blocks = [H.Block("x", 0, int(rng.integers(0, 3)), int(rng.integers(0, 3)), False, int(rng.choice([0, 0, 0, 1, 2, -1, -2])), int(rng.integers(0, 2)), rng.normal(size=7).tolist()) for _ in range(n)]
        weights = tuple(rng.normal(size=7).tolist())
        edges, first = [], {}
        for i, b in enumerate(blocks):
            if i:
                a = blocks[i - 1]
                edges.append((i - 1, i, half(a, b) * costs.neighbour / (1 + 2 * (0 if a.parent == b.parent else 1 + abs(a.depth - b.depth)))))
            anchor = first.setdefault(b.parent, i)
            if anchor < i - 1:
                edges.append((anchor, i, half(blocks[anchor], b) * costs.parent))
        unary = [
            max(-costs.shape_bound, min(costs.shape_bound, float(np.dot(weights, b.shape)))) + costs.evidence(b.hint) for b in blocks
        ]

        def price(kept, unary=unary, edges=edges):
            return sum(max(u, 0) if not k else max(-u, 0) for u, k in zip(unary, kept)) + sum(c for i, j, c in edges if kept[i] != kept[j])

        best = min(price(k) for k in product([False, True], repeat=n))
        assert price(H.label_blocks(blocks, weights, costs)) == pytest.approx(best)


LONG = "The council met on Monday, and after a long debate, it agreed on the plan, which will cost less than was feared. "
#: Pages as (html, main text) on which the classifier alone is wrong about some block and the cut is right about all.
CUT_DECIDES = [
    # A short line without marks between long paragraphs, with nothing that tells.
    (f"<div><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div><div><p>{LONG}</p><p>So it was</p><p>{LONG}{LONG}</p></div><div><a href=/i>Imprint</a></div>", f"{LONG}\nSo it was\n{LONG}{LONG}"),
    # A paragraph of the article whose class misleads.
    (f"<article><p>{LONG}</p><p class=promo>{LONG}</p><p>{LONG}</p></article>", "\n".join([LONG] * 3)),
    # A menu with an item as long as a sentence.
    (f"<div><ul><li><a href=/a>Home</a><li>The council met on Monday, and it agreed.<li><a href=/b>News</a><li><a href=/c>Sport</a><li><a href=/d>Weather</a></ul></div><div><p>{LONG}{LONG}</p><p>{LONG}</p></div>", f"{LONG}{LONG}\n{LONG}"),
]


@pytest.mark.parametrize("page,text", CUT_DECIDES)
def test_the_cut_is_right_where_the_classifier_alone_is_wrong(page, text):
    blocks = H.read_blocks(page)
    alone = [x > 0 for x in H.block_odds(blocks, H.DEFAULT_WEIGHTS, H.CutCosts())]
    want = "\n".join(x.strip() for x in text.split("\n"))
    assert H.main_text(page, H.DEFAULT_WEIGHTS) == want
    assert "\n".join(b.text for b, keep in zip(blocks, alone, strict=True) if keep) != want


def test_boilerplate_in_an_article_goes():
    page = f"<article><p>{LONG}</p><div class=ad>{LONG}</div><p class=notice>Updated today</p><p>{LONG}</p><div class=comments><p>{LONG}</p><p>{LONG}</p></div></article>"
    assert H.main_text(page, H.DEFAULT_WEIGHTS) == f"{LONG.strip()}\n{LONG.strip()}"


@pytest.mark.parametrize("tag", ['<p title="it>', "<p title='it>", '<p title="it" class="x>', '<p title="a <b> c">', "<p data-x='{\"a\": \"<i>\"}'>", '<p alt="a"title="b">'])
def test_quotes_in_tags_leave_no_markup(tag):
    text = H.main_text(f'<article>{tag}First words here.</p><p class="y">Second words here.</p></article>', H.DEFAULT_WEIGHTS)
    assert text == "First words here.\nSecond words here."


def test_shapes_are_learned_from_pages_that_tell_and_serve_those_that_do_not(spark):
    """Without any telling element or name, most pages' main text is still exact."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r["html"]]
    weights = H.fit_shapes(pages)
    bare = [re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", h).replace(' class="ad"', "") for h in pages]
    same = [H.main_text(a, weights) == H.main_text(b, weights) for a, b in zip(pages, bare, strict=True)]
    assert np.mean(same) >= 0.9


def test_table_of_pages(spark):
    rows = [(1, "u", PAGE, "a"), (1, "u", PAGE, "a"), (2, None, None, "b"), (None, "w", "", "c"), (3, "x", "<p>" + "Some sentence here. " * 20_000 + "</p>", "d")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["url"], r["n_chars"]) for r in H.extract_main_text(df).collect()), key=str)
    long, short = len(" ".join(["Some sentence here."] * 20_000)), len(H.main_text(PAGE, H.DEFAULT_WEIGHTS))
    assert got == sorted([(1, "u", short), (1, "u", short), (2, None, 0), (None, "w", 0), (3, "x", long)], key=str)
    assert H.extract_main_text(df.where("page_id < 0")).count() == 0


def test_whole_test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = H.extract_main_text(pages).collect()
    assert len(got) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in got)
    assert np.mean([r["n_chars"] > 0 for r in got]) > 0.8
