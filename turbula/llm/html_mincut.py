"""HTML extraction by minimum-cut labelling.

A page becomes a row of text blocks with their ancestors. A classifier gives
each block a log-odds of being content; its positive part is the capacity from
the source, its negative part that to the sink. Edges between neighbours in page
order, weighted by how near they are in the DOM, and between blocks of one
parent are the smoothness costs. The maximum flow's cut separates content from
boilerplate with the least sum of classifier and smoothness costs.

The classifier is a logistic regression on the shape of blocks (length, links,
punctuation, and the same of all blocks of their parent), trained on a bounded
sample of pages whose own semantic elements label their blocks. What elements,
classes and roles say is evidence of fixed log-odds beside it: an article alone
does not make a block content, nor a class boilerplate, if shape and
neighbourhood say otherwise. Edges are halved where one of two blocks is under
another telling element than the other.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turbula.llm.rows import map_rows
from turbula.llm.shared import bounded_sample

# Elements by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select button object audio video canvas head".split())
IMPLIED_END = {
    "p": frozenset("p".split()),
    "li": frozenset("p li".split()),
    "dd": frozenset("p dd dt".split()),
    "dt": frozenset("p dd dt".split()),
    "tr": frozenset("p tr td th".split()),
    "td": frozenset("p td th".split()),
    "th": frozenset("p td th".split()),
}
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CONTENT_ELEMENTS = frozenset("article main".split())
BOILERPLATE_ELEMENTS = frozenset("nav footer aside form menu dialog header".split())
CONTENT_NAMES = frozenset("article content main post entry story body-text articlebody post-content entry-content article-body".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus "
    "footer header masthead menu nav navbar navigation newsletter notice notices pagination popup modal promo promotion "
    "related recommended respond replies share sharing sidebar side-bar skip social sponsor sponsored subscribe toolbar widget widgets gdpr".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())

#: A class of which these come first tells about the page rather than its element.
ABOUT_THE_PAGE = frozenset("has no with without not hide show".split())
#: Elements whose text is code: without an end tag, they last to the end of the page.
CODE = frozenset("script style".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"<>]*\"|'[^'<>]*'|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*)(>|\Z)"
    # A quote that nothing closes: the tag ends at the next >.
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    text: str
    links: int
    parent: int
    depth: int
    heading: bool
    hint: int  # of the nearest telling ancestor: over 0 content, below boilerplate, 0 none; 2 by element or role, 1 by name
    teller: int = 0  # that ancestor
    shape: list[float] = field(default_factory=list)


def _boilerplate(word: str) -> str:
    """The boilerplate name that a class or id is or ends with, as in site-footer; else nothing."""
    if word in BOILERPLATE_NAMES:
        return word
    parts = _PARTS.split(word)
    return parts[-1] if parts[-1] in BOILERPLATE_NAMES and parts[0] not in ABOUT_THE_PAGE else ""


@dataclass
class Element:
    parent: int
    name: str
    content: int  # 2 an article or main, 1 by a class or id, 0 neither
    boilerplate: int  # 2 by its element or role, 1 by a class or id, 0 neither
    heading: bool  # boilerplate as a header, and nothing else
    size: int = 0  # characters of text in it
    main: int = 0  # of them in an article or main
    hint: int = 0
    teller: int = 0  # which element the hint is of


def _element(parent: int, name: str, attributes: str) -> Element:
    content, told = 2 * (name in CONTENT_ELEMENTS), [(2, name)] if name in BOILERPLATE_ELEMENTS else []
    if attributes and "=" in attributes:
        for m in _NAMES.finditer(attributes):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if kind == "role":
                told += [(2, value)] if value in BOILERPLATE_ROLES else []
                content = 2 if value in ("main", "article") else content
                continue
            for word in value.split():
                told += [(1, x)] if (x := _boilerplate(word)) else []
                content = max(content, int(word in CONTENT_NAMES))
    return Element(parent, name, content, max((k for k, _ in told), default=0), all(x == "header" for _, x in told))


def _hints(elements: list[Element], blocks: list[Block], owners: list[int]) -> None:
    """What the ancestors of each block say about it.

    An element with more than half of the text of articles and main, or of the
    page where there are none, is no boilerplate, whatever it is called. A header
    in content is its heading. An article in boilerplate by name is content; in
    a boilerplate element, like a teaser in an aside, it is not, but main is.
    """
    for b, k in zip(blocks, owners, strict=True):
        elements[k].size += len(b.text)
    for e in reversed(elements[1:]):
        if e.content == 2:
            e.main = e.size
        elements[e.parent].size += e.size
        elements[e.parent].main += e.main
    whole = elements[0]
    for number, e in enumerate(elements[1:], 1):
        inside = elements[e.parent].hint
        most = 2 * e.main > whole.main if whole.main else 2 * e.size > whole.size
        told = 0 if e.name in ("html", "body") or most or (e.heading and inside > 0) else e.boilerplate
        if inside < 0 and not (e.content == 2 and not told and (inside == -1 or e.name == "main")):
            own = 0
        else:
            own = -told or e.content
        e.hint, e.teller = (own, number) if own else (inside, elements[e.parent].teller)
    for b, k in zip(blocks, owners, strict=True):
        b.hint, b.teller = elements[k].hint, elements[k].teller


def read_blocks(page: str) -> list[Block]:
    """The text blocks of a page, in page order; unclosed and crossed elements are borne with."""
    blocks: list[Block] = []
    stack: list[tuple[str, int]] = [("", 0)]  # name, number
    elements, owners = [Element(0, "", 0, 0, False)], []
    endless: set[str] = set()  # of which no end tag follows
    text, links, link = [], 0, False
    at = 0

    def finish() -> None:
        nonlocal text, links
        if text:
            # References are decoded over the whole block.
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                top = len(stack) - 1
                own = top if stack[top][0] in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "td", "th", "dd", "dt", "blockquote") else top + 1
                blocks.append(Block(joined, min(links, len(joined)), stack[max(0, own - 1)][1], own, stack[top][0][:1] == "h" and stack[top][0][1:].isdigit(), 0))
                owners.append(stack[top][1])
        text, links = [], 0

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if link:
                links += len(piece)
        at = m.end()
        slash, name, attributes, end_mark = m.group(1, 2, 3, 4) if m[2] else m.group(5, 6, 7, 8)
        name = (name or "").lower()
        if not name or not end_mark:  # a comment, or a tag cut off by the page's end
            continue
        closing = bool(slash)
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at) if name not in endless else None
                if end:
                    at = end.end()
                else:  # only the tag goes; what else belongs in a head is left out by itself
                    endless.add(name)
                    at = len(page) if name in CODE else at
            continue
        if name in INLINE:
            if name == "a":
                link = not closing
            elif name == "br" or name == "img":
                text.append(" ")
            continue
        finish()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            link = False
            continue
        ends = IMPLIED_END.get(name) or (("p",) if name in ENDS_PARAGRAPH else ())
        while len(stack) > 1 and stack[-1][0] in ends:
            stack.pop()
        if name not in VOID and not attributes.endswith("/"):
            elements.append(_element(stack[-1][1], name, attributes))
            stack.append((name, len(elements) - 1))
    if at < len(page):
        rest = page[at:]
        cut = rest.rfind("<")
        if cut >= 0 and re.match(r"</?[a-zA-Z!]", rest[cut:]):
            rest = rest[:cut]
        text.append(rest)
    finish()
    _hints(elements, blocks, owners)
    family: dict[int, list[int]] = {}  # of each parent: words, characters of links and of text
    for b in blocks:
        sums = family.setdefault(b.parent, [0, 0, 0])
        for k, x in enumerate((b.text.count(" ") + 1, b.links, len(b.text))):
            sums[k] += x
    for b in blocks:
        b.shape = _shape(b, *family[b.parent])
    return blocks


SHAPE = ("bias", "log_words", "link_share", "marks", "heading", "capitals", "ends_sentence", "family_log_words", "family_link_share")


def _shape(b: Block, words_of_all: int, links_of_all: int, size_of_all: int) -> list[float]:
    words = b.text.split(" ")
    return [
        1.0,
        math.log1p(len(words)),
        b.links / max(1, len(b.text)),
        min(1.0, 10 * sum(b.text.count(c) for c in ".,;:!?") / len(b.text)),
        float(b.heading),
        sum(w[:1].isupper() for w in words) / len(words),
        float(b.text[-1] in ".!?"),
        math.log1p(words_of_all),
        links_of_all / max(1, size_of_all),
    ]


#: Log-odds by shape where no sample of pages can train them.
DEFAULT_WEIGHTS = (-3.0, 0.7, -3.0, 1.0, 0.5, -0.5, 1.0, 0.4, -2.0)


def fit_shapes(pages: list[str], rounds: int = 200) -> tuple[float, ...]:
    """Logistic regression of the shape of blocks whose ancestors label them; both classes weigh the same."""
    told = [(b.shape, b.hint > 0) for p in pages for b in read_blocks(p) if b.hint]
    y = np.array([k for _, k in told], float)
    if not len(y) or y.min() == y.max():
        return DEFAULT_WEIGHTS
    x = np.array([s for s, _ in told])
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, step = np.array(DEFAULT_WEIGHTS), np.zeros(len(SHAPE))
    for _ in range(rounds):
        miss = (y - 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))) * share
        step = 0.9 * step + x.T @ miss - 1e-3 * w
        w = w + 0.5 * step
    return tuple(np.round(w, 6).tolist())


@dataclass(frozen=True)
class CutCosts:
    """Log-odds of telling ancestors, the bound of the classifier's, and the smoothness costs."""

    content: float = 3.5
    content_name: float = 1.0
    boilerplate: float = 7.0
    boilerplate_name: float = 4.0
    shape_bound: float = 3.0
    neighbour: float = 2.0
    parent: float = 1.5

    def evidence(self, hint: int) -> float:
        by = (self.content_name, self.content) if hint > 0 else (-self.boilerplate_name, -self.boilerplate)
        return by[abs(hint) - 1] if hint else 0.0


def block_odds(blocks: list[Block], weights: tuple[float, ...], costs: CutCosts) -> list[float]:
    """The classifier's log-odds of each block alone."""
    found = []
    for b in blocks:
        z = sum(map(float.__mul__, weights, b.shape))
        found.append(max(-costs.shape_bound, min(costs.shape_bound, z)) + costs.evidence(b.hint))
    return found


def label_blocks(blocks: list[Block], weights: tuple[float, ...], costs: CutCosts = CutCosts()) -> list[bool]:
    """Which blocks are content, by the minimum cut."""
    n = len(blocks)
    excess = block_odds(blocks, weights, costs)  # over 0: left of the capacity from the source; below: of that to the sink
    edges: list[dict[int, float]] = [{} for _ in range(n)]

    def join(i: int, j: int, cost: float) -> None:
        cost *= 1.0 if blocks[i].teller == blocks[j].teller else 0.5
        edges[i][j] = edges[i].get(j, 0.0) + cost
        edges[j][i] = edges[j].get(i, 0.0) + cost

    first: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            apart = 0 if a.parent == b.parent else 1 + abs(a.depth - b.depth)
            join(i - 1, i, costs.neighbour / (1 + 2 * apart))
        anchor = first.setdefault(b.parent, i)
        if anchor < i - 1:
            join(anchor, i, costs.parent)

    # Augmenting paths from one source block at a time. What it reaches when no path
    # is left cannot reach the sink any more, for other blocks neither.
    closed = [False] * n
    for s in range(n):
        while excess[s] > 1e-12 and not closed[s]:
            came, queue, end = {s: -1}, deque([s]), -1
            while queue and end < 0:
                i = queue.popleft()
                for j, left in edges[i].items():
                    if left > 1e-12 and j not in came and not closed[j]:
                        came[j] = i
                        if excess[j] < -1e-12:
                            end = j
                            break
                        queue.append(j)
            if end < 0:
                for i in came:
                    closed[i] = True
                break
            flow, j = min(excess[s], -excess[end]), end
            while came[j] >= 0:
                flow, j = min(flow, edges[came[j]][j]), came[j]
            j = end
            while came[j] >= 0:
                i = came[j]
                edges[i][j] -= flow
                edges[j][i] += flow
                j = i
            excess[s] -= flow
            excess[end] += flow
    return closed


def main_text(page: str | None, weights: tuple[float, ...], costs: CutCosts = CutCosts()) -> str:
    """The main text of a page: content blocks in page order, joined by line feeds."""
    blocks = read_blocks(page or "")
    return "\n".join(b.text for b, keep in zip(blocks, label_blocks(blocks, weights, costs), strict=True) if keep)


def extract_main_text(
    pages: DataFrame,
    sample: int = 500,
    costs: CutCosts = CutCosts(),
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """Extract the main text of every page from its whole html.

    The shape classifier is trained on at most ``sample`` pages, chosen by a
    hash of their id. Returns ``page_id, url, text, n_chars``; a null or empty
    page, or one without content, gives an empty text. Null ids and urls are
    kept. Repeated rows are extracted each. An empty table gives an empty
    result. Other columns play no part.
    """
    key = F.col(id_column).cast("long")
    chosen = pages.select(key.alias("page_id"), F.col(html_column).alias("html")).where("html is not null")
    weights = fit_shapes([r["html"] for r in bounded_sample(chosen, ["page_id", "html"], sample)])

    def run(blocks: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, urls, htmls in blocks:
            texts = [main_text(h, weights, costs) for h in htmls]
            yield [keys, urls, texts, [len(t) for t in texts]]

    columns = [key.alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html")]
    return map_rows(pages, columns, run, "page_id long,url string,text string,n_chars long")
