"""Main text of web pages from flat text blocks and a decision tree (operator 3).

A page becomes a flat list of text blocks. Elements that are by their name or role no part of an article (nav, aside,
footer, form and the like) give none. Each other block has its number of words and its link density, those of the blocks
before and after it, and what the markup says of the place it stands in. A decision tree, grown here on the labelled
blocks of a few sample pages, decides which blocks are main text; names of classes are one of its features, and the samples
hold pages without names and pages whose names mislead.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>|<[a-zA-Z/!?][^>]*+\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# Element names of the HTML standard by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe select datalist audio video canvas".split())
BREAKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
AROUND = frozenset("nav footer aside form dialog menu button fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Parts of class and id names that tell of regions.
AROUND_WORDS = frozenset("ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus dropdown footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signin signup sitenav skip social sponsor sponsored subscribe subscription tags toolbar topbar trending widget widgets".split())
MAIN_WORDS = frozenset("article articlebody content entry main post story".split())
ROLES = {"navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "form": -1, "dialog": -1, "alert": -1, "menu": -1, "main": 1, "article": 1}


class Block(NamedTuple):
    text: str
    words: int
    link_words: int
    inside: int
    named: int
    heading: bool
    mark: str | None


class Place(NamedTuple):
    """An open element: inside is -1 around the main text, 1 in an article or main element; named, what class names say."""

    tag: str
    inside: int
    named: int
    hidden: bool
    mark: str | None


def place_of(tag: str, attrs: str, at: Place) -> Place:
    """The element's place, within the one at which it opens."""
    inside = -1 if tag in AROUND or (tag == "header" and at.inside != 1 and at.named != 1) else 1 if tag in ("article", "main") else 0
    named, hidden, mark = 0, False, at.mark
    if attrs and not attrs.isspace():
        values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)}
        hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
        inside = 1 if values.get("itemprop", "").lower() == "articlebody" else ROLES.get(values.get("role", "").lower(), inside)
        mark = values.get("data-y", mark)
        if tag not in ("html", "body", "main", "article"):
            parts = {p.lower() for p in PART.findall(values.get("class", "") + " " + values.get("id", ""))}
            named = -1 if parts & AROUND_WORDS else 1 if parts & MAIN_WORDS and tag in ("div", "section", "td") else 0
    return Place(tag, -1 if at.inside == -1 else inside or at.inside, -1 if at.named == -1 else named or at.named, at.hidden or hidden, mark)


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in its order; without scripts, styles, hidden parts and markup."""
    page = page or ""
    out: list[Block] = []
    stack = [Place("", 0, 0, False, None)]
    parts: list[str] = []
    links = in_link = 0
    heading = False
    low = None

    def flush():
        nonlocal links, heading
        if parts:
            words = "".join(parts).split()
            at_ = stack[-1]
            if words and not at_.hidden and at_.inside != -1:
                out.append(Block(" ".join(words), len(words), min(links, len(words)), at_.inside, at_.named, heading, at_.mark))
            parts.clear()
        links, heading = 0, any(s[0] in HEADINGS for s in stack[-3:])

    def say(raw: str):
        nonlocal links
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                links += len(text.split())

    at = 0
    while m := MARKUP.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "a":
                in_link = 0
            if tag in BREAKS:
                flush()
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth:
                del stack[depth:]
                if tag in BREAKS:
                    heading = any(s[0] in HEADINGS for s in stack[-3:])
            continue
        attrs = m[3] or m[6] or ""
        if tag in RAW:
            if not attrs.endswith("/"):
                low = page.lower() if low is None or len(low) != len(page) else low
                end = low.find("</" + tag, at) if len(low) == len(page) else next((x.start() for x in re.compile("</" + tag, re.I).finditer(page, at)), -1)
                close = page.find(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else len(page)
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BREAKS:
            flush()
            if tag == "p" and stack[-1][0] == "p":
                stack.pop()
        if tag in VOID:
            continue
        stack.append(place_of(tag, attrs, stack[-1]))
        if tag in HEADINGS:
            heading = True
        if tag == "a":
            in_link = 1
    say(page[at:])
    flush()
    return out


# ---------------------------------------------------------------- decision tree

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "inside", "named", "heading", "page_has_main")


def features(found: list[Block]) -> list[tuple]:
    has = int(any(b.inside == 1 for b in found))
    size = [(0, 0.0), *((b.words, b.link_words / b.words) for b in found), (0, 0.0)]
    return [(*size[i + 1], *size[i], *size[i + 2], b.inside, b.named, int(b.heading), has) for i, b in enumerate(found)]


def _gini(labels: list[int]) -> float:
    p = sum(labels) / len(labels)
    return 2 * p * (1 - p) * len(labels)


def grow(rows: list[tuple], labels: list[int], depth: int = 7):
    """A binary tree (feature, cut, below, above), or a label, of least Gini impurity at each split."""
    majority = int(2 * sum(labels) >= len(labels))
    if not depth or len(set(labels)) == 1:
        return majority
    best = None
    for f in range(len(rows[0])):
        order = sorted(range(len(rows)), key=lambda i: rows[i][f])
        for a, b in zip(range(1, len(rows)), range(len(rows) - 1)):
            lo, hi = rows[order[b]][f], rows[order[a]][f]
            if lo < hi:
                cost = _gini([labels[i] for i in order[:a]]) + _gini([labels[i] for i in order[a:]])
                if best is None or cost < best[0] - 1e-9:
                    best = (cost, f, (lo + hi) / 2)
    if best is None:
        return majority
    _, f, cut = best
    sides = [[i for i in range(len(rows)) if (rows[i][f] > cut) == up] for up in (False, True)]
    return (f, cut, *(grow([rows[i] for i in s], [labels[i] for i in s], depth - 1) for s in sides))


def decide(tree, row: tuple) -> int:
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
    return tree


def _say(n: int, links: int = 0) -> str:
    return " ".join(["word"] * (n - links)) + (f' <a href="#">{" ".join(["link"] * links)}</a>' if links else "")


def _page(*parts: tuple[str, int, int, int]) -> str:
    """A sample page: (elements from the outermost in, words, linked words, 1 for main text)."""
    out = []
    for element, words, links, label in parts:
        *outer, inner = element.replace("<", "").split(">")
        opened, closed = "".join(f"<{x}>" for x in outer), "".join(f"</{x.split()[0]}>" for x in reversed(outer))
        out.append(f'{opened}<{inner} data-y="{label}">{_say(words, links)}</{inner}>{closed}')
    return "<body>" + "".join(out) + "</body>"


#: The labelled table: blocks of sample pages as (element, words, linked words, main text or not).
SAMPLES = (
    # marked by elements
    _page(("div class=ad>p", 7, 0, 0), ("article>h1", 9, 0, 1), ("article>p", 60, 0, 1), ("article>p", 2, 0, 1), ("article>p", 1, 0, 1), ("article>p", 35, 2, 1)),
    _page(("ul>li", 2, 2, 0), ("main>h1", 6, 0, 1), ("main>p", 44, 1, 1), ("main>li", 5, 0, 1), ("main>li", 1, 1, 1), ("main>h2", 3, 0, 1), ("main>p", 80, 4, 1), ("div class=comments>p", 40, 0, 0)),
    _page(("div>p", 12, 0, 0), ("article>p", 20, 0, 1), ("article>p", 3, 3, 1), ("div>p", 25, 0, 0), ("div class=comment>p", 52, 0, 0), ("div>p", 3, 0, 0)),
    _page(("article>p", 5, 0, 1), ("article>p", 4, 4, 1), ("article>li", 9, 6, 1), ("article>p", 30, 0, 1), ("div>p", 60, 0, 0), ("div>p", 45, 1, 0)),
    _page(("div>li", 3, 3, 0), ("main>p", 3, 0, 1), ("main>p", 8, 8, 1), ("main>h3", 2, 2, 1), ("main>td", 1, 0, 1), ("main>p", 12, 3, 1), ("div>p", 80, 0, 0), ("div>h3", 4, 0, 0)),
    _page(("div>p", 70, 0, 0), ("div>p", 2, 0, 0), ("article>p", 1, 0, 1), ("article>p", 2, 1, 1), ("article>p", 1, 1, 1), ("div>p", 50, 0, 0), ("div class=comments>p", 100, 0, 0)),
    # names within an article: most tell of what isn't its text, some mislead
    _page(("article><div class=share>span", 2, 0, 0), ("article>p", 40, 0, 1), ("article><div class=ad>p", 12, 0, 0), ("article>p", 30, 0, 1), ("article><div class=related>li", 6, 6, 0), ("article><div class=comment>p", 25, 0, 0), ("article><div class=comment>p", 60, 1, 0)),
    _page(("article><div class=newsletter>p", 14, 0, 0), ("article>p", 50, 0, 1), ("article><div class=promo>p", 9, 3, 0), ("article>p", 8, 0, 1), ("article><div class=comment>p", 4, 0, 0)),
    # names alone
    _page(("div class=content>h1", 5, 0, 1), ("div class=content>p", 18, 0, 1), ("div class=content>p", 1, 0, 1), ("div class=content>p", 22, 8, 1), ("div id=share>p", 2, 2, 0), ("section class=newsletter>p", 14, 0, 0)),
    _page(("div class=cookie>p", 28, 1, 0), ("div>p", 26, 0, 1), ("div>p", 31, 0, 1), ("div class=sidebar>p", 33, 2, 0), ("div>li", 9, 9, 0), ("div>li", 4, 4, 0)),
    _page(("div>p", 30, 0, 1), ("div>p", 62, 0, 1), ("div class=sidebar>p", 40, 0, 0), ("div class=comments>p", 70, 0, 0), ("div class=popup>p", 8, 0, 0)),
    _page(("div class=menu>li", 3, 3, 0), ("div class=content>li", 3, 3, 1), ("div class=content>li", 6, 6, 1), ("div class=content>p", 7, 0, 1), ("div class=post>p", 20, 20, 1)),
    # no telling markup at all: the block and its neighbours
    _page(("div>li", 3, 3, 0), ("div>li", 2, 2, 0), ("div>p", 2, 0, 0), ("div>li", 2, 2, 0), ("div>h1", 7, 0, 1), ("div>p", 45, 0, 1), ("div>p", 3, 0, 1), ("div>p", 70, 2, 1), ("div>p", 12, 1, 1), ("div>li", 5, 5, 0), ("div>p", 3, 0, 0), ("div>li", 4, 4, 0), ("div>p", 6, 3, 0)),
    _page(("td>p", 4, 4, 0), ("td>p", 3, 0, 0), ("td>p", 3, 3, 0), ("td>p", 90, 0, 1), ("td>p", 33, 0, 1), ("td>p", 8, 0, 1), ("td>p", 1, 0, 1), ("td>p", 64, 5, 1), ("td>p", 5, 3, 0), ("td>p", 4, 1, 0), ("td>p", 6, 6, 0)),
    _page(("div>li", 1, 1, 0), ("div>li", 1, 1, 0), ("div>p", 4, 0, 0), ("div>li", 3, 3, 0), ("div>li", 2, 1, 0), ("div>p", 22, 0, 1), ("div>p", 5, 0, 1), ("div>p", 19, 3, 1)),
    _page(("p", 40, 0, 1), ("p", 15, 0, 1), ("p", 2, 0, 1), ("p", 38, 1, 1)),
    _page(("h1", 1, 0, 1), ("p", 3, 0, 1), ("p", 1, 0, 1)),
    _page(("p", 11, 0, 1)),
    _page(("p", 3, 0, 1)),
    _page(("h2", 4, 0, 1), ("p", 5, 0, 1), ("p", 4, 0, 1), ("p", 6, 1, 1), ("p", 3, 0, 1)),
    _page(("p", 2, 2, 0), ("p", 5, 5, 0), ("p", 3, 3, 0)),
)


def train(samples=SAMPLES):
    rows, labels = [], []
    for page in samples:
        found = blocks(page)
        rows += features(found)
        labels += [int(b.mark or 0) for b in found]
    return grow(rows, labels)


def main_text(page: str | None, tree) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, row in zip(found, features(found)) if decide(tree, row))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html).

    A null, empty or blank page, and one without main text, has the empty text. Markup that breaks off or isn't closed is
    read as far as it goes. Equal rows give equal rows. Other columns are not read.
    """
    C.ship(pages.sparkSession)
    tree = train()

    def run(batches):
        for b in batches:
            text = [main_text(h.as_py(), tree) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
