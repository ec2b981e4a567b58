"""Main text of web pages by composite text density.

For every element of the page: C characters and T tags below it, and LC, LT of them inside links. Its density is
``C/T * log(C/LC * T/LT) base ln(C/(C-LC) * LC + LCb/Cb * C + e)``, b being the body (a 0 counts as 1), so that text spread
over few tags counts for much and text in links for little. An element's sum is that of its children's densities, its own
text outside links counting as a child. Elements inside a line (``b``, ``span``, unknown ones) are part of the block around them. The
threshold is the least density on the path from the element of the greatest sum up to the body; from the body down, every
element whose density reaches the threshold marks the element of the greatest sum below it (itself included) as main text.

Page furniture is taken out first: elements that rarely hold the article (``nav``, ``footer``, ``form``, ``script``, ...) and
those with a class, id or role that is, or ends in, a word of ``FURNITURE`` (``cookie-notice``, but not ``comments-open`` or
``has-sidebar``); a ``header`` only where it is not inside the article. Where no ``article`` or ``main`` with text is left then, what
holds one stays after all, and so do forms and elements taken by name that hold most of the text outside links; density decides.

Defined results: NULL, empty and text-free pages give "" ; a page without any tag is one block of text; unclosed, crossed
and cut-off tags are closed where their parents close; a page of ``nav``, ``footer``, ``aside`` and the like alone gives "". Other columns are ignored; repeated rows are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu head title"
    .split()
)
#: Of these, what no reader sees as text, and what is never the article by its length alone.
HIDDEN = frozenset("script style noscript template iframe object svg canvas button select textarea head title".split())
ASIDES = frozenset("nav footer aside dialog menu header".split())
MAIN = ("article", "main")
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li "
    "main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag here closes an open element of the set, up to the nearest element that bounds it.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies disqus "
    "footer masthead menu nav navbar navigation newsletter notice notices popup promo promoted related share sharing sidebar "
    "signup social sponsor sponsored subscribe toolbar widget contentinfo complementary search".split()
)
#: Before a furniture word, these speak of a page that has it or not.
SPEAKS_OF = frozenset("has have no not non with without show hide".split())
WORD = re.compile(r"[A-Za-z]+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = (
        "tag", "parent", "items", "skip", "block", "chars", "tags", "link_chars", "link_tags", "own", "own_tags", "density",
        "total", "best", "plain", "holds",
    )

    def __init__(self, tag: str, parent: Node | None, skip: bool):
        self.tag, self.parent, self.items, self.skip = tag, parent, [], skip
        self.block = tag in BLOCKS
        self.chars = self.tags = self.link_chars = self.link_tags = self.own = self.own_tags = 0
        self.density = self.total = 0.0
        self.best: Node | None = None
        self.plain, self.holds = 0, False


class Builder(HTMLParser):
    """Elements and texts of a page, with the end tags that authors leave out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("body", None, False)

    def _furniture(self, tag: str, attrs: list) -> bool:
        if tag in SKIPPED:
            return True
        if tag == "header" and not self._inside("article"):
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        named = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")).lower()
        parts = (WORD.findall(name) for name in named.split())
        return any(p and p[-1] in FURNITURE and SPEAKS_OF.isdisjoint(p) for p in parts)

    def _inside(self, tag: str) -> bool:
        node = self.at
        while node is not None:
            if node.tag == tag:
                return True
            node = node.parent
        return False

    def _close(self, tags: tuple, bounds: tuple) -> None:
        node = self.at
        while node.parent is not None and node.tag not in bounds:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body"):
            return
        if tag in BLOCKS:
            self._close(("p",), ("td", "th", "div", "article", "section", "main", "blockquote", "li"))
        if tag in CLOSES:
            closed, bounds = CLOSES[tag]
            self._close(tuple(closed.split()), bounds)
        node = Node(tag, self.at, self._furniture(tag, attrs))
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag not in ("html", "body"):
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.items.append(data)


def _preorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(x for x in reversed(node.items) if isinstance(x, Node) and not x.skip)
    return out


def _restore(root: Node) -> None:
    """Take furniture back that holds the article of the page: its ``article`` or ``main``, or most of its text."""
    around: list[tuple[Node, bool]] = [(root, False)]
    while around:
        node, inside = around.pop()
        inside = inside or node.tag in MAIN
        if inside and any(isinstance(x, str) and not x.isspace() for x in node.items):
            return
        around.extend((x, inside) for x in node.items if isinstance(x, Node) and not x.skip)
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo.extend(x for x in node.items if isinstance(x, Node) and x.tag not in HIDDEN)
    for node in reversed(nodes):
        for item in node.items:
            if isinstance(item, str):
                node.plain += len(item.strip())
            else:
                node.holds = node.holds or item.holds
                if not (item.skip and item.tag in ASIDES):
                    node.plain += item.plain
        if node.tag == "a":
            node.plain = 0
        node.holds = node.holds or (node.tag in MAIN and node.plain > 0)
    for node in nodes:
        if node.skip and (node.holds if root.holds else node.tag not in ASIDES and 2 * node.plain > root.plain):
            node.skip = False


def _density(node: Node, body: Node) -> float:
    c, t = node.chars, max(node.tags, 1)
    if not c:
        return 0.0
    lc, lt = max(node.link_chars, 1), max(node.link_tags, 1)
    base = math.log(c / max(c - node.link_chars, 1) * lc + body.link_chars / max(body.chars, 1) * c + math.e)
    return max(c / t * math.log(c / lc * t / lt) / math.log(base), 0.0) if base > 1 else float(c) / t


def _measure(root: Node) -> list[Node]:
    """Counts, densities and sums of all elements, the last ones first; returns the blocks of the page."""
    nodes = _preorder(root)
    for node in reversed(nodes):
        for item in node.items:
            if isinstance(item, str):
                n = len(SPACE.sub(" ", item).strip())
                node.chars += n
                node.own += n
            elif not item.skip:
                node.chars += item.chars
                node.tags += item.tags + 1
                node.link_chars += item.link_chars
                node.link_tags += item.link_tags
                if not item.block:
                    node.own += item.own
                    node.own_tags += item.own_tags + 1
        if node.tag == "a":
            node.link_chars, node.link_tags, node.own = node.chars, node.tags + 1, 0
    for node in reversed(nodes):
        if node.block:
            node.density = _density(node, root)
            node.total = node.own / max(node.own_tags, 1)
        for item in node.items:
            if isinstance(item, Node) and not item.skip:
                node.total += item.density if item.block else item.total
                if item.best is not None and (node.best is None or item.best.total > node.best.total):
                    node.best = item.best
        if node.block and (node.best is None or node.total >= node.best.total):
            node.best = node
    return [node for node in nodes if node.block]


def _main_nodes(root: Node) -> set[int]:
    """The marked elements; all of a page whose text lies in the body itself."""
    nodes = _measure(root)
    top, limit = root.best, math.inf
    if top.total <= 0:
        return {id(root)}
    node = top
    while node is not None:
        limit = min(limit, node.density)
        node = node.parent
    return {id(n.best) for n in nodes if n.density >= limit and n.chars and n.best.total > 0} | {id(top)}


def _blocks(root: Node, marked: set[int]) -> Iterator[str]:
    """Texts of the marked elements in page order, cut at block elements."""
    run: list[str] = []
    todo: list[tuple] = [(root, id(root) in marked)]
    while todo:
        item, inside = todo.pop()
        if item is None:
            yield "".join(run)
            run = []
        elif isinstance(item, str):
            if inside:
                run.append(item)
        elif not item.skip:
            inside = inside or id(item) in marked
            below = [(x, inside) for x in item.items]
            if item.tag == "br":
                below = [(" ", inside)]
            if item.tag in BLOCKS:
                below = [(None, inside), *below, (None, inside)]
            todo.extend(reversed(below))
    yield "".join(run)


def main_text(html: str | None) -> str:
    """The article of a page: blocks in page order, white space as single spaces."""
    if not html:
        return ""
    page = Builder()
    page.feed(html)
    page.close()
    _restore(page.root)
    cut = (SPACE.sub(" ", block).strip() for block in _blocks(page.root, _main_nodes(page.root)))
    return " ".join(block for block in cut if block)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text and n_chars, from the whole page."""

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h if isinstance(h, str) else None) for h in html], dtype=object)

    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    out = pages.select(*kept, text(F.col(html_col).cast("string")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
