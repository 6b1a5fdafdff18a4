"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, half to the grandparent and less above;
an element's points are discounted by the share of its text that stands in links; the best container is kept
together with siblings that score well or read like text. A page is worked out by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without article text.
SKIPPED = set(
    "script style noscript template head title nav footer header aside form button select textarea input label iframe object embed svg "
    "canvas audio video menu dialog noframes".split()
)
CLOSES = {  # an opening element ends an open one of the second kind, up to the third
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCK - {"br", "option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "head", "title"}
#: Words of a class or id that mark something other than the article.
ASIDE = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead comment comments disqus replies reply respond cookie cookies consent gdpr notice notification popup modal "
    "overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations toolbar pagination "
    "pager widget alert hidden skip disclaimer copyright legal".split()
)
#: Beginnings of such words written together, and the words that an article or main element may not have.
ASIDE_STEMS = ("commentlist", "commentform", "commentarea", "advert", "sidebar", "breadcrumb", "navbar", "navlink", "cookie", "newsletter", "sponsor")
ASIDE_ARTICLES = set("comment reply ad advert advertisement sponsored promo related teaser".split())
#: Words of the list that also name subjects: such a container stays if it holds most of the page's paragraph points.
WEAK = set("side menu header masthead notice notification alert social share sharing search login signup hidden skip legal copyright disclaimer widget".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
SCORED = {"p", "pre", "td", "blockquote", "li", "dd"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = {"article", "main"}
CONTAINER_BONUS = 2.5  # factor on the points of such an element: more than one block inside it, less than what holds several
LENGTH_POINTS = 3  # most points of a paragraph for its length, one for every 100 characters
SHARES = (1, 2, 6, 9, 12)  # what a paragraph's points are divided by for its parent, the parent's parent and so on
SIBLING = 0.2  # share of the best container's worth that a sibling needs
_WORD = re.compile(r"[a-z]+")
_COMMA = re.compile("[,،、，]")


class Node:
    __slots__ = ("tag", "skip", "weak", "parent", "children", "points", "mass", "chars", "linked")

    def __init__(self, tag: str, skip: bool, parent: Node | None, weak: bool = False):
        self.tag, self.skip, self.weak, self.parent = tag, skip, weak, parent
        self.children: list[Node | str] = []
        self.points = self.mass = 0.0
        self.chars = self.linked = 0


def _weak(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether only words of `WEAK` speak against the element."""
    return not _apart(tag, attrs, ASIDE - WEAK) and _apart(tag, attrs)


def _apart(tag: str, attrs: list[tuple[str, str | None]], words: set[str] = ASIDE) -> bool:
    if tag in SKIPPED:
        return True
    if tag in ("html", "body"):
        return False
    if tag in CONTAINERS:
        return any(name in ("class", "id") and not ASIDE_ARTICLES.isdisjoint(_WORD.findall((value or "").lower())) for name, value in attrs)
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in ASIDE_ROLES:
            return True
        if name in ("class", "id") and any(w in words or w.startswith(ASIDE_STEMS) for w in _WORD.findall(value)):
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", False, None)
        self.open: dict[str, int] = {}  # elements on the way from the root, by tag

    def _leave(self, node: Node) -> None:
        """Close everything from the current element up to and with ``node``."""
        while True:
            closed = self.at
            self.open[closed.tag] -= 1
            self.at = closed.parent
            if closed is node:
                return

    def _close(self, tags: set[str], limit: set[str]) -> None:
        if not any(self.open.get(t) for t in tags):
            return
        node, found = self.at, None
        while node.parent is not None and node.tag not in limit:
            if node.tag in tags:
                found = node
            node = node.parent
        if found:
            self._leave(found)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P and self.open.get("p"):
            self._close({"p"}, {"td", "th", "table", "button", "object"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        apart = bool(attrs or tag in SKIPPED) and _apart(tag, attrs)
        weak = apart and _weak(tag, attrs)
        node = Node(tag, self.at.skip or apart and not weak, self.at, weak)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash does not close an element of HTML

    def handle_endtag(self, tag):
        if tag in VOID or not self.open.get(tag):
            return
        node = self.at
        while node.tag != tag:
            if node.tag in ("td", "th", "table") and tag not in ("tr", "tbody", "thead", "tfoot", "table", "body", "html"):
                return  # a stray end tag does not leave a cell
            node = node.parent
        self._leave(node)

    def handle_data(self, data):
        self.at.children.append(data)


def _pre_order(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.skip]
    return order


def _text(nodes: list[Node]) -> str:
    """Text of the elements in page order; every block begins and ends a piece of its own."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed(nodes))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif not item.skip:
            edge = [" "] if item.tag in BLOCK else []
            stack += [*edge, *reversed(item.children), *edge]
    return " ".join("".join(out).split())


def extract(html: str | None) -> str:
    """Main text of one page; empty for null, empty or textless pages."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    order = _pre_order(tree.root)
    if any(node.weak for node in order):
        for node in reversed(order):  # children before parents
            node.mass = _own_points(node)[1] + sum(c.mass for c in node.children if isinstance(c, Node) and not c.skip)
        for node in order:
            node.skip = node.skip or node.weak and 2 * node.mass <= tree.root.mass
        order = _pre_order(tree.root)
    for node in reversed(order):
        inside = [c for c in node.children if isinstance(c, Node) and not c.skip]
        node.chars = sum(len(c.strip()) for c in node.children if isinstance(c, str)) + sum(c.chars for c in inside)
        node.linked = node.chars if node.tag == "a" else sum(c.linked for c in inside)
    candidates: list[Node] = []
    for node in order:
        paragraph, points = _own_points(node) if node.chars else (False, 0)
        if not points:
            continue
        up, level = (node.parent if paragraph else node), 0
        while up is not None and up.parent is not None and level < len(SHARES):
            if not up.points:
                candidates.append(up)
            up.points += points / SHARES[level] * (CONTAINER_BONUS if up.tag in CONTAINERS else 1)
            up, level = up.parent, level + 1
    worth = lambda n: n.points * (1 - n.linked / n.chars if n.chars else 0)
    best = max(candidates, key=worth, default=None)
    if best is None:
        return _text([tree.root])
    if best.tag in ("body", "html", "#root") or best.parent is None:
        return _text([best])
    floor = max(2.0, SIBLING * worth(best))
    kept = []
    for c in best.parent.children:
        if not isinstance(c, Node) or c.skip:
            continue
        links = c.linked / c.chars if c.chars else 0.0
        reads = c.tag in ("p", "pre", "blockquote") and c.chars and links < 0.25
        if c is best or worth(c) >= floor or reads or c.tag in HEADINGS:
            kept.append(c)
    return _text(kept)


def _own_points(node: Node) -> tuple[bool, int]:
    """Whether an element is a paragraph, which gives its points to its ancestors, and its points.

    Blocks with text of their own give points for that text to themselves and to their ancestors.
    """
    paragraph = node.tag in SCORED
    own = [c for c in node.children if isinstance(c, str)]
    if not paragraph and not (node.tag in ("div", "section", "article", "main", "body") and any(c.strip() for c in own)):
        return paragraph, 0
    chars = _chars(node) if paragraph else sum(len(c.strip()) for c in own)
    if not chars:
        return paragraph, 0
    return paragraph, 1 + sum(len(_COMMA.findall(c)) for c in own) + min(chars // 100, LENGTH_POINTS)


def _chars(node: Node) -> int:
    """Characters of an element, counted once."""
    if not node.chars:
        todo, total = [node], 0
        while todo:
            for c in todo.pop().children:
                if isinstance(c, str):
                    total += len(c.strip())
                elif not c.skip:
                    todo.append(c)
        node.chars = total
    return node.chars


def extracted(pages: DataFrame, html: str = "html", out: str = "__main") -> DataFrame:
    """``pages`` with the main text of each whole page; other columns pass through."""

    @F.pandas_udf("string")
    def run(body: pd.Series) -> pd.Series:
        return pd.Series([extract(x) for x in body], dtype=object)

    return pages.withColumn(out, run(F.col(html)))


def op4_main_text(pages: DataFrame) -> DataFrame:
    """Contract columns of the extraction, one row per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py()) for x in b.column(2)]
            columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
