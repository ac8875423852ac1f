"""Main text of HTML pages by scoring the element tree.

Elements that never hold the article (menus, forms, scripts, hidden parts) are left out of the tree. Elements whose
class or id speaks of adverts, comments, sidebars and the like are doubtful: they are cut off unless they also carry a
name of the article, or stand inside a sentence. Each paragraph then passes points for its length and its commas to
its ancestors, the full sum to the parent and less to those further up; a container's sum is discounted by the share
of its text inside links. The best container, and those of its siblings that score well or are prose themselves, make
the article. If that leaves little and a doubtful element holds far more prose, the page's only article carries a
misleading name: that element is put back and the page is scored again.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![A-Za-z0-9_-])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))|(?=[\s/]|\Z))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_DROPPED = frozenset("script style head title nav header footer aside form noscript template iframe object embed svg canvas button select option textarea input label fieldset dialog menu audio video math".split())
_BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hr center header footer hgroup".split())
_CLOSES_P = _BLOCK - {"html", "body"}
_NEVER_DROPPED = frozenset(("html", "body", "main", "article"))
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Parts of class names and ids of what isn't the article, and of what is.
_UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comments comment commentlist disqus respond reply replies share sharing social related recommended recommendations widget toolbar pagination pager skip alert".split()
)
_LIKELY = frozenset("article content main post entry story body text page".split())
#: Readers' words: never the article, whatever else the element is called.
_READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: With one of these a name tells of something nearby (no-comments, with-sidebar), not of the element itself.
_NEARBY = frozenset("no not has with without open closed on off hide enabled disabled count".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var".split())
_START = {"article": 25, "main": 20, "section": 3, "div": 5, "td": 3, "blockquote": 3, "pre": 3, "ul": -3, "ol": -3, "li": -3, "dl": -3, "address": -3, "th": -5, "table": -3}
_PARAGRAPHS = frozenset(("p", "pre", "td", "blockquote", "dd"))
#: An open element of the first kind ends when one of the others begins.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}}
_HOLDS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}


#: Stands where a block was cut off.
_BREAK = "\n\x0b\n"


class Node:
    __slots__ = ("tag", "likely", "doubt", "reader", "parent", "children", "size", "linked", "points")

    def __init__(self, tag: str, parent: Node | None, likely: bool = False, doubt: bool = False, reader: bool = False):
        self.tag, self.parent, self.children = tag, parent, []
        self.likely, self.doubt, self.reader = likely, doubt, reader
        self.size = self.linked = 0
        self.points: float | None = None


def _names(value: str, whole: bool) -> list[frozenset]:
    """The parts of each name of a class (or of an id, which is one name)."""
    return [frozenset(re.split(r"[^a-z0-9]+", name)) for name in ([value] if whole else value.split())]


def _judged(tag: str, attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether an element is left out; whether its names are the article's, doubtful, and readers'."""
    gone = tag in _DROPPED
    if not attributes or attributes.isspace():
        return gone, False, False, False
    names: list[frozenset] = []
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            names += _names(value, key == "id")
        elif key == "role":
            gone |= value in _ROLES
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            gone = True
    names = [n for n in names if not n & _NEARBY]
    likely = any(n & _LIKELY and not n & _UNLIKELY for n in names)
    reader = any(n & _READERS for n in names)
    doubt = reader or any(n & _UNLIKELY for n in names)
    if tag in _NEVER_DROPPED:
        return False, likely, doubt and tag == "article" and any(n & (_READERS | {"related", "ad", "promo"}) for n in names), reader
    return gone, likely, doubt, reader


def parse(page: str) -> Node:
    """The element tree without unwanted elements; tags that are missing or left open are made up for."""
    root = node = Node("html", None)
    skipped: list[str] = []  # open elements from the outermost unwanted one on
    at, last = 0, page.rfind(">")
    while at <= last:
        m = _TOKEN.search(page, at)
        if not m:
            break
        if m.start() > at and not skipped:
            node.children.append(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA[") and not skipped:
            node.children.append(html.escape(m[0][9:].removesuffix("]]>")))
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if skipped:
            if closing:
                if tag in skipped:
                    while skipped.pop() != tag:
                        pass
                elif tag in ("body", "html", "article", "main"):  # the unwanted element was never closed
                    skipped = []
            elif tag in _RAW:
                at = _raw_end(page, at, tag)
            elif tag not in _VOID and not attributes.endswith("/"):
                if tag in _ENDS and skipped[-1] == tag or tag in _CLOSES_P and skipped[-1] == "p" and len(skipped) > 1:
                    skipped.pop()
                skipped.append(tag)
            if skipped:
                continue
        if closing:
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            elif tag == "p":
                node.children.append(Node("p", node))
            continue
        if tag in _RAW:
            at = _raw_end(page, at, tag)
            continue
        if tag == "br":
            node.children.append(" ")
            continue
        gone, *names = _judged(tag, attributes)
        if tag in _CLOSES_P or gone and tag in ("nav", "aside", "form", "menu"):
            up = node
            while up is not None and up.tag != "p" and up.tag not in ("td", "th", "div", "article", "section", "li", "button", "body"):
                up = up.parent
            if up is not None and up.tag == "p":
                node = up.parent
        if tag in _HOLDS:
            up = node
            while up is not None and up.tag not in _HOLDS[tag]:
                if up.tag in _ENDS and tag in _ENDS[up.tag]:
                    node = up.parent
                up = up.parent
        if tag in _VOID:
            continue
        if tag in ("html", "body") and node is root and not root.children:
            continue
        if gone:
            if not attributes.endswith("/"):
                skipped = [tag]
            continue
        child = Node(tag, node, *names)
        node.children.append(child)
        if not attributes.endswith("/"):
            node = child
    if at < len(page) and not skipped:
        node.children.append(page[at:])
    return root


def _raw_end(page: str, at: int, tag: str) -> int:
    m = re.compile(rf"</{tag}\b[^>]*+>?", re.I).search(page, at)
    return m.end() if m else len(page)


def _measure(root: Node) -> list[Node]:
    """Elements in page order, with the sizes of their texts and of those inside links."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.children) if c.__class__ is Node]
    for node in order:
        node.size, node.linked, node.points = 0, 0, None
    for node in reversed(order):
        for c in node.children:
            if c.__class__ is Node:
                node.size, node.linked = node.size + c.size, node.linked + c.linked
            else:
                node.size += len(c.strip())
        if node.tag == "a":
            node.linked = node.size
    return order


def _density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _commas(node: Node) -> int:
    total, stack = 0, [node]
    while stack:
        for c in stack.pop().children:
            if c.__class__ is Node:
                stack.append(c)
            else:
                total += c.count(",") + c.count("，") + c.count("、")
    return total


def _prose(node: Node) -> bool:
    if node.tag in _PARAGRAPHS:
        return True
    return node.tag in ("div", "section", "article") and not any(c.__class__ is Node and c.tag in _BLOCK for c in node.children)


def article(root: Node) -> list[Node]:
    """The elements that make the article, in page order; none for a page without text."""
    order = _measure(root)
    cut, where = _cut_off(order)
    if not cut:
        return _best(root, order)
    order = _measure(root)
    kept = _best(root, order)
    lost = max((n for n in cut if not n.reader), key=lambda n: n.size - n.linked, default=None)
    prose = lost.size - lost.linked if lost is not None else 0
    named = max((n.size - n.linked for n in order if n.likely or n.tag in ("article", "main")), default=0)
    if prose >= max(140, 4 * sum(n.size for n in kept)) and named < max(140, prose / 8):
        lost.parent.children[where[id(lost)]], lost.doubt = lost, False
        return _best(root, _measure(root))
    return kept


def _cut_off(order: list[Node]) -> tuple[list[Node], dict[int, int]]:
    """Puts a blank in the place of doubtful elements; they, the outermost only, and their places among their siblings.

    Those with a name of the article stay, unless they are readers'; so do those inside a sentence: inline elements
    whose block has at least as much text beside them.
    """
    cut, inside = [], set()
    for node in order:
        if id(node.parent) in inside:
            inside.add(id(node))
            continue
        if not node.doubt or node.parent is None or node.likely and not node.reader:
            continue
        if node.tag in _INLINE:
            beside = sum(len(c.strip()) if c.__class__ is not Node else c.size * (c.tag in _INLINE and not c.doubt) for c in node.parent.children)
            if beside >= node.size:
                continue
        inside.add(id(node))
        cut.append(node)
    where = {}
    for parent in {id(n.parent): n.parent for n in cut}.values():
        for i, c in enumerate(parent.children):
            if id(c) in inside:
                where[id(c)], parent.children[i] = i, " " if c.tag in _INLINE else _BREAK
    return cut, where


def _best(root: Node, order: list[Node]) -> list[Node]:
    if not root.size:
        return []
    for node in order:
        if node.size < 25 or not _prose(node) or node.parent is None:
            continue
        points, up, level = 1 + _commas(node) + min(node.size / 100, 3), node.parent, 0
        while up is not None and level < 4:
            if up.points is None:
                up.points = _START.get(up.tag, 0) + 25 * up.likely - 25 * up.doubt
            up.points += points / (1, 2, 6, 9)[level]
            up, level = up.parent, level + 1
    scored = [(n.points * (1 - _density(n)), n) for n in order if n.points is not None]
    if not scored:  # nothing long enough: the page's own mark of its article, or all of it
        named = [n for n in order if n.tag in ("article", "main") and n.size]
        return [max(named, key=lambda n: n.size) if named else root]
    value = {id(n): s for s, n in scored}
    top, best = max(scored, key=lambda x: x[0])
    if best.parent is None:
        return [best]
    kept = []
    for c in best.parent.children:
        if c.__class__ is not Node or not c.size:
            continue
        near = value.get(id(c), -1) >= max(10, 0.2 * top) and c.tag not in ("ul", "ol")
        alone = c.tag in ("p", "blockquote", "pre") and _density(c) < 0.25 and c.size > 80
        if c is best or near or alone or c.tag == "h1" and best.tag != "article" and _density(c) < 0.5:
            kept.append(c)
    return kept


def _lists_links(node: Node) -> bool:
    return node.tag in ("ul", "ol", "dl", "table", "div", "section") and node.size > 0 and _density(node) > 0.5


def blocks(roots: list[Node]) -> list[str]:
    """Texts of blocks in page order, white space made single; lists of links are left out."""
    out, run = [], []

    def end() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    for root in roots:
        stack: list = [root]
        while stack:
            item = stack.pop()
            if item is None or item is _BREAK:
                end()
            elif item.__class__ is not Node:
                run.append(item)
            elif item is root or not _lists_links(item):
                block = item.tag in _BLOCK
                if block:
                    end()
                    stack.append(None)
                stack += reversed(item.children)
        end()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(article(parse(page)))) if page else ""


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [main_text(p) for p in part.column(2).to_pylist()]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row; ids and urls are passed on as they are, nulls too.

    A null or empty page has an empty text; repeated rows give repeated rows; nothing is cut from long pages; other
    columns aren't used.
    """
    picked = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return picked.mapInArrow(_extracted, f"page_id {picked.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
