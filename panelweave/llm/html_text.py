"""Main text of web pages by composite text density.

A page becomes a tree of elements. Those that hold no article text by their kind (menus, forms) or by what they are
called (class, id and role names for adverts, notices, comments) are suspects. A name counts as a whole: every part of it must be such a
word or one of layout, so ``cookie-notice`` is one and ``has-sidebar`` is none. A suspect is cut away unless it holds the page's
largest article or main element, or most of the text of the body that is in no link; then only what is inside it is
judged, and of a form only the controls go. For every element left, counted over its subtree: characters C, link
characters LC, tags T and link tags LT. Its composite text density is

    CTD = C / T * log(C * T / (LC * LT), base = ln(C / (C - LC) * LC + LC_body / C_body * C + e))

with empty counts taken as 1. The density sum of an element is the sum over its children. The element with
the largest sum is content; the smallest density on its path from the body is the threshold, and every
other subtree that reaches it yields its own largest element. The blocks of content elements are joined in
page order.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import by_batch

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select xmp noembed noframes".split())
CLOSERS = {name: re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I | re.A) for name in RAW}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot munder mover munderover semantics".split()
)
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: Element -> elements whose open one it ends, and elements that hold the search back.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "option": ({"option"}, {"select"}),
}
CUT_KINDS = frozenset("nav footer aside form dialog menu".split())
CONTROLS = frozenset("head button annotation annotation-xml".split())
FORM_CONTROLS = frozenset("label legend".split())
COMMENT_WORDS = frozenset("comment comments disqus respond reply replies".split())
CUT_WORDS = COMMENT_WORDS | frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar footer cookie cookies consent notice notices popup modal newsletter subscribe share sharing social "
    "related recommended pagination pager masthead toolbar widget skip complementary contentinfo alert signup login search".split()
)
#: Words of layout that leave a name what it is.
PLACE_WORDS = frozenset(
    "site page main global primary secondary sub left right top bottom inner outer mobile desktop first last block box bar area section wrap "
    "wrapper container group list item items slot unit module panel row col column header title buttons button link links icons form "
    "post posts article articles entry story stories content reader user the and".split()
)
MOST = 0.8
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ROLE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
STYLE = re.compile(r"(?:^|\s)style\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"?|'[^']*'?|[^\s\"'>]+)")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
FREE, SUSPECT, COMMENTS, GONE = range(4)


class _Node:
    __slots__ = ("name", "parent", "children", "suspect", "cut", "inline", "own", "chars", "link_chars", "tags", "link_tags", "density", "sum", "best", "outer")

    def __init__(self, name: str, parent: _Node | None, suspect: int = FREE):
        self.name, self.parent, self.children, self.suspect, self.cut = name, parent, [], suspect, False
        self.inline = name in INLINE
        self.own = self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.sum = 0.0
        self.best = self
        self.outer = parent.outer if parent is not None else None
        if self.outer is None and name in ("article", "main"):
            self.outer = self


def _named(name: str) -> int:
    """What a class, id or role name says: every part must be a word of the lists, one of them of those that are cut."""
    parts = {p.lower() for p in NAME_PART.findall(name) if len(p) > 1}
    if parts.isdisjoint(CUT_WORDS) or not parts <= CUT_WORDS | PLACE_WORDS:
        return FREE
    return SUSPECT if parts.isdisjoint(COMMENT_WORDS) else COMMENTS


def _suspicion(name: str, attributes: str, inside_article: bool, inside_form: bool) -> int:
    """Whether an element seems to hold no article text."""
    if name in CONTROLS or name in FORM_CONTROLS and inside_form:
        return GONE
    found = SUSPECT if name in CUT_KINDS or name == "header" and not inside_article else FREE
    if not attributes or name in ("html", "body", "main"):
        return found
    if HIDDEN.search(QUOTED.sub("=", attributes)) or any(UNSEEN.search(m[1] or m[2] or m[3] or "") for m in STYLE.finditer(attributes)):
        return max(found, SUSPECT)
    for m in ROLE.finditer(attributes):
        if m[1].lower() == "id" and name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            continue  # a place to link to
        found = max([found, *map(_named, (m[2] or m[3] or m[4] or "").split())])
    return found


def _judge(nodes: list[_Node]) -> None:
    """Decide which elements are cut, parents before children."""
    plain: dict[int, int] = {}
    linked: set[int] = set()
    inside: set[int] = set()
    for node in nodes:
        if node.name == "a" or id(node.parent) in linked:
            linked.add(id(node))
        if node.suspect or id(node.parent) in inside:
            inside.add(id(node))
    for node in reversed(nodes):
        if node.suspect != GONE:
            node.own = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        plain[id(node)] = plain.get(id(node), 0) + (0 if id(node) in linked else node.own)
        if node.parent is not None and node.suspect != GONE:
            plain[id(node.parent)] = plain.get(id(node.parent), 0) + plain[id(node)]
    articles = [n for n in nodes if n.name in ("article", "main")]
    free = [n for n in articles if id(n) not in inside] or articles
    up = max(free, key=lambda n: plain[id(n)], default=None)
    holds = set()
    while up is not None:
        holds.add(id(up))
        up = up.parent
    body = next((n for n in nodes if n.name == "body"), None)
    most = MOST * plain[id(body if body is not None else nodes[0])]
    for node in nodes[1:]:
        kept = id(node) in holds or node.suspect != COMMENTS and plain[id(node)] >= max(most, 1)
        node.cut = node.parent.cut or node.suspect == GONE or node.suspect != FREE and not kept


def parse(page: str) -> tuple[_Node, list[_Node]]:
    """The element tree (text as plain strings among the children) and its elements in page order."""
    root = _Node("#root", None)
    nodes, open_now, at = [root], root, 0
    opened: Counter[str] = Counter()

    def ended(names: Iterable[str], held: Iterable[str] = ()) -> _Node:
        """Close the innermost open element of these names, if it comes before one that holds the search."""
        node = open_now
        if not any(opened[n] for n in names):
            return node
        while node is not root and node.name not in held:
            if node.name in names:
                inner = open_now
                while inner is not node:
                    opened[inner.name] -= 1
                    inner = inner.parent
                opened[node.name] -= 1
                return node.parent
            node = node.parent
        return open_now

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        start = m.start() if m else end
        if start > at:
            open_now.children.append(entities.unescape(page[at:start]))
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            if page.startswith("<![CDATA[", start):
                open_now.children.append(page[start + 9 : at - 3 if page.endswith("]]>", start, at) else at])
            continue
        name = name.lower()
        if m[1]:
            if name in VOID:
                open_now.children.append(" ")
                continue
            open_now = ended({name}, {"table"} if name in ("p", "li", "div") else ())
            continue
        if name in RAW:
            if name == "svg" and m[3].endswith("/"):
                continue
            close = CLOSERS[name].search(page, at)
            if name == "xmp":  # preformatted text, without markup or character references
                open_now.children.append(f" {page[at : close.start() if close else end]} ")
            at = close.end() if close else end
            continue
        if name in ENDS_P:
            open_now = ended({"p"}, {"table", "td", "th", "button", "body"})
        elif name in SIBLINGS:
            open_now = ended(*SIBLINGS[name])
        if name in ("html", "body") and any(n.name == name for n in nodes[:8]):
            continue
        node = _Node(name, open_now, _suspicion(name, m[3], opened["article"] > 0, opened["form"] > 0))
        open_now.children.append(node)
        nodes.append(node)
        if name not in VOID and not m[3].endswith("/"):
            opened[name] += 1
            open_now = node
        elif name not in INLINE or name == "br":
            node.children.append(" ")
    return root, nodes


def _measure(nodes: list[_Node]) -> None:
    """Counts, densities and density sums, children before parents; no recursion, so depth is no limit."""
    for node in reversed(nodes):
        if node.cut:
            continue
        node.chars += node.own
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags
    body = next((n for n in nodes if n.name == "body"), nodes[0])
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        if node.chars and not node.cut:
            plain = max(1, node.chars - node.link_chars)
            links, tags, link_tags = max(1, node.link_chars), max(1, node.tags), max(1, node.link_tags)
            base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
            node.density = node.chars / tags * max(0.0, math.log(node.chars * tags / (links * link_tags)) / base)
    for node in reversed(nodes):
        if node.cut:
            continue
        if not any(isinstance(c, _Node) and c.chars and not c.cut for c in node.children):
            node.sum = node.density
        if node.parent is not None:
            node.parent.sum += node.density
    for node in reversed(nodes):
        if node.parent is not None and not node.cut and node.best.sum > node.parent.best.sum:
            node.parent.best = node.best


def content(nodes: list[_Node]) -> set[int]:
    """Positions in ``nodes`` of the content elements."""
    body = next((n for n in nodes if n.name == "body"), nodes[0])
    path, up = [], body.best
    while up is not None:
        path.append(up)
        up = None if up is body else up.parent
    threshold = min((n.density for n in path), default=0.0)
    chosen, wait = set(), [body]
    while wait:
        node = wait.pop()
        if node.chars and not node.cut and node.density >= threshold:
            chosen.add(id(node.best.outer or node.best))  # an article or main element stays whole
            wait += [c for c in node.children if isinstance(c, _Node)]
    return chosen


def main_text(page: str) -> str:
    """The main text of one page: blocks of the content elements, joined by one space."""
    root, nodes = parse(page)
    _judge(nodes)
    _measure(nodes)
    chosen = content(nodes)
    pieces: list[str] = []
    wait: list[tuple[object, bool]] = [(root, False)]
    while wait:
        item, inside = wait.pop()
        if isinstance(item, str):
            if inside:
                pieces.append(item)
            continue
        if item.cut:
            continue
        inside = inside or id(item) in chosen
        if not item.inline or item.name == "br":
            pieces.append(" ")
            wait.append((" ", inside))
        wait += [(c, inside) for c in reversed(item.children)]
    return " ".join("".join(pieces).split())


def _extract(rows: dict[str, list]) -> dict[str, list]:
    found = [main_text(page) for page in rows["html"]]
    return {"page_id": rows["page_id"], "url": rows["url"], "text": found, "n_chars": [len(t) for t in found]}


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    White space (also the no-break space) folds to one space inside a block, blocks are joined by one space.
    Null and empty pages have an empty text; repeated rows repeat; an empty table gives no rows; other columns
    are ignored. Broken markup is closed at the end of the page. Of equal density sums the outer or earlier element counts, and of
    equally large articles the first. A page of any length or depth is read whole, without recursion, and held as its tree.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    return by_batch(rows, _extract, "page_id long, url string, text string, n_chars long", step=64)
