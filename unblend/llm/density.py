"""Main text of web pages by composite text density.

For every DOM node: characters per tag, adjusted for the share of its characters and tags that
are links. Text that can't belong to an article, by the element, role or name around it,
counts as links do: it is what a page leads with and not what it says. The node whose
children's densities have the largest sum is the core of the main text. The smallest density
on the way from it up to the body is the threshold: going up, a node joins unless most of the text
that it adds is sparser than that (headings aside) and is much beside what is there. A box that isn't an element for text is left out where it is light beside
the sum of the core's densities, or comes before a core that begins with its heading: adverts and lead-ins, by density and
place and not by name. The highest node that joins is the article, and what counts as links by its element or name is left out of it.

Pages are read in one pass forward, so broken ones cost no more than others.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator, Set

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by role, and words by which pages name what surrounds a text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe svg math xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - set("body html caption dd dt td th tr tbody thead tfoot option optgroup legend".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements whose end tags may be left out, by kind; a new one ends the nearest of its kind, inside what starts a new scope.
KIND = {"li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option", "tbody": "tbody", "thead": "tbody", "tfoot": "tbody"}
SCOPE = {
    "ul": ("li",), "ol": ("li",), "menu": ("li",), "dir": ("li",), "dl": ("dt",), "select": ("option",), "table": ("tbody", "tr", "td"),
    "tbody": ("tr", "td"), "thead": ("tr", "td"), "tfoot": ("tr", "td"), "tr": ("td",),
}
OF_TABLES = set("table thead tbody tfoot tr td th".split())
AROUND = set("nav header footer aside form button select dialog menu search fieldset input head object embed audio video canvas".split())
STRICT = set("nav footer aside button select dialog search".split())
AROUND_ROLES = set("navigation banner contentinfo search complementary dialog alert alertdialog menu menubar toolbar form".split())
AROUND_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promos "
    "promotion banner banners sidebar sidebars sidenav aside menu menus nav navbar navi navigation navlinks breadcrumb "
    "breadcrumbs footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices popup popups "
    "overlay modal comment comments commentlist disqus discussion respond responses replies reply share shares sharing "
    "social related recommended recommendations newsletter subscribe subscription signup signin login widget widgets "
    "pagination pager paging copyright legal disclaimer skip tagcloud taboola outbrain".split()
)
#: Elements that are made for text, whatever their size.
OF_TEXTS = HEADINGS | set("p pre blockquote ul ol dl table figure article section main".split())
OWN_NAMES = set("article post entry story content main body text".split())

#: A box beside the core, not an element for text, is none of its text if neither its density nor its children's sum is this much of the
#: sum of the core's, or if it comes before a core that begins with its heading.
LIGHT = 0.25

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
# Attributes as HTML reads them: a quote opens a value only right after "=", anywhere else it is a character like others.
# Each piece stands at one place, so matching never goes back.
PIECE = re.compile(r"[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:(?P<quote>[\"'])|[^\s\"'>][^\s>]*+)?+)?+")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "parent", "items", "around", "para", "near", "chars", "tags", "link_chars", "link_tags", "density", "total", "titled")

    def __init__(self, tag: str, parent: Node | None, around: bool = False):
        self.tag, self.parent, self.around = tag, parent, around
        self.items: list[Node | str] = []
        #: the paragraph that a block ends here, and the nearest open element of each kind in scope
        self.para = self if tag == "p" else None if tag in BLOCK or parent is None else parent.para
        near = {} if parent is None else parent.near
        if tag in SCOPE:
            near = {k: v for k, v in near.items() if k not in SCOPE[tag]}
        self.near = near | {KIND[tag]: self} if tag in KIND else near
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        #: whether it begins with a heading
        self.titled = tag in HEADINGS


def _around(tag: str, raw: str, names: Set[str]) -> bool:
    """An element that its name, role or class (by ``names``) says isn't part of a text."""
    if tag in AROUND:
        return True
    if not raw or tag in ("html", "body", "main"):
        return False
    for name, value in ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in AROUND_ROLES:
            return True
        if name in ("class", "id"):
            for part in value.split():
                parts = [x.lower() for x in NAME_PARTS.findall(part)]
                if parts and parts[0] not in ("has", "no", "with", "is", "without"):
                    if not names.isdisjoint(parts) and not (
                        OWN_NAMES.intersection(parts) and {"header", "body"}.intersection(parts)
                    ):
                        return True
    return False


class _Tags:
    """Reads tags forward. What an unclosed quote or tag would make it search for again and again is remembered."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.quotes = {q: html.rfind(q) for q in "\"'"}
        self.unclosed: set[str] = set()

    def end_of(self, at: int) -> int:
        """Where the attributes that start at ``at`` end, the place of ">"."""
        i = at
        while i < len(self.html) and self.html[i] != ">":
            m = PIECE.match(self.html, i)
            i = m.end()
            if m["quote"]:
                close = self.html.find(m["quote"], i) if i <= self.quotes[m["quote"]] else -1
                i = close + 1 if close >= 0 else i
        if i < len(self.html):
            return i
        # the page ends inside this tag, so its quotes don't pair up: from here on none opens a value
        self.quotes = {q: -1 for q in self.quotes}
        return self.html.find(">", at)

    def after(self, tag: str, at: int) -> int:
        """The end of the element ``tag``, whose content isn't markup; -1 if it is never closed."""
        if tag in self.unclosed:
            return -1
        m = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(self.html, at)
        if m is None:
            self.unclosed.add(tag)
        return -1 if m is None else m.end()


def parse(html: str, names: Set[str] = AROUND_NAMES) -> Node:
    """The DOM, forgiving: unclosed and stray tags are put right as browsers mostly do. Character
    references are decoded in each text by itself."""
    root = node = Node("html", None)
    tags, at, size = _Tags(html), 0, len(html)
    #: open elements by name, anew inside each table cell
    scopes: list[dict[str, int]] = [{}]

    def leave(to: Node) -> Node:
        """Close what is open below ``to``."""
        nonlocal node
        while node is not to:
            scopes[-1][node.tag] -= 1
            if node.tag in ("td", "th"):
                scopes.pop()
                scopes[-1][node.tag] -= 1
            node = node.parent
        return to

    while at < size:
        start = html.find("<", at)
        if start < 0 or start > tags.last:
            node.items.append(html_lib.unescape(html[at:]))
            break
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            end = size if end < 0 else end + 3
            name = None
        elif html[start + 1 : start + 2] in ("!", "?"):
            end, name = html.find(">", start) + 1, None
        else:
            closes = html.startswith("/", start + 1)
            name = NAME.match(html, start + 1 + closes)
            if name is None:
                node.items.append(html_lib.unescape(html[at : start + 1]))
                at = start + 1
                continue
            end = tags.end_of(name.end()) + 1
        if start > at:
            node.items.append(html_lib.unescape(html[at:start]))
        at = end
        if name is None:
            continue
        tag = name[0].lower()
        if closes:
            where = next((k for k in range(len(scopes) - 1, -1, -1) if scopes[k].get(tag)), -1) if tag in OF_TABLES else len(scopes) - 1
            if where >= 0 and scopes[where].get(tag):
                up = node
                while up.tag != tag:
                    up = up.parent
                leave(up.parent)
            continue
        if tag == "html":
            continue
        raw = html[name.end() : end - 1]
        if tag in RAW and not raw.endswith("/"):
            after = tags.after(tag, at)
            at = after if after >= 0 else size if tag in ("script", "style") else at
            continue
        if tag in ENDS_P and node.para is not None:
            leave(node.para.parent)
        if tag in KIND and KIND[tag] in node.near:
            leave(node.near[KIND[tag]].parent)
        new = Node(tag, node, _around(tag, raw, names))
        node.items.append(new)
        if tag not in VOID and not raw.endswith("/"):
            node = new
            scopes[-1][tag] = scopes[-1].get(tag, 0) + 1
            if tag in ("td", "th"):
                scopes.append({tag: 1})
    return root


def _in_order(root: Node) -> list[Node]:
    """All nodes in the order of the page, parents first."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [x for x in reversed(n.items) if not isinstance(x, str)]
    return out


def score(order: list[Node]) -> None:
    """Sets every node's density and the sum of its children's densities.

    A name or a form may also surround a whole page: what holds the page's article, its first heading
    or four fifths of its text isn't around it.
    """
    for n in reversed(order):
        n.chars = sum(len(" ".join(x.split())) if isinstance(x, str) else x.chars for x in n.items)
    whole, holds = order[0].chars, set()
    head = next((n for n in order if n.tag == "h1"), None)
    for n in reversed(order):
        if n.parent is not None and (id(n) in holds or n is head or n.tag in ("article", "main") and not n.around):
            holds.add(id(n.parent))
    for n in reversed(order):
        if n.around and (5 * n.chars >= 4 * whole or id(n) in holds and n.tag not in STRICT):
            n.around = False
        for x in n.items:
            if not isinstance(x, str):
                n.tags += x.tags + 1
                n.link_chars += x.link_chars
                n.link_tags += x.link_tags
        if n.tag == "a" or n.around:
            n.link_chars, n.link_tags = n.chars, n.tags + 1
    body_chars, body_links = max(1, order[0].chars), order[0].link_chars
    for n in order:
        if not n.chars:
            continue
        c, t = n.chars, max(1, n.tags)
        lc, lt, other = max(1, n.link_chars), max(1, n.link_tags), max(1, n.chars - n.link_chars)
        base = math.log(c / other * n.link_chars + body_links / body_chars * c + math.e)
        n.density = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt))) / max(1.0, math.log(base) if base > math.e else 1.0)
    for n in reversed(order):
        first = next((x for x in n.items if (x.strip() if isinstance(x, str) else x.chars and not x.around)), "")
        n.titled = n.tag in HEADINGS or not isinstance(first, str) and first.titled
    for n in order:
        n.total = sum(x.density for x in n.items if not isinstance(x, str))


def _blocks(n: Node, out: list[list[str]], without: set[int]) -> None:
    stack: list[tuple[Node | str | None, bool]] = [(n, False)]
    while stack:
        x, after = stack.pop()
        if isinstance(x, str):
            out[-1].append(x)
        elif after:
            out.append([])
        elif x.around or id(x) in without:
            out[-1].append(" ") if x.tag not in BLOCK else out.append([])
        elif x.tag == "br":
            out[-1].append(" ")
        else:
            block = x.tag in BLOCK
            if block:
                out.append([])
                stack.append((x, True))
            stack += [(y, False) for y in reversed(x.items)]


def _before(n: Node, core: Node) -> list[Node]:
    """Boxes of ``n`` that come before a core that begins with its heading, and aren't elements for text."""
    if not core.titled:
        return []
    children = [x for x in n.items if not isinstance(x, str)]
    return [x for x in children[: children.index(core)] if x.chars and x.tag not in OF_TEXTS]


def article(order: list[Node]) -> tuple[Node | None, set[int]]:
    """The subtree with the main text, and nodes in it that aren't part of it. Nodes are scored."""
    best = max(order, key=lambda n: n.total)
    if best.total <= 0:
        best = max(order, key=lambda n: n.density)
        if best.density <= 0:
            return None, set()
    way = [best]
    while way[-1].parent is not None and way[-1].tag != "body":
        way.append(way[-1].parent)
    threshold = min(n.density for n in way)
    # a short article may be the densest of its parent's children without being the core
    inner = [x for x in best.items if not isinstance(x, str) and x.chars and not x.around and x.titled]
    out = {id(x) for x in _before(best, inner[0])} if inner else set()
    top, seen = best, set(out)
    for below, n in zip(way, way[1:]):
        beside = [x for x in n.items if not isinstance(x, str) and x is not below and x.chars and not x.around]
        light = {id(x) for x in _before(n, below)} | {id(x) for x in beside if x.tag not in OF_TEXTS and max(x.density, x.total) < LIGHT * best.total}
        seen |= light
        beside = [x for x in beside if id(x) not in light]
        dense = [x for x in beside if x.density >= threshold and 2 * x.link_chars < x.chars or x.tag in HEADINGS]
        gained = sum(x.chars for x in dense) + sum(len(" ".join(x.split())) for x in n.items if isinstance(x, str))
        seen |= {id(x) for x in beside if 2 * x.link_chars >= x.chars and x.tag not in HEADINGS}
        known = seen | {id(x) for x in dense}
        sparse = sum(x.chars for x in beside if id(x) not in known)
        if sparse > gained and 2 * sparse > below.chars:
            break
        if gained or sparse:
            top, out = n, set(seen)
    return top, out


def main_text(html: str | None, names: Set[str] = AROUND_NAMES) -> str:
    """The page's main text, a block a line; "" for pages without one. ``names``: words of class and id that mark what is around a text."""
    if not html:
        return ""
    order = _in_order(parse(html, names))
    score(order)
    top, out = article(order)
    if top is None:
        return ""
    parts: list[list[str]] = [[]]
    _blocks(top, parts, out)
    lines = (" ".join("".join(p).split()) for p in parts)
    return "\n".join(x for x in lines if x)


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", names: Set[str] = AROUND_NAMES) -> DataFrame:
    """Adds ``text_col`` with each page's main text; a column of that name is replaced.

    Null, empty and textless pages give "". Menus, headers, footers, sidebars,
    notices, adverts, forms, scripts, styles and comments go; white space inside a
    block becomes one space, character references are decoded. Pages are read whole and
    independently, in time that grows with their length: repeated rows give repeated results,
    ties go to the first node of the page. An empty table gives no rows; all other columns stay. ``names`` are the words by which a class or id
    marks what surrounds a text; with none of them, elements, roles and density decide alone.
    """

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(lambda html: main_text(html, names), na_action=None).astype(object)

    return pages.withColumn(text_col, extract(F.col(html_col)))
