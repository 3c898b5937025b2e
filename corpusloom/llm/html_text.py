"""Main text of web pages by composite text density.

A tolerant reader builds the tree of elements, in a time that grows with the page's length
alone. Subtrees that their tag, role or class names as navigation, header, footer, sidebar,
notice, advert, form or comments don't count. A class or id names so only if all its words do
(with words of place, such as site or main), and only an element that doesn't hold an article
(or, in a page without one, most of the text). What is named as comments never counts, articles
too, and a notice only if it holds an article; headings and paragraphs are judged by words for adverts alone. For each
node, characters per tag, adjusted for links, is its density; a node's density sum is that
over its children. The node with the greatest sum holds the article; where a sibling on its
way to the body is as dense as the sparsest node on that way (the threshold), or is a heading
before it, or the node lies in an article element, the wider node is taken. All its text is
given, lists of links too: a line for each block, white space within a block as one space. Of
nodes with the same sum the first of the page, and of those the outermost, is taken.

A null or empty page gives an empty text. The whole of each page is read, however long.
Repeated pages are repeated in the result. Other columns aren't read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp svg".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Opening one of these ends an open paragraph.
ENDS_P = BLOCK - frozenset("html head body caption dt dd li tbody td tfoot th thead tr legend summary figcaption title".split())
#: Opening the first ends an open one of the second, up to one of the third.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
HEADINGS = ("h1", "h2", "h3")
#: Elements that are no part of a main text, wherever they stand.
NOISE_TAGS = frozenset("nav footer aside form button select input label option fieldset dialog menu search head object embed canvas audio video map".split()) | RAW
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split())
#: Words of a class or an id that say the same.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead topbar footer foot copyright sidebar aside rail widget widgets comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login form search share sharing social related recommended recommendations toolbar toc skip".split()
)
#: Of those: what they name is comments, whatever it holds, and what is text only if it holds an article.
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
NOTICE_WORDS = frozenset("cookie cookies consent gdpr newsletter notice notices".split())
#: Words that say nothing by themselves, beside those above.
PLACE_WORDS = frozenset("site main page global primary secondary top bottom left right upper lower outer inner wrap wrapper container box block bar list item items panel area section slot unit group links link content body text region col column row js mobile desktop sticky fixed".split())
#: Those that count for headings and paragraphs too.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsored promo promoted".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre li dt dd td th figure figcaption".split())
OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
#: The rest of a tag, with quoted values; nothing is tried twice.
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))|([^\s"'>/=]++)""")
#: Elements whose opening or end looks for an open element up to others: a bit for each kind.
SCOPES = {"p": (1, "article section div td th li blockquote button table body".split())} | {tag: (2 << i, ENDS[tag][1]) for i, tag in enumerate(ENDS)}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("chars", "children", "density", "inlines", "link_chars", "link_tags", "noise", "parent", "scope", "tag", "tags", "total")

    def __init__(self, tag: str, parent: Node | None, noise: str):
        self.tag, self.parent, self.noise, self.children = tag, parent, noise, []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        # open elements of each kind between here and what bounds the kind
        scope = parent.scope if parent else 0
        for name, (bit, until) in SCOPES.items():
            if tag in until:
                scope &= ~bit
            if tag == name:
                scope |= bit
        self.scope = scope
        # how often each inline tag is open within this block
        self.inlines: dict[str, int] | None = {} if tag in BLOCK else None


def _named(value: str, words: frozenset) -> set[str]:
    """The words of those names in the value that are made of such words and words of place alone."""
    found: set[str] = set()
    for name in html.unescape(value).split():
        own = [x.lower() for x in WORD.findall(name)]
        if not words.isdisjoint(own) and all(x in words or x in PLACE_WORDS or x.isdigit() for x in own):
            found.update(own)
    return found


def _noise(tag: str, attributes: str, parent: Node) -> str:
    """Why the element doesn't count: by its tag, its role or as comments ("tag"), as a notice, by
    another name only, or not at all (empty)."""
    if tag in NOISE_TAGS:
        return "tag"
    if tag == "header":
        while parent is not None:
            if parent.tag in ("article", "main"):
                return ""
            parent = parent.parent
        return "tag"
    if not attributes or tag in ("html", "body", "main"):
        return ""
    words, found = ADVERTS if tag in TEXT_TAGS else NOISE_WORDS, ""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            own = _named(value, words)
            if own & COMMENT_WORDS:
                return "tag"
            if own and tag != "article":
                found = "notice" if found == "notice" or own & NOTICE_WORDS else "name"
        elif tag == "article":
            continue
        elif name == "role" and value.strip().lower() in NOISE_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "tag"
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "tag"
    return found


def _settle(body: Node) -> None:
    """Elements that a name alone speaks against count if they hold an article, or, in a page that
    has none, over half of the text that isn't noise by tag (notices never by that); all within
    noise is noise."""
    order, stack = [], [body]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.children if isinstance(x, Node) and x.noise != "tag"]
    chars: dict[int, int] = {}
    articles: dict[int, bool] = {}
    for node in reversed(order):
        inner = [x for x in node.children if isinstance(x, Node) and x.noise != "tag"]
        chars[id(node)] = sum(len(x.strip()) for x in node.children if isinstance(x, str)) + sum(chars[id(x)] for x in inner)
        articles[id(node)] = node.tag in ("article", "main") or any(articles[id(x)] for x in inner)
    for node in order:
        held = articles[id(node)] if articles[id(body)] or node.noise == "notice" else 2 * chars[id(node)] > chars[id(body)]
        if node.noise in ("name", "notice") and held:
            node.noise = ""
    stack = [(body, False)]
    while stack:
        node, within = stack.pop()
        if within:
            node.noise = node.noise or "tag"
        stack += [(x, bool(node.noise)) for x in node.children if isinstance(x, Node)]


def tree(page: str) -> Node:
    """The page's elements and, as strings among their children, its texts."""
    root = Node("html", None, "")
    body = Node("body", root, "")
    root.children.append(body)
    block = body  # the innermost open block
    open_blocks: dict[str, int] = {}
    at, here, end, quotes = 0, body, len(page), True

    def text(a: int, b: int) -> None:
        if b > a:
            here.children.append(html.unescape(page[a:b]))

    def leave(node: Node) -> None:
        """Closes all up to node."""
        nonlocal here, block
        while True:
            if here.inlines is None:
                block.inlines[here.tag] -= 1
            else:
                open_blocks[here.tag] -= 1
            done, here = here is node, here.parent
            if done:
                break
        block = here
        while block.inlines is None:
            block = block.parent

    while at < end:
        m = OPEN.search(page, at)
        if m is None:
            text(at, end)
            break
        text(at, m.start())
        tag = (m[2] or "").lower()
        if not tag:
            close = page.find("-->" if page.startswith("<!--", m.start()) else ">", m.end() - 2 if page.startswith("<!-->", m.start()) else m.end())
            at = end if close < 0 else close + (3 if page.startswith("-->", close) else 1)
            continue
        rest = REST.match(page, m.end()) if quotes else None
        if rest is None:
            # once a quote stays open to the page's end, quotes don't count any more
            quotes = False
            close = page.find(">", m.end())
            if close < 0:
                text(m.start(), end)
                break
            at = close + 1
        else:
            at = rest.end()
        attributes = page[m.end() : at - 1]
        if m[1]:
            # a stray end changes nothing; that of an inline element doesn't end the block around it
            if (open_blocks if tag in BLOCK else block.inlines).get(tag, 0):
                node = here
                while node.tag != tag:
                    node = node.parent
                leave(node)
            continue
        if tag in ("html", "body"):
            continue
        ends = ("p",) if tag in ENDS_P else ENDS.get(tag, ((), ()))[0]
        bits = sum(SCOPES[x][0] for x in ends)
        if here.scope & bits:
            until = SCOPES["p"][1] if tag in ENDS_P else ENDS[tag][1]
            node = here
            while node is not body and node.tag not in until and node.tag not in ends:
                node = node.parent
            if node.tag in ends:
                leave(node)
        node = Node(tag, here, _noise(tag, attributes, here))
        here.children.append(node)
        if tag in RAW and not (tag == "svg" and attributes.rstrip().endswith("/")):
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
        elif tag not in VOID and not (attributes.endswith("/") and tag == "svg"):
            here = node
            if node.inlines is None:
                block.inlines[tag] = block.inlines.get(tag, 0) + 1
            else:
                open_blocks[tag] = open_blocks.get(tag, 0) + 1
                block = node
    _settle(body)
    return body


def _measure(body: Node) -> None:
    """Characters and tags of all nodes, of links too; then densities and their sums."""
    order, stack = [], [(body, False)]
    links = {}
    while stack:
        node, in_link = stack.pop()
        in_link = in_link or node.tag == "a"
        links[id(node)] = in_link
        order.append(node)
        stack += [(x, in_link) for x in node.children if isinstance(x, Node) and not x.noise]
    for node in reversed(order):
        in_link = links[id(node)]
        for x in node.children:
            if isinstance(x, str):
                n = len("".join(x.split()))
                node.chars += n
                node.link_chars += n * in_link
            elif not x.noise:
                node.chars += x.chars
                node.link_chars += x.link_chars
                node.tags += x.tags + 1
                node.link_tags += x.link_tags + (x.tag == "a")
    ratio = body.link_chars / max(1, body.chars)
    for node in order:
        c, lc, t, lt = node.chars, node.link_chars, max(1, node.tags), node.link_tags
        if c:
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            node.density = c / t * max(0.0, math.log(c / max(1, lc) * t / max(1, lt)) / math.log(base)) if base > 1.0001 else c / t * math.log(max(1.0001, c / max(1, lc) * t / max(1, lt)))
    for node in order:
        node.total = sum(x.density for x in node.children if isinstance(x, Node) and not x.noise)
        # text that stands in the node itself is worth what a paragraph would be
        own = sum(len("".join(x.split())) for x in node.children if isinstance(x, str))
        node.total += own


def select(body: Node) -> Node:
    _measure(body)
    best, stack = body, [body]
    while stack:
        node = stack.pop()
        if node.total > best.total:
            best = node
        stack += [x for x in reversed(node.children) if isinstance(x, Node) and not x.noise]
    way, node = [], best
    while node is not None and node.tag != "html":
        way.append(node)
        node = node.parent
    threshold = min(x.density for x in way)
    chosen = best
    for child, parent in zip(way, way[1:], strict=False):
        if parent.tag in ("article", "main") or child.tag not in BLOCK or child.tag in ("p", "li", "td", "tr", "tbody", "ul", "ol", "table", "blockquote", "pre", "dl", *HEADINGS):
            chosen = parent
            continue
        if chosen is not child:
            continue
        others = [x for x in parent.children if isinstance(x, Node) and x is not child and not x.noise and x.chars]
        before = parent.children[: parent.children.index(child)]
        dense = any(x.density >= threshold for x in others if x.tag in BLOCK)
        sections = child.tag == "section" and any(x.tag == "section" and x.link_chars < 0.5 * x.chars for x in others)
        if dense or sections or any(isinstance(x, Node) and x.tag in HEADINGS for x in before):
            chosen = parent
    for node in way[way.index(chosen) :]:
        if node.tag == "article":
            chosen = node
    # one article (or main) that holds most of what was taken is the article
    for tag in ("article", "main"):
        found, stack = [], [chosen]
        while stack:
            node = stack.pop()
            if node.tag == tag:
                found.append(node)
            else:
                stack += [x for x in node.children if isinstance(x, Node) and not x.noise]
        if len(found) == 1 and 2 * found[0].chars >= chosen.chars:
            return found[0]
    return chosen


def text_of(node: Node) -> str:
    """The node's blocks, in page order."""
    blocks: list[str] = []
    held: list[str] = []

    def close() -> None:
        if line := " ".join("".join(held).split()):
            blocks.append(line)
        held.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            held.append(x)
        elif x.tag == "br":
            held.append(" ")
        elif not x.noise:
            if x.tag in BLOCK:
                close()
                stack.append(None)
            stack += reversed(x.children)
    close()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    return text_of(select(tree(page))) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    a, b = (given.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return given.mapInArrow(run, f"page_id {a}, url {b}, text string, n_chars long")
