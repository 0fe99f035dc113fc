"""Main text of web pages by composite text density.

A page is parsed into a tree of elements. Each node gets a link-adjusted density
of characters for each tag; a node's density sum is the sum of its children's.
The node of greatest density sum whose density reaches the threshold, the least
density on the path from the densest node up to the body, is the main subtree
(Sun, Song and Liao, "DOM based content extraction via text density", SIGIR 2011).
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments are cut from the tree before, by their elements, roles and names. A name
that may as well be the text's subject ("social-science") only halves a node's
density: it stays if the main subtree lies in it, or if it is dense enough itself.
Where the main subtree's article holds more than the density chose, blocks of
links among it are menus.

Text is read by blocks: white space inside a block becomes one space, blocks are
joined in page order by one line feed. Nothing else is dropped or capped.

Defined results: a null or empty page gives an empty text; a page without markup
is one block; pages that repeat are read each; further columns are kept, but for
ones called text and n_chars, which the results replace; time and memory are in
proportion to a page's length, whatever its nesting and unclosed tags.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.shared import map_arrow

MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|$))"  # comment
    r"|<(?:![^>]*|\?[^>]*)(?:>|$)"  # declaration
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never main text.
CUT = frozenset("script style nav footer aside form noscript iframe template button select textarea input svg canvas head title dialog menu object embed audio video map".split())
#: Blocks that can be menus by the links that they hold.
MENUS = frozenset("div ul ol menu section table dl".split())
#: Open elements that a start tag of this name ends, up to one of the scopes.
ENDS = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
ENDS_P = BLOCK - {"body", "html", "tr", "td", "th", "tbody", "thead", "tfoot", "option", "optgroup", "legend"}
#: Words in class, id and role that name parts of a page beside the article.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar sidebars side aside footer footers masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social comment comments commentary disqus reply replies respond related recommended "
    "recommendations widget widgets toolbar pagination pager skip search copyright legal complementary contentinfo dialog disclaimer feedback rail".split()
)
#: Words that make a page's header of a block, unless one of the article's own words is beside them.
HEADERS = frozenset("header heading".split())
OWN = frozenset("article post entry story content main body text".split())
#: Of PARTS, those that a text may be about: beside words of neither list they are weak evidence.
SUBJECTS = frozenset(
    "social side aside alert notice banner promotion legal copyright search share sharing related feedback rail dialog navigation menu menus overlay skip respond sponsor "
    "disclaimer subscription complementary commentary".split()
)
#: Words that go with those of PARTS in the name of a part.
LAYOUT = frozenset(
    "list container wrapper wrap box block section area inner outer item items row col column group panel bar button buttons link links icon icons title label top bottom left right "
    "main primary secondary slot unit zone header heading body content text post posts article articles entry story stories page site global mobile desktop fixed sticky small large".split()
)
#: Words that make of a name a state of what it wraps.
STATES = frozenset("has with no without not".split())
NAME_WORDS = re.compile(r"[a-z]+")
#: Why a node is left out: by its element or state, by its name, or, if its density is low, by its name.
BY_ELEMENT, BY_NAME, BY_SUBJECT = 1, 2, 3


class Node:
    __slots__ = ("name", "parent", "children", "cut", "chars", "tags", "link_chars", "link_tags", "density", "total", "weight")

    def __init__(self, name: str, parent: "Node | None", cut: int) -> None:
        self.name, self.parent, self.cut = name, parent, cut
        self.children: list = []


def _named(value: str, in_article: bool) -> int:
    """What the words of a class, id or role say: 0, BY_NAME or BY_SUBJECT."""
    names = [NAME_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", v).lower()) for v in value.split()]
    found = 0
    for words in names:
        if not STATES.isdisjoint(words):
            continue
        parts = PARTS.intersection(words)
        if parts:
            strong = words[-1] in PARTS or not parts <= SUBJECTS or all(w in PARTS or w in LAYOUT for w in words)
            found = BY_NAME if strong or found == BY_NAME else BY_SUBJECT
        elif not in_article and HEADERS.intersection(words) and not any(OWN.intersection(x) for x in names):
            found = BY_NAME
    if found == BY_NAME and any(words and OWN.issuperset(words) for words in names):
        return BY_SUBJECT
    return found


def _names_a_part(name: str, rest: str, in_article: bool) -> int:
    if name in CUT:
        return BY_ELEMENT
    if name == "header":
        return 0 if in_article else BY_ELEMENT
    if not rest or name in ("html", "body", "main"):
        return 0
    worst = 0
    for key, a, b, c in ATTRIBUTE.findall(rest):
        key = key.lower()
        if key in ("class", "id", "role"):
            value = unescape(a or b or c)
            if name == "article":
                words = NAME_WORDS.findall(value.lower())
                if "comment" in words or "comments" in words or "advert" in words or "ad" in words:
                    return BY_NAME
            else:
                found = _named(value, in_article)
                worst = BY_NAME if BY_NAME in (found, worst) else found or worst
        elif key == "hidden" or key == "aria-hidden" and (a or b or c).lower() == "true":
            return BY_ELEMENT
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a or b or c, re.I):
            return BY_ELEMENT
    return worst


def parse(html: str, by_names: bool = True) -> Node:
    """A tree of nodes and strings; strings are still encoded.

    Parts beside the article are marked as cut: by their elements and, with
    by_names, by the words of their class, id and role. What holds the page's
    first article is never cut by such words.
    """
    root = Node("html", None, False)
    node, at, article, seen = root, 0, 0, False
    size = len(html)
    # How many elements of a name are open: what is not open needs no search.
    opened: Counter = Counter()
    while at < size:
        m = MARKUP.search(html, at)
        if m is None:
            break
        if m.start() > at:
            node.children.append(html[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            while opened[name]:
                article -= node.name in ("article", "main")
                opened[node.name] -= 1
                last, node = node.name, node.parent
                if last == name:
                    break
            continue
        if name in ("html", "body"):
            continue
        stop: tuple[str, ...] = ()
        ended: tuple[str, ...] = ()
        if name in ENDS_P:
            ended, stop = ("p",), ("table", "button", "object", "article", "section", "div", "td", "th", "li")
        for names, scopes in ((ended, stop), (tuple(ENDS[name][0].split()), ENDS[name][1]) if name in ENDS else ((), ())):
            up, found = node, None
            while any(opened[n] for n in names) and up is not root and up.name not in scopes:
                if up.name in names:
                    found = up
                    if name != "tr":
                        break
                up = up.parent
            while found is not None:
                article -= node.name in ("article", "main")
                opened[node.name] -= 1
                last, node = node, node.parent
                if last is found:
                    break
        new = Node(name, node, _names_a_part(name, m["rest"] if by_names else "", article > 0))
        node.children.append(new)
        if name in ("article", "main") and not new.cut and not seen:
            seen, up = True, node
            while up is not None:
                up.cut = up.cut if up.name in CUT else 0
                up = up.parent
        if name in VOID or m["rest"].endswith("/") and name not in BLOCK and name not in RAW and name != "a":
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|$)", re.I).search(html, at)
            new.children.append(html[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        node = new
        opened[name] += 1
        article += name in ("article", "main")
    if at < size:
        node.children.append(html[at:])
    return root


def _walk(root: Node) -> list[Node]:
    """Nodes that are not cut, parents before children; those that a subject may name are among them."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node) and c.cut in (0, BY_SUBJECT))
    return order


def main_node(root: Node) -> Node:
    """The subtree of greatest density sum, by the threshold on the densest node's path.

    It settles which nodes that a subject may name are cut, and cuts menus from the article.
    """
    order = _walk(root)
    for n in reversed(order):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        for c in n.children:
            if isinstance(c, str):
                n.chars += len("".join(c.split()))
            elif c.cut in (0, BY_SUBJECT):
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.link_chars
                n.link_tags += c.link_tags + (c.name == "a")
        if n.name == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags
    body = order[0]
    share = body.link_chars / max(body.chars, 1)
    for n in order:
        plain = n.chars - n.link_chars
        # Links lower a node's density: by their characters and by their tags.
        base = math.log(n.chars * n.link_chars / max(plain, 1) + share * n.chars + math.e)
        ratio = (n.chars * max(n.tags, 1)) / (max(n.link_chars, 1) * max(n.link_tags, 1)) if n.chars else 0.0
        n.weight = (1.0 if n.parent is None else n.parent.weight) * (0.5 if n.cut else 1.0)
        n.density = n.weight * n.chars / max(n.tags, 1) * math.log(max(ratio, 1.0) + 1.0) / max(math.log(base), 0.1) if n.chars else 0.0
    for n in order:
        n.total = sum(c.density for c in n.children if isinstance(c, Node) and c.cut in (0, BY_SUBJECT)) or n.density
    densest = max(order, key=lambda n: n.density)
    threshold, up = densest.density, densest
    while up is not None:
        threshold = min(threshold, up.density)
        up = up.parent
    best = max((n for n in order if n.density >= threshold), key=lambda n: n.total)
    # A block of the main text is not the main text: inline and text blocks give way to what holds them.
    while best.parent is not None and best.name not in ("article", "main", "section", "div", "td", "body", "html"):
        best = best.parent
    # The article is whole: its outermost element holds titles and sections alike.
    up, whole, path = best, best, set()
    while up is not None:
        path.add(up)
        up.cut = 0
        if up.name in ("article", "main"):
            whole = up
        up = up.parent
    inside = set(_walk(best))
    for n in order:
        if n.cut and n.density / n.weight >= threshold:
            n.cut = 0
        elif n not in path and n not in inside and n.name in MENUS and n.link_tags > 1 and 4 * n.link_chars >= 3 * n.chars:
            n.cut = BY_ELEMENT
    return whole


def blocks(node: Node) -> list[str]:
    """The node's blocks of text in page order."""
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        if held:
            text = "".join(held)
            held.clear()
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                out.append(text)

    stack: list = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            held.append(item)
        elif item is None:
            end()
        elif item.cut:
            if item.name in BLOCK:
                end()
        elif item.name == "br":
            held.append(" ")
        else:
            block = item.name in BLOCK
            if block:
                end()
                stack.append(None)
            stack.extend(reversed(item.children))
    end()
    return out


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    text = "\n".join(blocks(main_node(parse(html))))
    # Words can name what wraps the whole page; then they say nothing.
    return text or "\n".join(blocks(main_node(parse(html, False))))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html, with text and n_chars of every row."""
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    source = pages.select(*rest, F.col(html_col).cast("string").alias(html_col))
    schema = source.select(*rest, F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names
            )

    return map_arrow(source, run, schema)
