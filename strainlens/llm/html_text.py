"""Main text of HTML pages by tree scoring.

A tolerant reader builds the element tree without the parts that are never
article text (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments).  Paragraphs give points for length and
commas to their parent in full, to its parent half, and further up less and
less, over 64 levels; a container's points are discounted by its share of link text.  The best
container is kept, with the siblings whose points come near or that are plain
paragraphs, and its blocks are joined in page order.

One pass without a shuffle, one page at a time.  Defined results: null and
empty pages give an empty text; text without any paragraph comes from the best
container all the same; unclosed and misnested tags are closed where the next
block begins; a tag whose quotes do not close ends at its first ">"; time is in
proportion to the page, however deeply it nests; other columns pass through, and a clash with the added struct's
name is an error.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strainlens.llm import batches

# ancestors that a paragraph's points reach; the last one gets half a hundredth
LEVELS = 64

SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<(?=/)[^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORDS = re.compile(r"[A-Za-z0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
# a start tag of the first kind ends an open element of the second kind, up to the nearest boundary
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_SKIPPED = frozenset("head nav header footer aside form script style noscript template iframe svg math object applet canvas audio video button select input textarea label dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar status".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted banner sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer comment comments commentlist disqus respond reply replies notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations widget widgets pagination pager toolbar toc skip hidden".split())
_HEADS = frozenset("header masthead".split())
_OWN = frozenset("article post entry story content".split())
_LINKS = frozenset("post posts article articles link links content stories news items reading sidebar widget box".split())
_KEPT = frozenset("html body article main".split())
_PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass(eq=False)
class Node:
    tag: str
    parent: "Node | None"
    skipped: bool = False
    parts: list = field(default_factory=list)
    points: float = 0.0
    size: int = 0
    linked: int = 0


def _named(value: str, in_article: bool) -> bool:
    """Whether a class or id names something beside the text."""
    for name in value.split():
        pieces = set(_WORDS.findall(name))
        found = _NAMES & pieces
        # what belongs to the article has such names too: its header, and related work that is no list of links
        if in_article or pieces & _OWN:
            found -= _HEADS
        if "related" in found and pieces - {"related"} and not pieces & _LINKS:
            found -= {"related"}
        if found:
            return True
    return False


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _SKIPPED:
        # an article's own header holds its headline
        return not (tag == "header" and in_article)
    if not attributes or tag in _KEPT:
        return False
    found = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True
    return found.get("role", "") in _ROLES or _named(f"{found.get('class', '')} {found.get('id', '')}", in_article)


def parse(html: str) -> Node:
    root = Node("#root", None)
    stack, at = [root], 0
    # where the open elements of a tag stand in the stack, so that none is searched for
    places: dict[str, list[int]] = {}

    def text(value: str) -> None:
        if value and not stack[-1].skipped:
            stack[-1].parts.append(unescape(value))

    def last(tags: set) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def close(tags: set, bounds: set) -> None:
        i = last(tags)
        if i > last(bounds):
            while len(stack) > i:
                places[stack.pop().tag].pop()

    while at < len(html):
        m = _TAG.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at:m.start()])
        at = m.end()
        # the second form is a tag whose quotes do not close: it ends at the first ">"
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = (tag or "").lower()
        if not tag:
            continue
        if slash:
            if tag == "br":
                text(" ")
            else:
                close({tag}, set())
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                text(" ")
            continue
        if tag in _BLOCK:
            close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in _HEADING and stack[-1].tag in _HEADING:
            places[stack.pop().tag].pop()
        if tag in _ENDS:
            close(*_ENDS[tag])
        node = Node(tag, stack[-1], stack[-1].skipped or _unwanted(tag, attributes, last({"article", "main"}) > 0))
        stack[-1].parts.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif not attributes.endswith("/") or tag in _BLOCK:
            push(node)
    return root


def _order(root: Node) -> list[Node]:
    """Elements that are kept, parents first, without recursion."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.skipped:
            out.append(node)
            todo.extend(reversed([x for x in node.parts if isinstance(x, Node)]))
    return out


def _score(nodes: list[Node]) -> None:
    plain: dict[int, list[str]] = {id(n): [x for x in n.parts if isinstance(x, str)] for n in nodes}
    commas: dict[int, int] = {}
    for node in reversed(nodes):
        own = "".join(plain[id(node)])
        below = [x for x in node.parts if isinstance(x, Node) and not x.skipped]
        node.size = len("".join(own.split())) + sum(x.size for x in below)
        node.linked = node.size if node.tag == "a" else sum(x.linked for x in below)
        commas[id(node)] = sum(map(own.count, ",，、،")) + sum(commas[id(x)] for x in below if x.tag not in _BLOCK)
    for node in nodes:
        # a block that holds text itself is a paragraph too
        if node.size and (node.tag in _PARAGRAPH or node.tag in _BLOCK and "".join(plain[id(node)]).strip()):
            points = 1 + commas[id(node)] + min(node.size / 100, 3)
            points *= 1 - node.linked / node.size
            holder = node.parent if node.tag in _PARAGRAPH else node
            share, level = 1.0, 1
            while holder is not None and level <= LEVELS:
                holder.points += points * share
                level += 1
                share, holder = (0.5 if level == 2 else 1 / (3 * (level - 1))), holder.parent
    for node in nodes:
        node.points *= 1 - node.linked / max(node.size, 1)


def _blocks(tops: list[Node]) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        line = " ".join("".join(held).split())
        if line:
            out.append(line)
        held.clear()

    # a stack of parts to visit; None ends a block
    todo: list = []
    for top in reversed(tops):
        todo.extend((None, top, None))
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            held.append(x)
        elif not x.skipped:
            parts = x.parts
            if x.tag == "header":
                parts = [p for p in parts if isinstance(p, Node) and p.tag in _HEADING | {"hgroup"}]
            if x.tag in _BLOCK:
                todo.append(None)
            todo.extend(reversed(parts))
            if x.tag in _BLOCK:
                todo.append(None)
    end()
    return out


def extract(html: str) -> str:
    nodes = _order(parse(html))
    _score(nodes)
    boxes = [n for n in nodes if n.size and n.tag not in _PARAGRAPH and (n.tag in _BLOCK or n.parent is None)]
    if not boxes:
        return ""
    best = max(boxes, key=lambda n: n.points)
    # a parent that holds the same text and no more adds nothing; a named article is taken whole
    at = best
    while at.parent is not None:
        at = at.parent
        if at.tag in ("article", "main"):
            best = at
    kept = [best]
    if best.parent is not None and best.tag not in ("article", "main"):
        least = max(10.0, 0.2 * best.points)
        kept = []
        for x in best.parent.parts:
            if isinstance(x, Node) and not x.skipped:
                dense = x.linked / max(x.size, 1)
                if x is best or x.points >= least or x.tag in _PARAGRAPH and x.size and dense < 0.25:
                    kept.append(x)
    elif best.tag == "article" and best.parent is not None:
        kept = [x for x in best.parent.parts if x is best or isinstance(x, Node) and x.tag == "article" and not x.skipped and x.points >= 0.2 * best.points]
    return "\n".join(_blocks(kept))


def _work(texts: list[bytes]) -> dict:
    found = [extract(x.decode()) if x else "" for x in texts]
    return {"text": found, "n_chars": [len(x) for x in found]}


def main_text(pages: DataFrame, html: str = "html", out: str = "main") -> DataFrame:
    """``pages`` with a struct ``out`` of text and n_chars."""
    return batches.add_struct(pages, html, out, SCHEMA, _work)
