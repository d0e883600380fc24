"""A small, forgiving HTML parser: elements, their class words and their text, in document order."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math".split())
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
#: Elements that a new element of the given kind ends, unless one of the walls lies between.
ENDS_P = BLOCKS - {"html", "body", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "legend", "summary", "figcaption"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
WALLS = frozenset("table td th caption object button article section div main aside nav header footer form body html blockquote li".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Deeper elements become siblings, so that no walk of the tree runs out of stack.
MAX_DEPTH = 200
CLOSERS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in RAW}


class Node:
    """An element. `items` holds text pieces (str) and child nodes in page order."""

    __slots__ = ("tag", "attrs", "items", "parent", "depth")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.items, self.parent = tag, attrs, [], parent
        self.depth = parent.depth + 1 if parent is not None else 0

    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]


def attributes(written: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(written)} if written.strip(" /\n\t\r") else {}


#: Most pages repeat the same short attributes; the dict is shared by their elements and never changed.
SHORT = 200
known_attributes = lru_cache(8192)(attributes)


def parse(html: str) -> Node:
    """The tree of a page. Never fails: what closes nothing is ignored, what is left open ends with the page."""
    root = Node("#root", {}, None)
    at, here, end = 0, root, len(html)
    while at < end:
        found = TOKEN.search(html, at)
        upto = found.start() if found else end
        if upto > at:
            here.items.append(unescape(html[at:upto]))
        if not found:
            break
        at = found.end()
        if found[1] is not None:
            here.items.append(found[1])
            continue
        if found[3] is None:
            continue
        tag = found[3].lower()
        if found[2]:
            node: Node | None = here
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                here = node.parent
            continue
        written = found[4]
        attrs = (known_attributes if len(written) <= SHORT else attributes)(written) if written else {}
        if tag in ENDS_P:
            node = here
            while node is not None and node.tag != "p" and node.tag not in WALLS:
                node = node.parent
            if node is not None and node.tag == "p":
                here = node.parent
        elif tag in SIBLINGS:
            ended, walls = SIBLINGS[tag]
            node, last = here, None
            while node is not None and node.tag not in walls:
                if node.tag in ended:
                    last = node
                node = node.parent
            if last is not None:
                here = last.parent
        child = Node(tag, attrs, here)
        here.items.append(child)
        if tag in RAW:
            close = CLOSERS[tag].search(html, at)
            if tag in ("textarea", "title", "noscript"):
                child.items.append(unescape(html[at : close.start() if close else end]))
            at = close.end() if close else end
        elif tag not in VOID and child.depth < MAX_DEPTH:
            here = child  # a slash does not close an element that needs an end tag
    return root
