"""Web pages as trees of block elements with their text blocks as leaves."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Elements within a line of text; all others begin and end a block (fixed values of HTML).
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and those of them and others whose content is no text of the page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style textarea title head template noscript svg math select iframe object audio video canvas".split())
#: A start tag on the left ends an open element on the right.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
#: What keeps the rule above from reaching an outer list or table.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

#: What may stand in a head; anything else, or a word, ends one that is left open (a fixed list of HTML).
IN_HEAD = frozenset("head meta link title base basefont bgsound script style noscript template".split())

_NAMED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_EDGE = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Node:
    """A block element (with its tag and the words of class, id and role) or, if `text` is set, a text block."""

    parent: int
    depth: int
    tag: str
    names: tuple[str, ...] = ()
    text: str | None = None
    link_chars: int = 0
    chars: int = 0
    linked: int = 0
    leaves: int = 0


@dataclass(slots=True)
class Open:
    tag: str
    node: int
    inline: bool
    unseen: bool


@dataclass(slots=True)
class Tree:
    """Nodes in page order, so that a parent comes before its children; node 0 is the page."""

    nodes: list[Node] = field(default_factory=lambda: [Node(-1, 0, "#page")])


class Builder:
    def __init__(self) -> None:
        self.tree = Tree()
        self.stack = [Open("#page", 0, False, False)]
        self.count: dict[str, int] = {}
        self.parts: list[str] = []
        self.links: list[str] = []
        self.in_link = 0

    def text(self, raw: str) -> None:
        if self.stack[-1].tag == "head" and raw.strip():
            self.end("head")
        if raw and not self.stack[-1].unseen:
            words = html.unescape(raw) if "&" in raw else raw
            self.parts.append(words)
            if self.in_link:
                self.links.append(words)

    def flush(self) -> None:
        """The text since the last block edge becomes a leaf of the innermost open block."""
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            nodes, owner = self.tree.nodes, self.stack[-1].node
            link = min(len(text), len(" ".join("".join(self.links).split())))
            nodes.append(Node(owner, nodes[owner].depth + 1, "#text", (), text, link, len(text), link, 1))
        self.parts.clear()
        self.links.clear()

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if self.stack[-1].tag == "head" and tag not in IN_HEAD:
            self.end("head")
        inline = tag in INLINE
        if not inline:
            if self.count.get("p"):
                self.end("p")
            for other in ENDS.get(tag, ()):
                if self.count.get(other):
                    self.end(other, SCOPES.get(tag, frozenset()))
            self.flush()
        if tag in VOID:
            return
        top, nodes = self.stack[-1], self.tree.nodes
        node = top.node
        if not inline:
            names = tuple(
                w for m in _ATTRIBUTE.finditer(attributes) for w in _NAME.findall((m[2] or m[3] or m[4] or "").lower())
            )
            nodes.append(Node(node, nodes[node].depth + 1, tag, names))
            node = len(nodes) - 1
        if tag == "a":
            self.in_link += 1
        self.count[tag] = self.count.get(tag, 0) + 1
        self.stack.append(Open(tag, node, inline, top.unseen or tag in UNSEEN))

    def end(self, tag: str, scope: frozenset[str] | set[str] = frozenset()) -> None:
        """Close the innermost open `tag` and all within it; nothing if it isn't open (within `scope`)."""
        if not self.count.get(tag):
            return
        if scope:
            for held in reversed(self.stack):
                if held.tag == tag:
                    break
                if held.tag in scope:
                    return
        if tag not in INLINE:
            self.flush()
        while True:
            closed = self.stack.pop()
            if not closed.inline:
                self.flush_into(closed)
            if closed.tag == "a":
                self.in_link -= 1
            self.count[closed.tag] -= 1
            if closed.tag == tag:
                return

    def flush_into(self, closed: Open) -> None:
        if self.parts:
            self.stack.append(closed)
            self.flush()
            self.stack.pop()


class Tags:
    """Ends of tags in a page, quoted attributes minded, found in time linear in the page however broken it is."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.hopeless: set[int] = set()  # quotes from which no end of a tag is reached

    def end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at `at`; if its quotes never close, at the next `>` of any kind; or -1."""
        pos, met = at, []
        while pos <= self.last[">"]:
            edge = _EDGE.search(self.page, pos)
            if edge[0] == ">":
                return edge.start()
            quote = edge.start()
            if quote in self.hopeless:
                break
            met.append(quote)
            if quote == self.last[edge[0]]:
                break
            pos = self.page.find(edge[0], quote + 1) + 1
        self.hopeless.update(met)
        return self.page.find(">", at) if at <= self.last[">"] else -1


def parse(page: str) -> Tree:
    """The tree of any text: unknown tags are blocks, tags left open end with the page, stray ends are nothing.

    A head that is left open ends at the first tag or word that may not stand in it.
    """
    builder, tags, at, looked = Builder(), Tags(page), 0, 0
    while (begin := page.find("<", looked)) >= 0:
        looked = begin + 1
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            builder.text(page[at:begin])
            at = looked = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), begin):
            end = page.find(">", begin)
            builder.text(page[at:begin])
            at = looked = end + 1 if end >= 0 else len(page)
            continue
        named = _NAMED.match(page, begin)
        end = tags.end(named.end()) if named else -1
        if end < 0:
            continue
        builder.text(page[at:begin])
        at = looked = end + 1
        tag, attributes = named[2].lower(), page[named.end() : end]
        if named[1]:
            builder.end(tag)
            continue
        builder.start(tag, attributes)
        if tag in RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = looked = close.start() if close else len(page)
    builder.text(page[at:])
    builder.flush()
    nodes = builder.tree.nodes
    for node in reversed(nodes):
        if node.parent >= 0:
            up = nodes[node.parent]
            up.chars += node.chars
            up.linked += node.linked
            up.leaves += node.leaves
    return builder.tree
