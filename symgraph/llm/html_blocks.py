"""Leaf blocks of a page: runs of text between block-level tags, with the tags around them."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

# Elements of HTML that begin a block, that hold no text of the page, and that have no end tag.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
SILENT = frozenset("head iframe noscript object script style svg template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the first kind closes an open one of the second kinds.
CLOSES = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
#: Implied ends do not reach past these.
FENCES = frozenset("article aside body dialog div dl fieldset footer form header main nav ol section table ul".split())
#: Elements whose order from the root down tells a site's header from an article's.
PARTS = frozenset("main article section header footer nav aside form table dialog".split())
_NAME = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A run of text: tags and names of all elements around it, the last three tags, characters in links, the label's mark, and the parts of the page around it from the root down."""

    text: str
    tags: frozenset[str]
    names: frozenset[str]
    last: tuple[str, ...]
    linked: int
    mark: str | None = None
    way: tuple[str, ...] = ()


@dataclass
class _Open:
    """An open element with the tags and names from the root down to it; a set that gains nothing is its parent's own."""

    tag: str
    tags: frozenset[str]
    names: frozenset[str]
    mark: str | None
    way: tuple[str, ...] = ()


_ROOT = _Open("", frozenset(), frozenset(), None)


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.open: Counter[str] = Counter()
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.silent = self.anchors = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.stack[-1] if self.stack else _ROOT
                self.blocks.append(Block(text, top.tags, top.names, tuple(o.tag for o in self.stack[-3:]), self.linked, top.mark, top.way))
            self.parts, self.linked = [], 0

    def _pop(self, at: int) -> None:
        gone = self.stack[at:]
        if any(o.tag in BLOCKS for o in gone):
            self.flush()
        for o in gone:
            self.silent -= o.tag in SILENT
            self.anchors -= o.tag == "a"
            self.open[o.tag] -= 1
        del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            ended = CLOSES.get(tag, {"p"})
            if any(self.open[t] for t in ended):
                for at in range(len(self.stack) - 1, -1, -1):
                    if self.stack[at].tag in ended:
                        self._pop(at)
                        break
                    if self.stack[at].tag in FENCES:
                        break
        if tag == "br":
            self.parts.append(" ")
        if tag == "body" or tag in ("article", "main") and self.silent:
            # A body ends whatever was left open ahead of it.
            self._pop(next((i for i, o in enumerate(self.stack) if o.tag in SILENT), len(self.stack)))
        if tag in VOID:
            return
        given = dict(attrs)
        words = " ".join(given.get(k) or "" for k in ("class", "id", "role")).lower()
        above = self.stack[-1] if self.stack else _ROOT
        names = {*_NAME.findall(words), *(["hidden"] if "hidden" in given else [])}
        mark = given.get("data-mark")
        self.stack.append(_Open(
            tag, above.tags if tag in above.tags else above.tags | {tag}, above.names if names <= above.names else above.names | names, above.mark if mark is None else mark,
            above.way + (tag,) if tag in PARTS and tag not in above.way else above.way,
        ))
        self.open[tag] += 1
        self.silent += tag in SILENT
        self.anchors += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag == tag:
                self._pop(at)
                return

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.anchors:
                self.linked += len(data)


def leaf_blocks(html: str | None) -> list[Block]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks
