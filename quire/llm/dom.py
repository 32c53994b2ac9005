"""Leaf blocks of a page: runs of text between block-level tags, with their ancestors.

A forgiving reader of tag soup: unclosed and crossing tags, missing ends and stray
ends are all taken as they come. Scripts, styles, titles, comments and form controls
are passed over, and nothing else; <br> is white space. Time is linear in the page,
whatever it nests or leaves open: every scan either moves on for good or is answered
from counts of what is open.
"""

from __future__ import annotations

import html
import re
from collections.abc import Container
from dataclasses import dataclass, field

#: Fixed values of HTML: elements without an end, with raw text, that hold no text of the page, that stand as blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
HIDDEN = frozenset("head script style title textarea select optgroup option datalist button".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav noscript ol p plaintext pre search section summary table tbody td template tfoot th thead tr ul xmp".split()
) | (HIDDEN - {"option"}) | {"option"}
#: A start tag of one of the keys ends open elements of its values, up to the nearest of the barriers.
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
} | {t: ("p",) for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()}
_BARRIER = frozenset("ul ol dl table body html article section div td th aside nav main footer header form blockquote".split())
#: A tag whose attribute values may hold ">" in quotes; possessive, so that a failure is found in one pass.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    up: str | None  # tag around the innermost one
    context: tuple[str, ...]  # distinct "a:tag" and "c:word" of all elements around
    linked: int  # characters inside of links


@dataclass(slots=True)
class _Frame:
    """An open block element and the inline elements open right in it."""

    tag: str
    context: tuple[str, ...]
    hidden: bool
    inlines: list[str] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)


def _names(attrs: str) -> list[str]:
    """Words of class, id and role."""
    return [w for m in _ATTR.finditer(attrs) for w in _NAME.findall(_CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower())]


class _Stack:
    """Open elements, with counts that answer whether a scan would find anything."""

    def __init__(self, known: Container[str] | None):
        self.known = known
        self.frames = [_Frame("", (), False)]
        self.open: dict[str, int] = {}  # block elements by tag
        self.levels: list[dict[str, int]] = [{}]  # the same since each open barrier, itself included
        self.links = 0

    def push(self, tag: str, attrs: str) -> None:
        top = self.frames[-1]
        new = [f for f in dict.fromkeys([f"a:{tag}", *(f"c:{w}" for w in (_names(attrs) if attrs else ()))]) if f not in top.context and (self.known is None or f in self.known)]
        self.frames.append(_Frame(tag, (*top.context, *new) if new else top.context, top.hidden or tag in HIDDEN))
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in _BARRIER:
            self.levels.append({})
        self.levels[-1][tag] = self.levels[-1].get(tag, 0) + 1

    def pop(self) -> str:
        frame = self.frames.pop()
        self.links -= frame.counts.get("a", 0)
        self.open[frame.tag] -= 1
        self.levels[-1][frame.tag] -= 1
        if frame.tag in _BARRIER:
            self.levels.pop()
        return frame.tag

    def make_room(self, tag: str) -> None:
        """Ends what a start tag ends."""
        ends = _CLOSES.get(tag, ())
        if any(self.levels[-1].get(t) for t in ends):
            while self.pop() not in ends:
                pass

    def end(self, tag: str) -> None:
        """Ends the nearest open block element of that name, and all in it."""
        if self.open.get(tag):
            while self.pop() != tag:
                pass

    def push_inline(self, tag: str) -> None:
        top = self.frames[-1]
        top.inlines.append(tag)
        top.counts[tag] = top.counts.get(tag, 0) + 1
        self.links += tag == "a"

    def end_inline(self, tag: str) -> None:
        """Ends the nearest such element of the same block, and all in it; a stray end never ends blocks."""
        top = self.frames[-1]
        while top.counts.get(tag):
            gone = top.inlines.pop()
            top.counts[gone] -= 1
            self.links -= gone == "a"
            if gone == tag:
                break


def blocks(page: str | None, known: Container[str] | None = None) -> list[Block]:
    """The page's leaf blocks in order; none for a null, empty or textless page.

    Of the ancestors' features only ``known`` ones are kept, where it is given.
    """
    page = page or ""
    out: list[Block] = []
    stack = _Stack(known)
    text: list[str] = []
    linked = 0
    at, n = 0, len(page)
    tags = _TAG

    def flush() -> None:
        nonlocal linked
        if text:
            whole = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if whole:
                top = stack.frames[-1]
                out.append(Block(whole, top.tag or "body", stack.frames[-2].tag if len(stack.frames) > 2 else None, top.context, min(linked, len(whole))))
        text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not stack.frames[-1].hidden:
            text.append(piece)
            if stack.links:
                linked += len(piece.strip())

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        if page.startswith(("<!", "<?"), lt):
            close = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">"
            end = page.find(close, lt + 2)
            at = end + len(close) if end >= 0 else n
            continue
        m = tags.match(page, lt)
        if not m and tags is _TAG and page.startswith("<", lt) and _LOOSE.match(page, lt):
            # quotes that never close: from here on a tag ends at the first ">"
            tags = _LOOSE
            m = tags.match(page, lt)
        if not m:
            # "<" that starts no tag is text; an unfinished tag at the end is not
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]):
                break
            add("&lt;")
            at = lt + 1
            continue
        at = m.end()
        closing, tag, attrs = m[1], m[2].lower(), m[3]
        if tag == "br":
            add(" ")
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if closing:
            stack.end(tag) if block else stack.end_inline(tag)
            continue
        if block:
            stack.make_room(tag)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, at)
            if tag == "xmp":
                add(page[at : end.start() if end else n].replace("&", "&amp;"))
                flush()
            at = end.end() if end else n
        elif tag not in VOID and not (attrs.endswith("/") and block and tag not in _BARRIER):
            stack.push(tag, attrs) if block else stack.push_inline(tag)
    flush()
    return out
