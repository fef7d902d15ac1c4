"""Pages as sequences of leaf blocks: the text between block-level tags, with the path of tags above it.

A scanner with find() rather than a tree. It copes with unclosed and crossed tags and takes time in proportion to the page:
no part is read again after a tag without an end, open elements are found by their name in one step, and a block refers
to the innermost element above it instead of a copy of its path.

Scripts, styles, comments and other parts that browsers don't show as text give no blocks. The head ends at its end tag, at the
first tag that isn't one of a head, or at text. A tag that the page ends in goes, the text before it stays. A quote that isn't
closed, or stands elsewhere than before a value, is a character of its tag like others; a "<" that starts no tag is text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

_NAMES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_PARTS = re.compile(r"[^a-z0-9]+")
_STOP = re.compile(r">|=\s*[\"']")  # quotes elsewhere than before a value are characters like others
# Elements of HTML that end a line of text, those that have no end tag, those whose content is no text of a page, those of a head.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mi mn mo mrow ms msub msup mtext q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template svg iframe textarea select title canvas".split())
HEAD = frozenset("base link meta noscript script style template title".split())
#: A start tag of the key ends an open element of the values.
ENDS = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Elements that an end tag or an implied end doesn't reach out of.
SCOPE = frozenset("article aside body div footer form header html main nav section table ul ol dl td th blockquote".split())
_OUTER = ("html", "body")
_CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}


class Element:
    """An open element: its names (tag, words of class, id, role and itemprop) and the element above it; the page's is None."""

    __slots__ = ("above", "depth", "names", "sums")

    def __init__(self, above: Element | None, names: list[str]):
        self.above, self.names = above, names
        self.depth = len(names) + (above.depth if above else 0)
        self.sums = None  # what a reader of paths keeps here


@dataclass
class Block:
    text: str
    element: Element | None
    linked: int  # characters inside links

    @property
    def path(self) -> list[str]:
        """The names of all elements above, outermost first."""
        out, e = [], self.element
        while e:
            out.append(e.names)
            e = e.above
        return [n for names in reversed(out) for n in names]


class _Open:
    """The stack of open elements; where each name stands, and which of them bound the reach of ends."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, Element]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.scopes: list[int] = []
        self.anchors = 0

    def top(self) -> Element | None:
        return self.stack[-1][1] if self.stack else None

    def push(self, tag: str, names: list[str]) -> None:
        at = len(self.stack)
        self.places[tag].append(at)
        if tag in SCOPE:
            self.scopes.append(at)
        self.anchors += tag == "a"
        self.stack.append((tag, Element(self.top(), names)))

    def close(self, names: tuple[str, ...], outer: bool = False) -> None:
        """Close the innermost open element of names, unless one of SCOPE (with outer: html or body) stands above it."""
        at = max((p[-1] for n in names if (p := self.places[n])), default=-1)
        if outer:
            bound = max((p[-1] for n in _OUTER if (p := self.places[n])), default=-1)
        else:
            bound = self.scopes[-1] if self.scopes else -1
        if at < 0 or bound > at:
            return
        while len(self.stack) > at:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()
            self.anchors -= tag == "a"


def tokens(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag, whether it is an end tag, attributes) of all tags; comments and parts without text have the tag ''."""
    n, at, last = len(html), 0, html.rfind(">")
    unclosed = set()  # quotes that don't come any more before the last tag's end
    while (start := html.find("<", at)) >= 0:
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = n if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if html.startswith(("<!", "<?"), start):
            at = start + 2
            if start < last:
                at = html.find(">", start) + 1
                yield start, at, "", False, ""
            continue
        m = _TAG.match(html, start)
        if not m:
            at = start + 1
            continue
        at, end = m.end(), -1
        while at <= last:
            stop = _STOP.search(html, at)
            at = stop.end()
            if stop[0] == ">":
                end = at
                break
            if stop[0][-1] not in unclosed:
                close = html.find(stop[0][-1], at)
                if 0 <= close <= last:
                    at = close + 1
                else:
                    unclosed.add(stop[0][-1])
        if end < 0:
            yield start, n, "", False, ""
            return
        tag, at = m[2].lower(), end
        if tag in RAW and not m[1]:
            close = _CLOSERS[tag].search(html, end)
            at = close.end() if close else n
        yield start, at, "" if tag in RAW else tag, bool(m[1]), html[m.end() : end - 1]


def blocks(html: str) -> list[Block]:
    """The blocks of a page that hold text, in page order; white space inside is one space."""
    out: list[Block] = []
    opened = _Open()
    parts: list[str] = []
    linked, at, head = 0, 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, opened.top(), min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked, head
        if head and piece.isspace():
            return
        head = False
        parts.append(piece)
        if opened.anchors:
            linked += len(piece)

    for start, end, tag, ends, attributes in tokens(html):
        if start > at:
            add(html[at:start])
        at = end
        if not tag:
            continue
        if tag == "head":
            head = not ends
            flush()
            continue
        if tag not in HEAD:
            head = False
        if tag not in INLINE:
            flush()
        elif tag == "br":
            parts.append(" ")
        if ends:
            opened.close((tag,), outer=tag in SCOPE)
            continue
        if tag in ENDS:
            opened.close(ENDS[tag])
        if tag in _ENDS_P:
            opened.close(("p",))
        if tag in VOID or attributes.endswith("/") and tag not in SCOPE:
            continue
        names = [tag]
        for a in _NAMES.finditer(attributes):
            names += [f"{a[1].lower()}={w}" for w in _PARTS.split((a[2] or a[3] or a[4] or "").lower()) if w]
        opened.push(tag, names)
    if at < len(html):
        add(html[at:])
    flush()
    return out
