"""Pages to leaf blocks: text runs between block-level tags, with their tag paths.

A page is read once, and every step costs the same however deep or long the page is: open
elements are found by their tag, and a block's path is not copied but told by how many
elements had opened and closed before it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable
from typing import NamedTuple

import xxhash

PATHS, WORDS = 4096, 1024
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(?P<odd>[a-zA-Z][^\s/>]*)[^>]*>",
    re.S,
)
#: After the last ``>`` of a page only these can begin.
_TAIL = re.compile(r"<!--.*|<!\[CDATA\[.*", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[^a-z]+")
BLOCKS = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
SKIPPED = frozenset("script style noscript template svg head title iframe object canvas audio video".split())
RAW = frozenset("script style title textarea iframe noscript".split())
#: What can stand in a head; any other tag, or text, ends one that is left open.
HEAD = frozenset("head title meta link base script style noscript template".split())
#: An opening tag that ends these open elements (up to the nearest container).
CLOSES = {t: frozenset({"p"}) for t in BLOCKS - {"option", "button", "textarea", "body", "html"}} | {
    "li": frozenset({"p", "li"}), "dt": frozenset({"p", "dt", "dd"}), "dd": frozenset({"p", "dt", "dd"}), "tr": frozenset({"p", "tr", "td", "th"}), "td": frozenset({"p", "td", "th"}), "th": frozenset({"p", "td", "th"}), "option": frozenset({"option"}),
    "body": frozenset({"head", "p"}),
}
_SCOPE = frozenset("html body article aside div section main nav header footer ul ol dl table blockquote form td th figure details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Block(NamedTuple):
    text: str
    at: int  # how many elements had opened or closed before
    steps: tuple[int, int]  # hashed tokens of the innermost block element, and of it with its parent
    linked: float  # share of characters inside links
    heading: bool
    depth: int


class Page(list):
    """Blocks in page order. ``events``: the hashed path tokens of each element that opens (sign 1) or
    closes (-1); a block's path is the sum of those before it."""

    def __init__(self, blocks: Iterable[Block] = (), events: list[tuple[int, ...]] | None = None, signs: list[int] | None = None):
        super().__init__(blocks)
        self.events, self.signs = events or [], signs or []


def _bucket(token: str, n: int) -> int:
    return xxhash.xxh3_64_intdigest(token) % n


_seen: dict[tuple[str, str], tuple[int, ...]] = {}


def _tokens(tag: str, attrs: str) -> tuple[int, ...]:
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attrs)).lower() if attrs else ""
    key = (tag, names)
    if (got := _seen.get(key)) is None:
        if len(_seen) > 50_000:
            _seen.clear()
        words = [w for w in _PARTS.split(names) if w]
        got = tuple(dict.fromkeys(_bucket(t, PATHS) for t in [f"<{tag}", *(f".{w}" for w in words)]))
        if len(names) < 200:
            _seen[key] = got
    return got


_steps: dict[tuple[str, ...], tuple[int, int]] = {}


class _Stack:
    """Open elements, with the places of each tag."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.tokens: list[tuple[int, ...]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []  # places of block elements
        self.links = self.skipping = self.headings = 0
        self.events: list[tuple[int, ...]] = []
        self.signs: list[int] = []

    def push(self, tag: str, tokens: tuple[int, ...]) -> None:
        self._count(tag, 1)
        place = len(self.tags)
        self.tags.append(tag)
        self.tokens.append(tokens)
        self.places[tag].append(place)
        if tag in BLOCKS:
            self.blocks.append(place)
        self.events.append(tokens)
        self.signs.append(1)

    def cut(self, place: int) -> None:
        """Close all elements from ``place`` on."""
        while len(self.tags) > place:
            tag = self.tags.pop()
            self._count(tag, -1)
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            self.events.append(self.tokens.pop())
            self.signs.append(-1)

    def _count(self, tag: str, one: int) -> None:
        if tag == "a":
            self.links += one
        elif tag in SKIPPED:
            self.skipping += one
        elif tag in HEADINGS:
            self.headings += one

    def top(self) -> str | None:
        return self.tags[-1] if self.tags else None

    def last(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else -1

    def steps(self) -> tuple[int, int]:
        tags = tuple(self.tags[k] for k in self.blocks[-2:])
        if (got := _steps.get(tags)) is None:
            got = _steps[tags] = tuple(_bucket(">" + ">".join(tags[-k:]), PATHS) for k in (1, 2))
        return got

    def ended_by(self, ends: frozenset[str]) -> int:
        """The outermost of the elements ``ends`` above the nearest other container; -1: none."""
        found = [p for t in ends if (p := self.places.get(t))]
        if not found:
            return -1
        wall = max((p[-1] for t in _SCOPE if t not in ends and (p := self.places.get(t))), default=-1)
        return min((p[k] for p in found if (k := bisect_right(p, wall)) < len(p)), default=-1)


def blocks_of(page: str) -> Page:
    """Leaf blocks in page order; empty ones are left out. White space is single, references decoded."""
    out, stack = Page(), _Stack()
    parts: list[str] = []
    linked = at = 0
    size, last, scan = len(page), page.rfind(">"), _TOKEN.search

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, len(stack.events), stack.steps(), min(1.0, linked / len(text)), stack.headings > 0, len(stack.tags)))
            parts.clear()
        linked = 0

    while at < size:
        m = scan(page, at) if at <= last else _TAIL.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            if stack.tags and stack.tags[-1] == "head" and page[at:stop].strip():
                stack.cut(len(stack.tags) - 1)
            if not stack.skipping:
                piece = html.unescape(page[at:stop])
                parts.append(piece)
                if stack.links:
                    linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        found = m.groupdict() if m.re is _TOKEN else {}
        if (end := found.get("end")) is not None:
            tag = end.lower()
            if tag == "br" and not stack.skipping:
                parts.append(" ")
            place = stack.last(tag)
            if place >= 0:
                if tag in BLOCKS or tag in SKIPPED:
                    flush()
                    stack.cut(place)
                elif not stack.blocks or place > stack.blocks[-1]:  # inline: only down to the nearest block
                    stack.cut(place)
            continue
        tag = found.get("tag") or found.get("odd")
        if tag is None:
            if m[0].startswith("<![CDATA[") and not stack.skipping:
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag, attrs = tag.lower(), found["attrs"] or ""
        if tag not in HEAD and stack.top() == "head":
            stack.cut(len(stack.tags) - 1)
        if tag in VOID:
            if tag == "hr":
                flush()
            elif not stack.skipping:
                parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            if (ends := CLOSES.get(tag)) and (place := stack.ended_by(ends)) >= 0:
                stack.cut(place)
        elif tag in ("head", "title"):
            flush()
        if attrs.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            body = page[at : end.start() if end else size]
            at = end.end() if end else size
            if tag == "textarea" and not stack.skipping:
                parts.append(html.unescape(body))
                flush()
            continue
        stack.push(tag, _tokens(tag, attrs))
    flush()
    out.events, out.signs = stack.events, stack.signs
    return out
