"""Leaf blocks of an HTML page: runs of text that no block-level tag interrupts, with their surroundings."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

#: Tags whose start or end closes the block of text before them.
BREAKING = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page.
HIDDEN = frozenset("script style noscript template iframe object svg canvas audio video head title textarea".split())
#: Start tags that a head may hold; any other one, or text, ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements that have no end tag.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not parsed: it ends at their own end tag only.
RAW = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript")}
#: Tags that a block's path tells of.
KNOWN = BREAKING | HIDDEN | IN_HEAD | frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark math output q rp rt ruby s samp small span strong sub sup time tt u var".split())
#: What the start tag of the key closes when it is open nearer than any of ``FENCES``.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("ul ol dl table select div section article aside nav main".split())

ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)")
NAME_PART = re.compile(r"[a-z]+")


NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: What stands between the places in a tag where a value may begin or the tag ends.
IN_TAG = re.compile(r"[^=>]*")
VALUE = re.compile(r"=\s*")


@dataclass(slots=True)
class Block:
    """text: decoded, white space collapsed; tag: nearest breaking element; path: known tags of open
    elements; names: parts of their class, id and role names; links: characters inside links."""

    text: str
    tag: str
    path: frozenset[str]
    names: frozenset[str]
    links: int


class _Open:
    """The open elements: their tags, and at once the place of the last one of each tag or kind."""

    def __init__(self):
        self.tags: list[str] = []
        self.more: list[tuple[tuple[str, ...], bool]] = []
        self.at: dict[str, list[int]] = {}
        self.breaking: list[int] = []
        self.hiding: list[int] = []
        self.path: Counter[str] = Counter()
        self.names: Counter[str] = Counter()
        self.hidden = 0
        self.sets: tuple[frozenset[str], frozenset[str]] | None = None

    def push(self, tag: str, names: tuple[str, ...], hides: bool) -> None:
        k = len(self.tags)
        self.tags.append(tag)
        self.more.append((names, hides))
        self.at.setdefault(tag, []).append(k)
        if tag in BREAKING:
            self.breaking.append(k)
        if tag in HIDDEN:
            self.hiding.append(k)
        self.path.update([tag] if tag in KNOWN else [])
        self.names.update(names)
        self.hidden += hides
        self.sets = None

    def cut(self, n: int) -> None:
        """Closes the elements from the nth on."""
        while len(self.tags) > n:
            k, tag = len(self.tags) - 1, self.tags.pop()
            names, hides = self.more.pop()
            self.at[tag].pop()
            if not self.at[tag]:
                del self.at[tag]
            for kind in (self.breaking, self.hiding):
                if kind and kind[-1] == k:
                    kind.pop()
            for counter, values in ((self.names, names), (self.path, (tag,) if tag in KNOWN else ())):
                for x in values:
                    counter[x] -= 1
                    if not counter[x]:
                        del counter[x]
            self.hidden -= hides
        self.sets = None

    def last(self, tags: Iterable[str]) -> int:
        return max((self.at[t][-1] for t in tags if t in self.at), default=-1)

    def surroundings(self) -> tuple[frozenset[str], frozenset[str]]:
        if self.sets is None:
            self.sets = frozenset(self.path), frozenset(self.names)
        return self.sets


def tag_end(page: str, at: int) -> int:
    """Where a tag ends whose name ends at ``at``: behind its ">", or -1 if the page ends before.

    Quotation marks count where a value begins only; one that never closes counts as any other character.
    """
    size = len(page)
    while at < size:
        at = IN_TAG.match(page, at).end()
        if at >= size:
            return -1
        if page[at] == ">":
            return at + 1
        at = VALUE.match(page, at).end()
        if at < size and page[at] in "\"'":
            close = page.find(page[at], at + 1)
            if close < 0:
                rest = page.find(">", at)
                return rest + 1 or -1
            at = close + 1
    return -1


def blocks(page: str | None, names: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page in page order; broken markup is read as far as it goes.

    Time grows in proportion to the page, however it is nested or broken.  ``names``: those to keep (all,
    if None); a tag that the page's end cuts off is text.
    """
    out: list[Block] = []
    if not page:
        return out
    opened = _Open()
    text: list[str] = []
    links = 0

    def close_block() -> None:
        nonlocal links
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append(Block(whole, opened.tags[opened.breaking[-1]] if opened.breaking else "", *opened.surroundings(), links))
            text.clear()
        links = 0

    def end_head() -> None:
        while opened.tags and opened.tags[-1] == "head":
            opened.cut(len(opened.tags) - 1)

    def add(run: str) -> None:
        nonlocal links
        if opened.hidden and opened.tags[-1] == "head" and run.strip():
            end_head()
        if run and not opened.hidden:
            # References are decoded run by run: none forms across a tag.
            text.append(html.unescape(run))
            if "a" in opened.at:
                links += len(run)

    at = begin = 0
    size = len(page)
    while True:
        at = page.find("<", at)
        if at < 0 or at + 1 >= size:
            break
        mark = page[at + 1]
        closing = mark == "/"
        if mark == "!" or mark == "?":
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4) + 3
                end = end if end > 2 else size
            else:
                end = page.find(">", at) + 1
                if not end:
                    break
            add(page[begin:at])
            at = begin = end
            continue
        m = NAME.match(page, at + 1 + closing)
        if not m:
            at += 1
            continue
        end = tag_end(page, m.end())
        if end < 0:
            break
        add(page[begin:at])
        tag, inside = m[0].lower(), page[m.end() : end - 1]
        at = begin = end
        if closing:
            if tag in BREAKING and not opened.hidden:
                close_block()
            if tag in opened.at:
                opened.cut(opened.at[tag][-1])
            continue
        if tag == "br":
            if not opened.hidden:
                text.append(" ")
            continue
        if tag not in IN_HEAD:
            end_head()
        if tag in BREAKING:
            if not opened.hidden:
                close_block()
            # Inside a hidden element starts end what is open there, and a hidden one ends like any other.
            low = opened.hiding[-1] + 1 if opened.hidden and opened.hiding else 0
            if tag in CLOSES:
                n = opened.last(CLOSES[tag])
                if n >= low and n > opened.last(FENCES):
                    close_block()
                    opened.cut(n)
            n = opened.breaking[-1] if opened.breaking else -1
            if n >= low and n >= 0 and opened.tags[n] == "p":
                close_block()
                opened.cut(n)  # a paragraph ends where a block starts
        if tag in EMPTY or inside.endswith("/"):
            continue
        found: list[str] = []
        hides = tag in HIDDEN
        if inside:
            for a in ATTRIBUTE.finditer(inside):
                key = a[1].lower()
                if key == "hidden":
                    hides = True
                elif key == "style":
                    hides |= DISPLAY.findall(html.unescape(a[2] or a[3] or a[4] or "").lower())[-1:] == ["none"]
                elif key in ("class", "id", "role"):
                    found += NAME_PART.findall((a[2] or a[3] or a[4] or "").lower())
        if tag in RAW:
            close = RAW[tag].search(page, at)
            at = (page.find(">", close.end()) + 1 if close else size) or size
            begin = at
            continue
        opened.push(tag, tuple(x for x in found if names is None or x in names), hides)
    add(page[begin:])
    close_block()
    return out
