"""Labelled pages to train extraction on: made-up layouts whose main text is known by construction."""

from __future__ import annotations

import html
import random

# Names that page authors give to the parts of a page; fixed values of the training pages.
MAIN_NAMES = ["content", "post", "entry", "story", "article-body", "main-text", "post-content", "page-body", "text", ""]
ASIDE_NAMES = ["sidebar", "aside", "widget", "related", "recommended", "popular", "tags", "archive"]
NOTICE_NAMES = ["cookie-notice", "consent", "banner", "alert", "newsletter", "subscribe", "popup", "paywall"]
AD_NAMES = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot"]
COMMENT_NAMES = ["comments", "comment", "discussion", "replies", "disqus", "respond"]
MENU_NAMES = ["menu", "nav", "navbar", "breadcrumb", "topbar", "pagination", "links"]
FOOTER_NAMES = ["footer", "bottom", "copyright", "legal", "colophon"]
HEADER_NAMES = ["header", "masthead", "logo", "top", "branding"]
SHARE_NAMES = ["share", "social", "meta", "byline", "toolbar"]


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.html, self.main = rng, [], []

    def words(self, low: int, high: int) -> str:
        r = self.rng
        n = r.randint(low, high)
        out = ["".join(r.choice("aeiou" if k % 2 else "bcdfghlmnprst") for k in range(r.randint(2, 9))) for _ in range(n)]
        for k in range(n):
            if r.random() < 0.08:
                out[k] += r.choice(".,.,;:!?")
        out[0] = out[0].capitalize()
        return " ".join(out) + (r.choice(["...", ".", "!", "?"]) if r.random() < 0.8 else "")

    def put(self, raw: str) -> None:
        self.html.append(raw)

    def block(self, tag: str, text: str, main: bool, inner: str = "{}") -> None:
        close = "" if tag in ("p", "li") and self.rng.random() < 0.15 else f"</{tag}>"
        self.put(f"<{tag}>" + inner.format(html.escape(text, quote=False)) + close)
        if main:
            self.main.append(" ".join(text.split()))

    def named(self, tag: str, names: list[str]) -> str:
        name = self.rng.choice(names)
        if not name:
            return f"<{tag}>"
        return f'<{tag} {self.rng.choice(["class", "class", "id"])}="{name}">'


def _menu(p: _Page) -> None:
    r = p.rng
    tag, names = r.choice([("nav", [""]), ("nav", MENU_NAMES), ("div", MENU_NAMES), ("ul", MENU_NAMES), ("header", HEADER_NAMES)])
    p.put(p.named(tag, names) + "<ul>")
    for _ in range(r.randint(2, 9)):
        p.block("li", p.words(1, 3), False, '<a href="/x">{}</a>')
    p.put(f"</ul></{tag}>")


def _side(p: _Page, tags: list[str], names: list[str], low: int, high: int, blocks: int, link: float = 0.3) -> None:
    r = p.rng
    tag = r.choice(tags)
    own = tag in ("aside", "footer", "header", "form") and r.random() < 0.5
    p.put(f"<{tag}>" if own else p.named(tag, names))
    for _ in range(r.randint(1, blocks)):
        text, bare = p.words(low, high), r.random() < 0.35
        inner = '<a href="#">{}</a>' if r.random() < link else "{}"
        if bare:
            p.put(inner.format(html.escape(text, quote=False)))
        else:
            p.block(r.choice(["p", "p", "div", "li", "span", "h3"]), text, False, inner)
    if tag == "footer" or "copyright" in p.html[-1]:
        p.put("&copy; 2020 &middot; " + p.words(1, 12))
    p.put(f"</{tag}>")


def _body(p: _Page) -> None:
    r = p.rng
    if r.random() < 0.85:
        p.block(r.choice(["h1", "h1", "h2"]), p.words(1, 12), True)
    if r.random() < 0.15:
        _side(p, ["div", "p"], SHARE_NAMES, 1, 6, 2, 0.6)
    for k in range(r.randint(1, 14)):
        kind = r.random()
        if kind < 0.06:
            p.block("h2", p.words(1, 8), True)
        elif kind < 0.14:
            tag = r.choice(["ul", "ol"])
            p.put(f"<{tag}>")
            for _ in range(r.randint(2, 6)):
                p.block("li", p.words(1, 25), True)
            p.put(f"</{tag}>")
        elif kind < 0.19:
            p.put("<blockquote>")
            p.block("p", p.words(3, 40), True)
            p.put("</blockquote>")
        elif kind < 0.23:
            _side(p, ["div", "aside"], AD_NAMES, 1, 30, 2)
        else:
            low, high = r.choice([(1, 4), (3, 15), (10, 60), (40, 160)])
            p.block("p", p.words(low, high), True, r.choice(["{}", "{}", "{}", "<b>{}", "<b>{}</b>", "<em>{}</em>", "{}<br>"]))


def labelled_page(seed: int) -> tuple[str, list[str]]:
    """A page and the blocks of its main text."""
    r = random.Random(seed)
    p = _Page(r)
    p.put(f"<!DOCTYPE html><html><head><title>{p.words(1, 9)}</title><style>p{{margin:0}}</style></head><body>")
    parts = [_menu] * r.randint(0, 2)
    parts += [lambda q: _side(q, ["div", "section"], NOTICE_NAMES, 3, 30, 2)] * (r.random() < 0.4)
    parts += [lambda q: _side(q, ["div", "aside", "section"], AD_NAMES, 1, 35, 2)] * r.choice([0, 1, 1, 2])
    parts += [lambda q: _side(q, ["header", "div"], HEADER_NAMES, 1, 10, 2, 0.5)] * (r.random() < 0.4)
    before = [x for x in parts]
    r.shuffle(before)
    bare = seed % 12 == 11  # some pages are an article alone
    for part in [] if bare else before:
        part(p)
    wraps = r.choice([["article"], ["main"], ["main", "article"], ["div"], ["div", "div"], ["section"], ["article", "div"], ["table", "tr", "td"]])
    for t in wraps:
        p.put(p.named(t, MAIN_NAMES) if t in ("div", "section", "main") else f"<{t}>")
    _body(p)
    comments_inside = r.random() < 0.2
    comments = lambda: _side(p, ["div", "section", "ul", "ol"], COMMENT_NAMES, 2, 60, 5, 0.15)
    if comments_inside and not bare:
        comments()
    for t in reversed(wraps):
        p.put(f"</{t}>")
    after = [comments] * (not comments_inside and r.random() < 0.4)
    after += [lambda: _side(p, ["aside", "div"], ASIDE_NAMES, 1, 30, 4, 0.6)] * (r.random() < 0.5)
    after += [lambda: _side(p, ["form", "div"], ["form", "search", "contact", "login"], 1, 12, 3, 0.1)] * (r.random() < 0.3)
    after += [lambda: _side(p, ["div"], AD_NAMES, 1, 35, 2)] * (r.random() < 0.3)
    r.shuffle(after)
    for part in [] if bare else after:
        part()
    if not bare and r.random() < 0.9:
        _side(p, ["footer", "footer", "div"], FOOTER_NAMES, 2, 25, 3, 0.3)
    if r.random() < 0.8:
        p.put("</body></html>")
    return "".join(p.html), p.main
