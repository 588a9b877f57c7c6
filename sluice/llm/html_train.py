"""Labelled training pages for the HTML extractor, made by rule: no real page is needed.

Each page is drawn from a family of layouts (article element, main element, named divs, bare body) with boxes around and
inside the article: menus, headers, footers, sidebars, notices, adverts, forms, comments. Content elements are marked
by the attribute ``data-y="1"``, all others by ``data-y="0"``; the extractor's features do not look at it.
"""

from __future__ import annotations

import random

#: Names that pages give their boxes, by kind of box.
NAMES = {
    "content": ["article", "content", "post", "entry", "story", "main-content", "article-body", "post-content", "entry-content", "text", "body-text", "page-content"],
    "menu": ["nav", "menu", "navbar", "main-menu", "navigation", "breadcrumb", "breadcrumbs", "toc", "tabs", "pagination", "pager"],
    "header": ["header", "masthead", "top", "topbar", "site-header", "branding", "logo"],
    "footer": ["footer", "site-footer", "bottom", "colophon", "copyright", "legal"],
    "sidebar": ["sidebar", "aside", "rail", "widget", "related", "recommended", "popular", "more-stories", "secondary"],
    "notice": ["cookie", "cookie-notice", "consent", "notice", "alert", "gdpr", "popup", "modal", "newsletter-box", "paywall"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "adbox", "ad-slot"],
    "form": ["form", "search", "login", "subscribe", "signup", "newsletter", "contact-form", "search-box"],
    "comments": ["comments", "comment", "comment-list", "discussion", "replies", "respond", "disqus", "user-comments"],
    "share": ["share", "social", "share-buttons", "tools", "social-links", "follow"],
}
_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi wo za an el is or un".split()


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.fields = random.Random(-seed)  # of its own, so that pages are otherwise the same with and without fields

    def words(self, low: int, high: int) -> str:
        r, out = self.r, []
        for _ in range(r.randint(low, high)):
            w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
            out.append(w + r.choice(["", "", "", "", "", ",", "."]))
        out[0] = out[0].capitalize()
        return " ".join(out) + r.choice([".", ".", ".", ""])

    def attributes(self, kind: str | None, y: int, role: str = "") -> str:
        r, given = self.r, ""
        if kind and r.random() < 0.8:
            name = r.choice(NAMES[kind])
            if r.random() < 0.3:
                name += r.choice(["-wrap", "-1", " clearfix", "_box", "-inner", " col-8"])
            given = f' {r.choice(["class", "class", "id"])}="{name}"'
        elif r.random() < 0.3:
            given = f' class="{r.choice(["row", "col", "box", "block", "inner", "wrap", "container", "section"])}"'
        return f'{given}{role} data-y="{y}"'

    def links(self, n: int) -> str:
        return "<ul data-y=\"0\">" + "".join(f'<li data-y="0"><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(n)) + "</ul>"

    def field(self) -> str:
        """Nothing, or a part of a form."""
        word = lambda: "".join(self.fields.choice(_SYLLABLES) for _ in range(3))
        return self.fields.choice(["", "", f'<select data-y="0"><option data-y="0">{word()}<option data-y="0">{word()}</select>', f'<textarea data-y="0">{word()} {word()}</textarea>', f'<button data-y="0">{word()}</button>'])

    def box(self, kind: str) -> str:
        r = self.r
        p = lambda low, high: f'<p data-y="0">{self.words(low, high)}</p>'
        inner = {
            "menu": lambda: self.links(r.randint(2, 10)),
            "header": lambda: r.choice([f'<a href="/">{self.words(1, 3)}</a>', f'<h2 data-y="0">{self.words(1, 4)}</h2>{self.links(3)}', f'<div data-y="0">{self.words(2, 8)}</div>']),
            "footer": lambda: r.choice([f"&copy; {self.words(1, 8)}", self.words(3, 12), self.links(4) + p(3, 15), p(3, 20)]),
            "sidebar": lambda: f'<h3 data-y="0">{self.words(1, 4)}</h3>' + r.choice([self.links(r.randint(2, 8)), p(8, 40), p(4, 20) + p(4, 20)]),
            "notice": lambda: r.choice([self.words(5, 30), p(5, 40) + '<button data-y="0">Ok</button>']),
            "advert": lambda: r.choice([self.words(3, 25), f'<a href="/x">{self.words(2, 12)}</a>', p(3, 25)]),
            "form": lambda: self.field() + f'<label>{self.words(1, 3)}</label><input name="q"><button data-y="0">{self.words(1, 2)}</button>' + r.choice(["", p(3, 15)]),
            "comments": lambda: f'<h3 data-y="0">{self.words(1, 3)}</h3>' + "".join(f'<div{self.attributes("comments", 0)}>{r.choice([p(5, 60), self.words(5, 60), p(3, 40) + p(3, 30)])}</div>' for _ in range(r.randint(1, 6))),
            "share": lambda: "".join(f'<a href="/{i}">{self.words(1, 2)}</a> ' for i in range(r.randint(2, 5))),
        }[kind]()
        tag = {"menu": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "sidebar": ["aside", "aside", "div", "section"], "notice": ["div", "section", "aside"], "advert": ["div", "aside", "section"], "form": ["form", "form", "div"], "comments": ["section", "div", "div"], "share": ["div", "ul", "p"]}[kind]
        tag = r.choice(tag)
        named = kind if tag in ("div", "section", "ul", "p") and r.random() < 0.97 or r.random() < 0.6 else None
        return f"<{tag}{self.attributes(named, 0).replace(' data-y', ' data-y', 1)}>{inner}</{tag}>"

    def content(self) -> str:
        r = self.r
        out = [f'<h1 data-y="1">{self.words(2, 12)}</h1>'] if r.random() < 0.9 else []
        if out and r.random() < 0.15:
            out = [f'<header data-y="1">{out[0]}</header>']
        size = r.choice([(1, 3), (2, 7), (3, 12), (5, 40), (20, 120), (60, 300)])
        for _ in range(r.choice([1, 1, 2, 4, 8, 15])):
            kind = r.random()
            if kind < 0.75:
                bold = r.random() < 0.15
                out.append(f'<p data-y="1">{"<b>" if bold else ""}{self.words(*size)}' + (self.field() if self.fields.random() < 0.08 else "") + ("<br>" if bold else "</p>" if r.random() < 0.95 else ""))
            elif kind < 0.82:
                out.append(f'<h2 data-y="1">{self.words(1, 8)}</h2>')
            elif kind < 0.88:
                out.append('<ul data-y="1">' + "".join(f'<li data-y="1">{self.words(2, 20)}</li>' for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.92:
                out.append(f'<blockquote data-y="1"><p data-y="1">{self.words(5, 40)}</p></blockquote>')
            elif kind < 0.95:
                out.append(f'<div data-y="1">{self.words(5, 60)}</div>')
            elif kind < 0.97:
                out.append('<table data-y="1">' + "".join(f'<tr data-y="1"><td data-y="1">{self.words(1, 4)}</td><td data-y="1">{self.words(1, 4)}</td></tr>' for _ in range(3)) + "</table>")
            else:
                out.append(f'<pre data-y="1">{self.words(4, 30)}</pre>')
        for kind in r.sample(["advert", "sidebar", "form", "share", "notice", "menu", "comments"], r.choice([0, 0, 1, 2])):
            out.insert(len(out) if kind == "comments" else r.randint(min(1, len(out)), len(out)), self.box(kind))
        return "".join(out)

    def html(self) -> str:
        r = self.r
        layout = r.random()
        inside = self.content()
        if layout < 0.4:
            inside = f"<article{self.attributes('content' if r.random() < 0.4 else None, 1)}>{inside}</article>"
            if r.random() < 0.3:
                inside = f"<main{self.attributes(None, 1)}>{inside}</main>"
        elif layout < 0.6:
            inside = f"<main{self.attributes('content' if r.random() < 0.4 else None, 1)}>{inside}</main>"
        elif layout < 0.9:
            inside = f"<div{self.attributes('content', 1)}>{inside}</div>"
            if r.random() < 0.4:
                inside = f"<div{self.attributes('content', 1)}>{inside}</div>"
        before = [self.box(k) for k in r.sample(["menu", "header", "notice", "advert", "form"], r.randint(1, 4))]
        after = [self.box(k) for k in r.sample(["sidebar", "comments", "advert", "share", "form", "menu", "notice"], r.choice([0, 0, 1, 2, 3]))] + ([self.box("footer")] if r.random() < 0.95 else [])
        if r.random() < 0.2:
            before.append(self.box("sidebar"))
        page = "".join(before) + inside + "".join(after)
        if r.random() < 0.35:
            page = f'<div class="{r.choice(["wrapper", "page", "container", "site"])}" data-y="0">{page}</div>'
        return f"<html><head><title>{self.words(2, 8)}</title></head><body data-y=\"0\">{page}</body></html>"


def pages(n: int, seed: int) -> list[str]:
    return [_Page(seed * 1_000_003 + i).html() for i in range(n)]
