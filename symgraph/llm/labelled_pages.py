"""Labelled pages to learn from: layouts as sites commonly build them, filled with made-up words.

data-mark names the label of a subtree: main for the article, rest for all else.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi xo zu än ère ción ñar".split()
# Names that sites give the parts of a page.
MAIN_NAMES = ["content", "article-body", "post", "entry-content", "story", "main-content", "post-content", "text", "article", "body-copy", "page-content", ""]
REST_NAMES = {
    "nav": ["nav", "navbar", "menu", "main-menu", "navigation", "breadcrumb", "breadcrumbs", "topnav", "tabs", "pagination", "toc"],
    "header": ["header", "masthead", "site-header", "top", "banner", "branding", "logo"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "legal", "colophon"],
    "aside": ["sidebar", "widget", "related", "side", "aside", "rail", "recommended", "popular", "tags", "share", "social"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "sponsor", "banner-ad"],
    "notice": ["notice", "cookie", "cookie-notice", "consent", "gdpr", "alert", "message", "warning", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall"],
    "comments": ["comments", "comment-list", "comment", "discussion", "responses", "replies", "disqus", "respond"],
    "form": ["form", "search", "search-form", "login", "contact"],
}


class _Maker:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.paragraph = "p"

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(lo, hi)))

    def sentence(self) -> str:
        return self.words(3, 18).capitalize() + self.rng.choice(["."] * 8 + ["!", "?", ""])

    def prose(self, lo: int = 1, hi: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(lo, hi)))

    def links(self, lo: int = 2, hi: int = 8) -> str:
        return "".join(f'<li><a href="/{self.word()}">{self.words(1, 3)}</a></li>' for _ in range(self.rng.randint(lo, hi)))

    def inline(self, text: str) -> str:
        kind = self.rng.random()
        if kind < 0.15:
            return f"<b>{text}" + self.rng.choice(["", "</b>"])
        if kind < 0.3:
            return f'{text} <a href="/x">{self.words(1, 3)}</a> {self.words(1, 5)}.'
        if kind < 0.4:
            return f"{self.words(1, 4)} <em>{text}</em><br>{self.words(1, 6)}"
        return text

    def attrs(self, names: list[str]) -> str:
        name = self.rng.choice(names)
        return "" if not name else self.rng.choice([f' class="{name}"', f' id="{name}"', f' class="{self.word()} {name}"'])

    def paragraphs(self) -> str:
        out = []
        for _ in range(self.rng.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            kind = self.rng.random()
            if kind < 0.72:
                short = self.rng.random() < 0.2
                inner = self.inline(self.words(1, 4) if short else self.prose())
                if self.paragraph == "p":
                    out.append(f"<p>{inner}" + self.rng.choice(["</p>", "</p>", "</p>", ""]))
                else:
                    out.append(f"<div>{inner}</div>" if self.paragraph == "div" else f"{inner}<br><br>")
            elif kind < 0.8:
                out.append(f"<h{(n := self.rng.randint(2, 4))}>{self.words(1, 6)}</h{n}>")
            elif kind < 0.87:
                out.append("<ul>" + "".join(f"<li>{self.prose(1, 2)}</li>" for _ in range(self.rng.randint(1, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote>{self.prose()}</blockquote>")
            elif kind < 0.96:
                out.append(f"<table><tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr></table>")
            else:
                out.append(f"<pre><code>{self.words(2, 12)}</code></pre>")
        return "".join(out)

    def rest(self, kind: str) -> str:
        """A part of the page that is not the article, by element or by name."""
        if kind == "nav":
            inner = self.rng.choice([f"<ul>{self.links()}</ul>", f"<ul>{self.links()}</ul>", f'<a href="/">{self.word()}</a> » <a href="/x">{self.word()}</a>', f"<ul><li>{self.word()}</li><li>{self.words(1, 2)}</li></ul>"])
        elif kind == "footer":
            inner = self.rng.choice([f"&copy; {self.word()}.example.com &middot; {self.prose(1, 2)}", f"<p>© 2024 {self.words(1, 4)}</p><ul>{self.links(1, 4)}</ul>", f"<p>{self.prose(1, 2)}</p>", self.prose(1, 3), f"Copyright 2021 {self.words(1, 3)}"])
        elif kind == "header":
            inner = self.rng.choice([f"<h1>{self.words(1, 3)}</h1><p>{self.words(2, 6)}</p>", f'<a href="/">{self.words(1, 2)}</a>', f"<div>{self.prose(1, 1)}</div>"])
        elif kind == "comments":
            inner = f"<h3>{self.words(1, 2)}</h3>" + "".join(f'<div{self.attrs(["comment", "reply", "comment-body"])}><p>{self.inline(self.prose(1, 4))}</p></div>' for _ in range(self.rng.randint(1, 4)))
        elif kind == "form":
            inner = f"<label>{self.words(1, 2)}</label><input type=text><select><option>{self.word()}<option>{self.word()}</select><button>{self.word()}</button>" + self.rng.choice(["", f"<p>{self.prose(1, 1)}</p>"])
        else:
            inner = self.rng.choice([self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>", f"<h3>{self.words(1, 3)}</h3><ul>{self.links(1, 5)}</ul>", f"<p>{self.inline(self.prose(1, 2))}</p>"])
        tags = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "comments": ["section", "div"], "form": ["form"]}.get(kind, ["div", "div", "section", "p"])
        tag = self.rng.choice(tags)
        named = tag in ("nav", "header", "footer", "aside", "form") and self.rng.random() < 0.6
        attrs = "" if named else self.attrs(REST_NAMES[kind])
        return f'<{tag}{attrs} data-mark="rest">{inner}</{tag}>'

    def table(self, body: str) -> str:
        """A layout of cells: the article in one, menus, side columns and the site's last line in others, or alone."""
        cell = f'<td data-mark="main">{body}</td>'
        menu = self.rng.choice([f'<a href="/">{self.word()}</a> ' * self.rng.randint(1, 5), f"<ul>{self.links(1, 5)}</ul>", f'<a href="/">{self.word()}</a> | <a href="/x">{self.words(1, 2)}</a>'])
        side = self.rng.choice([f"<ul>{self.links(1, 6)}</ul>", f"<h3>{self.words(1, 3)}</h3><ul>{self.links(1, 5)}</ul>"])
        last = self.rng.choice([f"Copyright {self.rng.randint(1995, 2030)} {self.words(1, 3)}", f"© {self.rng.randint(1995, 2030)} {self.words(1, 4)}", f"&copy; {self.words(1, 3)}. {self.words(2, 4)}."])
        rest = lambda inner: f'<td data-mark="rest">{inner}</td>'
        row = self.rng.choice([cell, cell, rest(side) + cell, cell + rest(side)])
        above = f"<tr>{rest(menu)}</tr>" if self.rng.random() < 0.6 else ""
        below = f"<tr>{rest(last)}</tr>" if self.rng.random() < 0.6 else ""
        return f"<table>{above}<tr>{row}</tr>{below}</table>"

    def page(self) -> str:
        rng = self.rng
        self.paragraph = rng.choice(["p"] * 7 + ["div"] * 2 + ["br"])
        title = self.words(1, 12).capitalize()
        heading = f"<h1>{title}</h1>" if rng.random() < 0.85 else ""
        shape = rng.random()
        if heading and shape < 0.52 and rng.random() < 0.35:  # a header of its own has an article or main around it
            heading = f"<header>{heading}" + (f"<p>{self.words(2, 6)}</p>" if rng.random() < 0.4 else "") + "</header>"
        body = heading + self.paragraphs()
        within = rng.random()
        if within < 0.25:  # parts inside the article that are not of it
            body += self.rest(rng.choice(["ad", "aside", "comments", "form", "notice", "nav"])) + (f"<p>{self.prose()}</p>" if rng.random() < 0.5 else "")
        whole = ""
        if shape < 0.4:
            main = f'<article{self.attrs(["", *MAIN_NAMES])} data-mark="main">{body}</article>'
        elif shape < 0.52:
            main = f'<main data-mark="main">{body}</main>'
        elif shape < 0.72:
            main = f'<div{self.attrs(MAIN_NAMES[:-1])} data-mark="main">{body}</div>'
        elif shape < 0.86:  # layouts that name nothing
            main = f'<div data-mark="main">{body}</div>'
        elif shape < 0.93:
            main = self.table(body)
        else:
            main, whole = body, ' data-mark="main"'
        if rng.random() < 0.3:
            main = f'<div{self.attrs(["wrapper", "container", "page", "row", "site", "layout"])}>{main}</div>'
        before = [self.rest(k) for k in ("header", "nav", "notice", "ad", "form", "aside") if rng.random() < 0.45]
        after = [self.rest(k) for k in ("comments", "aside", "ad", "notice", "form", "nav") if rng.random() < 0.3]
        if rng.random() < 0.85:
            after.append(self.rest("footer"))
        if rng.random() < 0.1:
            before, after = [], []
        rng.shuffle(before)
        end = rng.choice(["</body></html>", "</body></html>", ""])
        return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style></head><body{whole}>{''.join(before)}{main}{''.join(after)}{end}"


def labelled_pages(n: int, seed: int) -> Iterator[str]:
    maker = _Maker(random.Random(seed))
    for _ in range(n):
        yield maker.page()
