"""Labelled pages to learn from: layouts of invented text, each with the blocks that are its article.

An article stands in one of several containers, among menus, headers, footers, sidebars, notices, adverts, forms, links to more, and
comments, some of them inside the container. Names and tags vary; markup is sometimes careless.
"""

from __future__ import annotations

import random
from html import escape

CONTAINERS = ("article", "main", "div content", "div post", "div entry-content", "div articleBody", "div story", "section post-body", "div text", "div main-content", "td main", "div")
PARTS = {
    "header": ("header", "header site-header", "div header", "div masthead", "div banner", "div top", "div branding"),
    "menu": ("nav", "nav menu", "ul menu", "div navbar", "div navigation", "div breadcrumbs", "ol breadcrumb", "div nav-links", "nav toc", "div pagination"),
    "side": ("aside", "aside sidebar", "div sidebar", "div secondary", "td side", "div widget", "div widget-area", "section sidebar-right"),
    "advert": ("div ad", "div advert", "div ads", "div sponsored", "ins adsbygoogle", "aside advertisement", "div promo", "div promotion", "section sponsor", "div ad-slot", "p ad"),
    "notice": ("div cookie-notice", "div cookies", "div alert", "div notice", "div gdpr", "div consent", "dialog", "div popup", "div modal", "div newsletter", "div paywall", "aside notice",
               "section privacy-notice", "p notice", "div subscribe"),
    "form": ("form", "form search", "form login", "form signup", "div search-form", "form newsletter", "form contact"),
    "comments": ("section comments", "div comments", "div comment-list", "ol commentlist", "div responses", "div discussion", "section reader-comments", "div replies", "aside comments", "div disqus-thread"),
    "more": ("div related", "section recommended", "aside related-posts", "div more-stories", "div read-more", "ul related", "div teasers"),
    "share": ("div share", "ul social", "div sharing", "div tags", "div social-links", "p share"),
    "footer": ("footer", "footer site-footer", "div footer", "div colophon", "div copyright", "div legal", "div bottom"),
}
SYLLABLES = ("an be co da el fi go ha in ju ka le mo ni or pa qu re sa ti un ve wi yo", "о на ре ти ка во ла ми по ся ду ге", "的 一 是 在 人 有 我 他 这 中 大 来 上 国")


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.kind = self.r.choices((0, 1, 2), (8, 1, 1))[0]
        self.syllables = SYLLABLES[self.kind].split()
        self.careless = self.r.random() < 0.3
        self.loud = self.r.random() < 0.1

    def word(self) -> str:
        return "".join(self.r.choices(self.syllables, k=self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return ("" if self.kind == 2 else " ").join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        return self.words(3, 18).capitalize() + ("。" if self.kind == 2 else self.r.choice(".....!?"))

    def prose(self, low: int = 1, high: int = 8) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def open(self, spec: str) -> tuple[str, str]:
        tag, _, name = spec.partition(" ")
        tag = tag.upper() if self.loud else tag
        extra = f' {self.r.choice(("class", "id", "class"))}="{name}{self.r.choice(("", "", f" c{self.r.randint(1, 99)}"))}"' if name else ""
        return f"<{tag}{extra}>", f"</{tag}>"

    def wrap(self, spec: str, inner: str) -> str:
        a, b = self.open(spec)
        return a + inner + b

    def paragraph(self, tag: str, text: str) -> str:
        return f"<{tag}>{text}" + ("" if self.careless and tag in ("p", "li") else f"</{tag}>")

    def decorated(self, text: str) -> str:
        words = escape(text, quote=self.r.random() < 0.3).split(" ")
        if len(words) > 3 and self.r.random() < 0.3:
            k = self.r.randrange(len(words) - 1)
            a, b = self.r.choice((('<a href="/x">', "</a>"), ("<b>", "</b>"), ("<em>", "</em>"), ("<span>", "</span>"), ("<b>", "")))
            words[k] = a + words[k] + b
        return " ".join(words)

    def content(self) -> tuple[list[str], list[str]]:
        """Pieces of markup and the texts of their blocks."""
        parts, blocks = [], []

        def put(tag: str, text: str) -> str:
            blocks.append(text)
            return self.paragraph(tag, self.decorated(text))

        if self.r.random() < 0.8:
            head = put("h1", self.words(2, 12).capitalize())
            parts.append(self.wrap("header", head) if self.r.random() < 0.2 else head)
        for _ in range(self.r.choice((1, 2, 3, 5, 8, 14))):
            kind = self.r.random()
            if kind < 0.62:
                parts.append(put("p", self.prose() if self.r.random() < 0.85 else self.words(1, 6)))
            elif kind < 0.70:
                parts.append(put(self.r.choice(("h2", "h3")), self.words(1, 8).capitalize()))
            elif kind < 0.78:
                parts.append(self.wrap(self.r.choice(("ul", "ol")), "".join(put("li", self.words(1, 12) if self.r.random() < 0.5 else self.prose(1, 3)) for _ in range(self.r.randint(1, 6)))))
            elif kind < 0.84:
                parts.append(self.wrap("blockquote", put("p", self.prose(1, 4)) if self.r.random() < 0.5 else put("div", self.prose(1, 3))))
            elif kind < 0.88:
                parts.append(put("pre", self.words(2, 30)))
            elif kind < 0.92:
                parts.append(self.wrap("table", "".join(self.wrap("tr", "".join(put("td", self.words(1, 3)) for _ in range(3))) for _ in range(self.r.randint(1, 3)))))
            elif kind < 0.96:
                parts.append(self.wrap("figure", '<img src="/i.png">' + put("figcaption", self.words(3, 12))))
            else:
                parts.append(put("div", self.prose(1, 4)))
        if self.r.random() < 0.1:  # verse, dialogue, lists of names: many short blocks, some of them equal
            lines = [self.words(1, 3).capitalize() + "." for _ in range(self.r.randint(1, 20))]
            parts += [put("p", self.r.choice(lines)) for _ in range(self.r.randint(10, 120))]
        return parts, blocks

    def links(self, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{k}">{escape(self.words(1, 4))}</a></{tag}>' for k in range(self.r.randint(1, 8)))

    def part(self, kind: str) -> str:
        """A part that is not the article."""
        spec = self.r.choice(PARTS[kind])
        tag = spec.split(" ")[0]
        if kind == "menu":
            inner = self.links() if tag in ("ul", "ol") else self.wrap("ul", self.links()) if self.r.random() < 0.6 else self.links("span")
        elif kind == "header":
            inner = self.wrap(self.r.choice(("div", "p", "h1", "a", "h2")), self.words(1, 5)) + (f"<p>{self.words(2, 8)}</p>" if self.r.random() < 0.5 else "")
        elif kind == "side":
            inner = "".join(self.wrap(self.r.choice(("div", "section", "div widget")), f"<h3>{self.words(1, 3)}</h3>" + (self.wrap("ul", self.links()) if self.r.random() < 0.6 else f"<p>{self.prose(1, 4)}</p>"))
                            for _ in range(self.r.randint(1, 3)))
        elif kind in ("advert", "notice"):
            text = self.prose(1, 4)
            inner = text if tag == "p" or self.r.random() < 0.5 else f"<p>{text}</p>" + self.r.choice(("", "<button>ok</button>", '<a href="/more">more</a>'))
        elif kind == "form":
            inner = f'<label>{self.words(1, 3)}</label><input name="q">' + self.r.choice(("", f"<p>{self.prose(1, 2)}</p>", f"<div>{self.words(2, 8)}</div>", f"<select><option>{self.word()}</option></select>")) + "<button>go</button>"
        elif kind == "comments":
            one = self.r.choice(("div comment", "li comment", "article comment", "div reply", "p comment-text", "div"))
            inner = f"<h3>{self.words(1, 3)}</h3>" * (self.r.random() < 0.6)
            for _ in range(self.r.randint(1, 5)):
                inner += self.wrap(one, self.prose(1, 4) if one.startswith("p") else f"<b>{self.word()}</b>" + self.wrap("p", self.prose(1, 5)))
        elif kind == "more":
            inner = self.links() if tag == "ul" else f"<h3>{self.words(1, 4)}</h3>" + (self.wrap("ul", self.links()) if self.r.random() < 0.5 else "".join(
                self.wrap(self.r.choice(("article teaser", "div card")), f'<a href="/{k}"><h4>{self.words(3, 9)}</h4></a><p>{self.prose(1, 2)}</p>') for k in range(3)))
        elif kind == "share":
            inner = self.links() if tag == "ul" else " ".join(f'<a href="/{k}">{self.word()}</a>' for k in range(3))
        else:
            inner = self.r.choice((f"&copy; {self.words(1, 4)}", f"<p>&copy; 2020 {self.words(2, 8)}</p>", f"{self.prose(1, 3)}", self.wrap("ul", self.links()) + f"<p>{self.prose(1, 2)}</p>"))
        return self.wrap(spec, inner)

    def page(self) -> tuple[str, list[str]]:
        parts, blocks = self.content()
        for kind in ("advert", "comments", "share", "more", "notice", "side", "menu", "form", "footer"):
            if self.r.random() < 0.12:
                place = len(parts) if kind in ("comments", "share", "more", "footer", "form") else self.r.randint(0, len(parts))
                parts.insert(place, self.part(kind))
        spec = self.r.choice(CONTAINERS)
        body = self.wrap(spec, "".join(parts))
        if spec.startswith("td"):
            body = self.wrap("table", self.wrap("tr", (self.part("side") if self.r.random() < 0.5 else "") + body))
            body = body.replace("<aside", "<td><aside") if "<tr><aside" in body else body
        for _ in range(self.r.randint(0, 2)):
            body = self.wrap(self.r.choice(("div", "div wrapper", "div container", "section", "div row", "main")), body)
        much = self.r.choice((0, 0.3, 1, 1, 1, 1))  # some pages are little more than their article
        before = "".join(self.part(k) for k in ("header", "menu", "notice", "advert", "form") if self.r.random() < 0.5 * much)
        after = "".join(self.part(k) for k in ("comments", "more", "side", "advert", "form", "notice", "share", "footer") if self.r.random() < 0.4 * much)
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style></head>" if self.r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html>{head}<body>{before}{body}{after}" + ("" if self.careless else "</body></html>"), blocks


def labelled(pages: int, seed: int = 0) -> list[tuple[str, list[str]]]:
    return [Writer(seed * 1_000_003 + k).page() for k in range(pages)]
