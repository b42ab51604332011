"""Labelled pages to learn from: layouts drawn at random around an article whose place is known.

A page has an article (headings, paragraphs, lists, quotes, tables, figures; sometimes a single paragraph or none) somewhere
among menus, headers, sidebars, notices, adverts, forms, reader comments and footers.  Every part is written in
several ways: with the element made for it, or a plain div, with telling class names, odd ones or none, with closing
tags left out.  Words are random letters, so nothing of any language is learned.  The label of a part is the
attribute ``dom.LABEL`` of its outermost element, which no feature sees.
"""

from __future__ import annotations

import random
import re

from .dom import LABEL

_ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "aeioulnrstdé", "äöüßenrsticha", "абвгдежзиклмнопрст"]
# names that parts are given in class and id attributes
_NAMES = {
    "content": ["article", "article-body", "post-content", "entry", "story", "main", "main-content", "content", "page"],
    "menu": ["nav", "navbar", "main-menu", "navigation", "breadcrumb", "topnav", "menu-list"],
    "header": ["header", "site-header", "masthead", "top-banner", "branding"],
    "footer": ["footer", "site-footer", "page-foot", "copyright", "bottom"],
    "side": ["sidebar", "side", "widget", "related-posts", "right-rail", "more-stories", "trending"],
    "advert": ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "advertisement", "adBox"],
    "notice": ["cookie-banner", "notice", "gdpr", "consent-bar", "newsletter", "alert", "modal", "subscribe-box"],
    "comments": ["comments", "comment-list", "discussion", "replies", "user-comments", "responses"],
    "form": ["search-form", "login", "contact-form", "signup"],
    "social": ["share", "social-links", "share-buttons"],
}
_ODD = ["c1", "x-12", "wrap", "row", "col", "box", "inner", "container", "block", "section-a"]


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng
        letters = rng.choice(_ALPHABETS)
        self.words = ["".join(rng.choices(letters, k=rng.choice((1, 2, 3, 3, 4, 5, 6, 7, 9, 12)))) for _ in range(120)]
        self.marks = rng.random() < 0.15  # words with runs of symbols
        self.bars = rng.random() < 0.1  # words between bars
        self.names, self.open_tags = rng.random() < 0.85, rng.random() < 0.3

    def some(self, low: int, high: int) -> int:
        return self.rng.randint(low, high)

    def sentence(self, low: int = 3, high: int = 25) -> str:
        words = [self.rng.choice(self.words) for _ in range(self.some(low, high))]
        if self.marks:
            words = [w + self.rng.choice(("%%%", "***", "$$$", "&amp;&amp;", "###", "")) for w in words]
        if self.bars:
            return " | ".join(words)
        comma = self.rng.randrange(len(words))
        words[comma] += "," if comma < len(words) - 1 and self.rng.random() < 0.5 else ""
        return words[0].capitalize() + " " * (len(words) > 1) + " ".join(words[1:]) + self.rng.choice(("...!?" + "." * 20))

    def inline(self, text: str) -> str:
        words = text.split(" ")
        if len(words) > 4 and self.rng.random() < 0.3:
            i = self.rng.randrange(len(words) - 2)
            tag = self.rng.choice(('a href="/x"', "b", "em", "strong", "span", "code"))
            words[i], words[i + 1] = f"<{tag}>{words[i]}", f"{words[i + 1]}</{tag.split(' ')[0]}>"
        return " ".join(words)

    def text(self, low: int, high: int) -> str:
        return " ".join(self.inline(self.sentence()) for _ in range(self.some(low, high)))

    def attributes(self, kind: str, telling: float = 0.8) -> str:
        if not self.names:
            return ""
        if self.rng.random() < telling:
            name = self.rng.choice(_NAMES[kind])
            if self.rng.random() < 0.3:
                name = self.rng.choice((f"{name} {self.rng.choice(_ODD)}", f"{self.rng.choice(_ODD)}-{name}", f"js-{name}"))
        else:
            name = self.rng.choice(_ODD)
        return f' {self.rng.choice(("class", "class", "id"))}="{name}"'

    def part(self, tag: str, kind: str | None, inner: str, label: int | None = None, telling: float = 0.8) -> str:
        mark = "" if label is None else f' {LABEL}="{label}"'
        return f"<{tag}{self.attributes(kind, telling) if kind else ''}{mark}>{inner}</{tag}>"

    def p(self, text: str) -> str:
        if self.open_tags and self.rng.random() < 0.5:
            return self.rng.choice((f"<p>{text}", f"<p><b>{text}<br>", f"<p>{text}<br>"))
        return f"<p>{text}</p>"

    def links(self, low: int = 2, high: int = 12) -> str:
        items = [f'<a href="/{w}">{w}</a>' for w in
                 (" ".join(self.rng.choices(self.words, k=self.some(1, 4))) for _ in range(self.some(low, high)))]
        if self.rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.rng.choice((" | ", " ", " &middot; ")).join(items)

    # ---- parts that aren't the article

    def menu(self) -> str:
        return self.part(*(("nav", None) if self.rng.random() < 0.5 else ("div", "menu")), self.links(), 0)

    def header(self) -> str:
        inner = self.rng.choice((f'<a href="/">{self.sentence(1, 3)}</a>', f"<h1>{self.sentence(1, 4)}</h1>",
                                 f"<div>{self.sentence(2, 8)}</div>", self.p(self.sentence(2, 9))))
        inner += self.links(2, 6) if self.rng.random() < 0.4 else ""
        inner += self.form() if self.rng.random() < 0.2 else ""
        return self.part(*(("header", None) if self.rng.random() < 0.5 else ("div", "header")), inner, 0)

    def footer(self) -> str:
        inner = self.rng.choice(("&copy; 2020 ", "&copy; ", "")) + self.sentence(1, 6)
        inner += self.rng.choice((" &middot; ", " | ", " ")) + self.rng.choice((self.text(1, 3), self.links(2, 8), ""))
        inner = self.p(inner) if self.rng.random() < 0.4 else inner
        return self.part(*(("footer", None) if self.rng.random() < 0.6 else ("div", "footer")), inner, 0)

    def side(self) -> str:
        inner = "".join(f"<h3>{self.sentence(1, 4)}</h3>" + self.rng.choice((self.links(), self.p(self.text(1, 3)),
                        self.links() + self.p(self.sentence()))) for _ in range(self.some(1, 3)))
        return self.part(*(("aside", None) if self.rng.random() < 0.4 else (self.rng.choice(("div", "section")), "side")),
                         inner, 0)

    def advert(self) -> str:
        inner = self.rng.choice((self.text(1, 3), self.p(self.text(1, 2)), f'<a href="/buy">{self.text(1, 1)}</a>',
                                 f'<img src="x.png">{self.sentence()}'))
        return f"<!-- ad {self.some(0, 9)} -->" * self.some(0, 1) + self.part(
            self.rng.choice(("div", "div", "aside", "section")), "advert", inner, 0, 1.0)

    def notice(self) -> str:
        inner = self.rng.choice((self.text(1, 3), self.p(self.text(1, 3)))) + self.rng.choice(
            ("", f"<button>{self.sentence(1, 2)}</button>", f'<a href="/ok">{self.sentence(1, 2)}</a>'))
        return self.part(self.rng.choice(("div", "div", "section", "dialog", "aside")), "notice", inner, 0, 1.0)

    def form(self) -> str:
        fields = "".join(f'<label>{self.sentence(1, 3)}</label><input name="{i}">' for i in range(self.some(1, 4)))
        inner = (self.p(self.sentence()) if self.rng.random() < 0.4 else "") + fields + "<button>Ok</button>"
        form = self.part("form", "form", inner, 0)
        return self.part("div", "form", f"<h3>{self.sentence(1, 5)}</h3>" + form, 0) if self.rng.random() < 0.3 else form

    def comments(self) -> str:
        one = lambda: self.rng.choice((
            f'<div class="comment"><b>{self.sentence(1, 2)}</b>{self.p(self.text(1, 4))}</div>',
            f"<li><div>{self.sentence(1, 3)}</div><p>{self.text(1, 4)}</p></li>",
            f'<article class="comment-item"><p>{self.text(1, 3)}</p></article>', f"<div>{self.text(1, 3)}</div>"))
        inner = "".join(one() for _ in range(self.some(1, 8)))
        if inner.startswith("<li>") or self.rng.random() < 0.3:
            inner = f"<ol>{inner}</ol>"
        inner = f"<h2>{self.sentence(1, 4)}</h2>" * self.some(0, 1) + inner
        return self.part(self.rng.choice(("section", "div", "div", "ul")), "comments", inner, 0, 1.0)

    def share(self) -> str:
        return self.part("div", "social", self.links(2, 5), 0, 1.0)

    # ---- the article

    def block(self) -> str:
        kind = self.rng.random()
        if kind < 0.74:
            return self.p(self.text(1, self.rng.choice((1, 2, 4, 8))))
        if kind < 0.82:
            return self.rng.choice(("<h2>{}</h2>", "<h3>{}</h3>")).format(self.sentence(1, 8))
        if kind < 0.89:
            tag = self.rng.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{self.inline(self.sentence(2, 16))}</li>" for _ in range(self.some(2, 7))) + f"</{tag}>"
        if kind < 0.93:
            return f"<blockquote>{self.p(self.text(1, 3))}</blockquote>"
        if kind < 0.95:
            return f"<pre>{self.sentence()}\n  {self.sentence()}</pre>"
        if kind < 0.97:
            rows = "".join("<tr>" + "".join(f"<td>{self.sentence(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.some(2, 4)))
            return f"<table>{rows}</table>"
        return f'<figure><img src="i.png"><figcaption>{self.sentence()}</figcaption></figure>'

    def article(self) -> str:
        blocks = [self.block() for _ in range(self.rng.choice((0, 1, 1, 2, 3, 5, 8, 14, 30)))]
        if not blocks or self.rng.random() < 0.3:
            blocks.insert(0, self.p(self.text(1, 6)))
        for _ in range(self.rng.choice((0, 0, 0, 1, 2)) if len(blocks) > 1 else 0):
            blocks.insert(self.some(1, len(blocks)), self.rng.choice((self.advert, self.share, self.notice, self.side))())
        if self.rng.random() < 0.8:
            blocks.insert(0, self.rng.choice(("<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>")).format(self.sentence(2, 14)))
        if self.rng.random() < 0.15:
            blocks.append(self.rng.choice((self.comments, self.side, self.share, self.form))())
        kind = self.rng.random()
        if kind < 0.06:  # blocks with no element around them
            return "".join(b if LABEL in b.split(">", 1)[0] else re.sub(r"^<(\w+)", rf'<\1 {LABEL}="1"', b) for b in blocks)
        inner = "".join(blocks)
        if kind < 0.45:
            return self.part("article", "content" if self.rng.random() < 0.4 else None, inner, 1)
        if kind < 0.6:
            return self.part("main", "content" if self.rng.random() < 0.4 else None, inner, 1)
        return self.part(self.rng.choice(("div", "div", "div", "section", "td")), "content", inner, 1)

    def page(self) -> str:
        often = lambda share, part: part() if self.rng.random() < share else ""
        middle = [often(0.3, self.side), often(0.35, self.advert), often(0.95, self.article), often(0.25, self.share),
                  often(0.35, self.comments), often(0.35, self.side), often(0.15, self.form)]
        inner = "".join(middle)
        for _ in range(self.rng.choice((0, 0, 1, 2))):
            inner = self.part(self.rng.choice(("div", "div", "main", "section")), "content", inner, None, 0.3)
        if self.rng.random() < 0.04:  # nothing but the article
            return f"<body>{self.article()}</body>"
        head = [often(0.3, self.notice), often(0.5, self.header), often(0.75, self.menu), often(0.15, self.advert)]
        self.rng.shuffle(head)
        body = "".join(head) + inner + often(0.15, self.form) + often(0.8, self.footer) + often(0.2, self.notice)
        top = (f"<!DOCTYPE html><html><head><title>{self.sentence()}</title><style>p{{margin:0}}</style>"
               f'<script>var t="</p>";</script></head>') if self.rng.random() < 0.8 else ""
        return f"{top}<body>{body}</body></html>"


def labelled_page(seed: int) -> str:
    """The page of this number: the same for every run."""
    return _Writer(random.Random(seed)).page()
