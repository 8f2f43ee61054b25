"""Labelled pages to train the extraction model on: page layouts drawn from a seed, with every block's label known.

The public corpus has no labelled pages, so layouts are composed from common ones: site headers, menus, side bars, notices, adverts,
forms, reader comments and footers around (and inside) an article of headings, paragraphs, lists, quotations and tables. Words are
random letters: the model can learn from tags, attribute names and the shape of the text, not from a vocabulary.
"""

from __future__ import annotations

import random

# Attribute words commonly given to parts of pages.
PARTS = {
    "menu": ["nav", "menu", "navbar", "navigation", "breadcrumbs", "topnav", "pagination", "tabs", "submenu", "toc"],
    "header": ["header", "masthead", "banner", "top", "branding", "logo", "site", "topbar", "hero"],
    "footer": ["footer", "bottom", "copyright", "legal", "colophon", "foot", "credits", "siteinfo"],
    "side": ["sidebar", "side", "widget", "related", "tags", "popular", "trending", "recommended", "archive", "rail", "aside", "more"],
    "notice": ["cookie", "notice", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "paywall", "disclaimer", "privacy", "warning"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "sponsor", "adbox", "adsense", "commercial", "partner"],
    "comments": ["comments", "comment", "commentlist", "disqus", "respond", "replies", "discussion", "reply", "thread", "reader"],
    "share": ["share", "social", "sharing", "follow", "buttons", "toolbar", "actions"],
}
CONTENT = ["content", "post", "entry", "article", "story", "body", "main", "text", "page", "single", "prose", "copy"]
NEUTRAL = ["row", "col", "wrap", "container", "inner", "box", "block", "module", "section", "clearfix", "c1", "x9"]


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.html, self.labels = rng, [], []
        self.letters = rng.choice(["abcdefghilmnoprstu", "aeioußäüönrstdh", "éèàêçaeiounrstl", "абвгдеиклмнорст", "日本語文字漢水木火土"])
        self.named = rng.random() < 0.8  # whether parts carry telling attributes

    def word(self) -> str:
        return "".join(self.rng.choices(self.letters, k=self.rng.randint(1, 9)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentence(self) -> str:
        w = self.words(3, 18).split()
        if len(w) > 6 and self.rng.random() < 0.6:
            w[len(w) // 2] += ","
        return " ".join(w).capitalize() + self.rng.choice(".....?!")

    def prose(self, low: int = 1, high: int = 6) -> str:
        text = [self.sentence() for _ in range(self.rng.randint(low, high))]
        if self.rng.random() < 0.2:
            text.insert(0, self.link(self.words(1, 3)))
        if self.rng.random() < 0.15:
            text.append(f"<{(t := self.rng.choice(['b', 'em', 'code', 'span']))}>{self.words(1, 4)}</{t}>.")
        return " ".join(text)

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def attrs(self, names: list[str]) -> str:
        if not names or not self.named:
            names = NEUTRAL if self.rng.random() < 0.3 else []
        if not names:
            return ""
        name = "-".join(self.rng.sample(names, min(len(names), self.rng.choice([1, 1, 1, 2]))))
        return f' {self.rng.choice(["class", "class", "class", "id"])}="{name}"'

    def block(self, tag: str, text: str, main: bool, attrs: str = "") -> None:
        close = "" if tag in ("p", "li") and self.rng.random() < 0.15 else f"</{tag}>"
        self.html.append(f"<{tag}{attrs}>{text}{close}")
        self.labels.append(main)

    def boxed(self, tag: str, names: list[str], inside) -> None:
        self.html.append(f"<{tag}{self.attrs(names)}>")
        inside()
        self.html.append(f"</{tag}>")

    def link_list(self, low: int = 2, high: int = 9) -> None:
        self.boxed(self.rng.choice(["ul", "ul", "ol", "div"]), [], lambda: [self.block(self.rng.choice(["li", "li", "div"]), self.link(self.words(1, 4)), False) for _ in range(self.rng.randint(low, high))])

    def part(self, kind: str) -> None:
        rng = self.rng
        names = PARTS[kind]
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside"}.get(kind, "div")
        if rng.random() < 0.4:
            tag = rng.choice(["div", "div", "section", "td"]) if kind != "advert" else rng.choice(["div", "div", "aside", "section"])
        elif kind in ("notice", "advert", "comments", "share"):
            tag = rng.choice(["div", "div", "section", "aside"])

        def inside() -> None:
            if kind == "menu":
                self.link_list()
            elif kind == "header":
                self.block(rng.choice(["div", "h1", "p", "h2"]), self.link(self.words(1, 4)) if rng.random() < 0.6 else self.words(1, 5), False)
                if rng.random() < 0.4:
                    self.block("p", self.words(2, 8), False)
                if rng.random() < 0.4:
                    self.link_list()
            elif kind == "footer":
                for _ in range(rng.randint(1, 2)):
                    self.block(rng.choice(["p", "div", "div"]) if rng.random() < 0.7 else "div", rng.choice(["&copy; ", "© 2024 ", ""]) + (self.prose(1, 3) if rng.random() < 0.5 else self.words(2, 9)), False)
                if rng.random() < 0.4:
                    self.link_list(2, 5)
            elif kind == "side":
                if rng.random() < 0.6:
                    self.block(rng.choice(["h2", "h3", "h4", "div"]), self.words(1, 4), False)
                if rng.random() < 0.7:
                    self.link_list()
                else:
                    self.block("p", self.prose(1, 3), False)
            elif kind == "comments":
                if rng.random() < 0.6:
                    self.block(rng.choice(["h2", "h3"]), f"{rng.randint(1, 99)} {self.words(1, 2)}", False)
                for _ in range(rng.randint(1, 5)):
                    self.boxed(rng.choice(["div", "li", "div", "section"]), ["comment", "reply", "commentbody"], lambda: [self.block("div", self.words(1, 2), False), self.block("p", self.prose(1, 4), False)])
                if rng.random() < 0.4:
                    self.form()
            elif kind == "share":
                self.link_list(2, 4) if rng.random() < 0.6 else self.block("div", self.words(1, 4), False)
            else:
                for _ in range(rng.randint(1, 2)):
                    self.block(rng.choice(["p", "div", "h4"]), self.prose(1, 3) if rng.random() < 0.7 else self.words(2, 9), False)
                if rng.random() < 0.3:
                    self.block(rng.choice(["button", "div"]), self.words(1, 2), False)

        if kind in ("advert", "notice", "footer") and rng.random() < 0.4:
            text = (rng.choice(["&copy; ", ""]) if kind == "footer" else "") + self.prose(1, 4)
            self.block(tag, text, False, self.attrs(names))  # bare text in the box itself
        else:
            self.boxed(tag, names, inside)

    def form(self) -> None:
        def inside() -> None:
            for _ in range(self.rng.randint(1, 3)):
                self.block(self.rng.choice(["div", "p", "li"]), self.words(1, 6), False)
            if self.rng.random() < 0.5:
                self.html.append("<input name=q>")
            self.block("button", self.words(1, 2), False)

        self.boxed("form", ["search", "form", "login", "signup", "contact"], inside)

    def article(self) -> None:
        rng = self.rng
        if rng.random() < 0.6:
            title = self.words(2, 12)
            if rng.random() < 0.25:
                self.boxed("header", ["entry", "title"], lambda: self.block("h1", title, True))
            else:
                self.block(rng.choice(["h1", "h1", "h2"]), title, True)
        for _ in range(rng.randint(1, 2) if rng.random() < 0.3 else rng.randint(1, 14)):
            x = rng.random()
            if x < 0.66:
                self.block("p", self.prose(), True)
            elif x < 0.72:
                self.block(rng.choice(["h2", "h3", "h4"]), self.words(1, 8), True)
            elif x < 0.77:
                self.boxed(rng.choice(["ul", "ol"]), [], lambda: [self.block("li", self.prose(1, 2) if rng.random() < 0.6 else self.words(1, 9), True) for _ in range(rng.randint(2, 5))])
            elif x < 0.81:
                self.boxed("blockquote", [], lambda: self.block("p", self.prose(1, 3), True))
            elif x < 0.84:
                self.boxed("table", [], lambda: [self.boxed("tr", [], lambda: [self.block("td", self.words(1, 5), True) for _ in range(3)]) for _ in range(rng.randint(1, 4))])
            elif x < 0.87:
                self.block(rng.choice(["pre", "div", "figcaption"]), self.words(2, 25), True)
            elif x < 0.89:
                self.block("p", self.word(), True)
            elif x < 0.895:
                self.boxed("noscript", [], lambda: self.block("p", self.prose(1, 3), True))
            elif x < 0.90:
                self.boxed("figure", [], lambda: [self.html.append("<svg viewBox='0 0 9 9'/><img src=x>"), self.block("figcaption", self.words(2, 12), True)])
            elif x < 0.94:
                self.part(rng.choice(["advert", "advert", "side", "share", "notice"]))
            elif x < 0.95:
                self.form()
        if rng.random() < 0.15:
            self.part("comments")

    def page(self) -> tuple[str, list[bool]]:
        rng = self.rng
        self.html.append("<!DOCTYPE html><html><head><meta charset=utf-8><title>" + self.words(1, 8) + '</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body' + (self.attrs(CONTENT) if rng.random() < 0.2 else "") + ">")
        alone = rng.random() < 0.12
        if rng.random() < 0.05:
            self.boxed("noscript", [], lambda: self.block("div", self.prose(1, 2), False))
        before = rng.sample(["header", "menu", "notice", "advert", "side", "share"], 0 if alone else rng.randint(0, 4))
        after = rng.sample(["side", "comments", "footer", "advert", "notice", "share", "menu"], rng.randint(0, 1 if alone else 4))
        for kind in before:
            self.part(kind)
        if rng.random() < 0.2:
            self.form()
        tag = rng.choices(["article", "main", "div", "section", "td"], [6, 3, 4, 1, 1])[0]
        if rng.random() < 0.4:
            self.boxed("div", CONTENT if rng.random() < 0.5 else [], lambda: self.boxed(tag, CONTENT, self.article))
        elif rng.random() < 0.06:
            self.article()
        else:
            self.boxed(tag, CONTENT if rng.random() < 0.7 else [], self.article)
        for kind in after:
            self.part(kind)
        self.html.append("</body></html>")
        return "".join(self.html), self.labels


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[bool]]]:
    """n pages (html, and whether each block, in order, is main text)."""
    rng = random.Random(seed)
    return [_Page(rng).page() for _ in range(n)]
