"""Labelled pages to train the extractor on: layouts drawn by rule, each text block known to be content or not."""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

#: Names that sites give to parts of their pages, by kind (fixed values, common usage).
NAMES = {
    "main": "content main article post entry story body text article-body post-content entry-content page-content".split(),
    "nav": "nav menu navbar navigation topnav breadcrumbs breadcrumb pagination tabs links".split(),
    "header": "header masthead top site-header branding logo".split(),
    "footer": "footer bottom site-footer copyright legal colophon".split(),
    "side": "sidebar aside widget related recommended popular secondary rail".split(),
    "notice": "cookie cookies consent notice banner alert popup modal newsletter subscribe gdpr overlay".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promo adsense".split(),
    "form": "search form login signup contact".split(),
    "comments": "comments comment replies reply discussion responses disqus".split(),
    "share": "share social sharing tags meta toolbar".split(),
}
#: The elements that such parts are written with.
TAGS = {
    "main": "article main div section".split(), "nav": "nav div ul".split(), "header": "header div".split(),
    "footer": "footer div".split(), "side": "aside div section".split(), "notice": "div section aside".split(),
    "advert": "div aside section".split(), "form": "form div".split(), "comments": "section div".split(), "share": "div ul".split(),
}
PLAIN = "wrapper container page row col inner outer layout site".split()


class Page:
    """One page; `content` gets the text of each block of the article."""

    def __init__(self, seed: int) -> None:
        self.draw = random.Random(seed)
        self.content: list[str] = []
        self.parts = [self.draw.choice(["a e i o", "ä ö ü e", "é è ou au", "á ó í u"]).split(), "b d g l m n r s t k".split()]

    def word(self) -> str:
        return "".join(self.draw.choice(self.parts[1]) + self.draw.choice(self.parts[0]) for _ in range(self.draw.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.draw.randint(low, high)))

    def prose(self, low: int = 4, high: int = 90) -> str:
        left, out = self.draw.randint(low, high), []
        while left > 0:
            sentence = self.words(1, 18)
            left -= sentence.count(" ") + 1
            out.append(sentence.capitalize() + self.draw.choice([".", ".", ".", "?", "!", ", " + self.word() + "."]))
        text = " ".join(out)
        return text if self.draw.random() < 0.9 else text.rstrip(".?!")

    def block(self, tag: str, text: str) -> str:
        """A block of the article, with some of its words marked."""
        self.content.append(text)
        words = html.escape(text).split(" ")
        for _ in range(self.draw.randint(0, 2)):
            i = self.draw.randrange(len(words))
            words[i] = self.draw.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<code>{}</code>"]).format(words[i])
        return f"<{tag}>{' '.join(words)}</{tag}>"

    def named(self, kind: str, inner: str) -> str:
        """A part of the page, known by its element, by its names, or both."""
        tag = self.draw.choice(TAGS[kind])
        names = self.draw.sample(NAMES[kind], self.draw.choice([1, 1, 2]))
        own = tag not in ("div", "section", "ul")
        how = "" if own and self.draw.random() < 0.6 else f' {self.draw.choice(["class", "class", "id"])}="{" ".join(names)}"'
        return f"<{tag}{how}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(self.draw.randint(low, high))]
        if self.draw.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.draw.choice([" ", " | ", "<br>"]).join(items)

    def clutter(self, kind: str) -> str:
        draw = self.draw
        if kind in ("nav", "share"):
            inner = self.links(2, 9)
        elif kind == "header":
            inner = f'<a href="/">{self.words(1, 3)}</a>' + (f"<p>{self.words(2, 6)}</p>" if draw.random() < 0.4 else "")
        elif kind == "footer":
            inner = f"&copy; {self.words(1, 4)} &middot; {self.prose(1, 15)}" + (self.links(2, 5) if draw.random() < 0.5 else "")
        elif kind == "side":
            inner = f"<h3>{self.words(1, 4)}</h3>" + (self.links(2, 7) if draw.random() < 0.6 else f"<p>{self.prose(3, 40)}</p>")
        elif kind == "notice":
            inner = self.prose(4, 30) + f"<button>{self.words(1, 2)}</button>"
        elif kind == "advert":
            inner = self.prose(2, 25) if draw.random() < 0.7 else f"<p>{self.prose(3, 40)}</p>"
        elif kind == "form":
            inner = f'<label>{self.words(1, 3)}</label><input name="q"><button>{self.words(1, 2)}</button>'
        else:
            inner = f"<h3>{self.words(1, 3)}</h3>" + "".join(
                f"<div class=\"comment\"><span>{self.word()}</span><p>{self.prose(2, 50)}</p></div>" for _ in range(draw.randint(1, 5))
            )
        return self.named(kind, inner)

    def article(self) -> str:
        draw, out = self.draw, []
        if draw.random() < 0.8:
            out.append(self.block("h1", self.words(1, 14)))
        if draw.random() < 0.15:  # next to nothing to read
            return self.named("main", "".join(out) + self.block("p", self.prose(1, 5)))
        for _ in range(draw.randint(1, 14)):
            kind = draw.random()
            if kind < 0.72:
                out.append(self.block("p", self.prose(*draw.choice([(1, 130), (1, 130), (1, 6)]))))
            elif kind < 0.82:
                out.append(self.block(draw.choice(["h2", "h3"]), self.words(1, 9)))
            elif kind < 0.89:
                out.append("<ul>" + "".join(self.block("li", self.prose(1, 15)) for _ in range(draw.randint(2, 6))) + "</ul>")
            elif kind < 0.93:
                out.append("<blockquote>" + self.block("p", self.prose(3, 40)) + "</blockquote>")
            elif kind < 0.96:
                cells = "".join("<tr>" + self.block("td", self.words(1, 4)) + self.block("td", self.words(1, 4)) + "</tr>" for _ in range(3))
                out.append(f"<table>{cells}</table>")
            else:
                out.append(self.clutter(draw.choice(["advert", "advert", "side", "share", "notice"])))
        if draw.random() < 0.2:
            out.append(self.clutter(draw.choice(["comments", "share", "side"])))
        return self.named("main", "".join(out))

    def build(self) -> str:
        draw = self.draw
        before = [k for k in ("header", "nav", "notice", "advert", "form") if draw.random() < 0.55]
        after = [k for k in ("side", "comments", "advert", "form", "notice") if draw.random() < 0.45]
        draw.shuffle(before)
        draw.shuffle(after)
        inner = "".join(map(self.clutter, before)) + self.article() + "".join(map(self.clutter, after))
        if draw.random() < 0.85:
            inner += self.clutter("footer")
        for _ in range(draw.randint(0, 2)):
            inner = f'<div class="{draw.choice(PLAIN)}">{inner}</div>'
        title = f"<title>{self.words(1, 8)}</title><script>var a = '<p>';</script><style>p {{}}</style>"
        return f"<!DOCTYPE html><html><head>{title}</head><body>{inner}</body></html>"


def labelled_pages(number: int = 300, seed: int = 7) -> Iterator[tuple[str, set[str]]]:
    """(html, texts of the content blocks); the same pages for the same seed."""
    for i in range(number):
        page = Page(seed * 100_003 + i)
        yield page.build(), set(page.content)
