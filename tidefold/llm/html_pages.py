"""Labelled pages to train HTML extraction on.

The pages are made here from layouts: every element that holds article text is marked
data-y="1", every other section data-y="0".  Words are random letters, so a model can learn
from structure, names and shapes of text only, never from vocabulary.  A page draws its own habits:
how many wrappers it has, whether names are telling, neutral or made up, whether paragraphs are p
or div, where its title and menus are.  Names that elsewhere mark boilerplate also occur, in part or
whole, on the element that holds the article, so none is proof by itself.
"""

from __future__ import annotations

import random

# Fixed values: (tags, names) that sections of a kind commonly carry.
BOILERPLATE = {
    "nav": (("nav", "div", "ul"), ("nav", "menu", "navbar", "main-nav", "breadcrumbs", "breadcrumb", "navigation", "site-menu", "tabs", "pagination", "pager", "toc")),
    "header": (("header", "div"), ("header", "site-header", "masthead", "banner", "top-bar", "topbar", "logo", "branding")),
    "footer": (("footer", "div"), ("footer", "site-footer", "bottom", "copyright", "colophon", "legal")),
    "aside": (("aside", "div", "section"), ("sidebar", "aside", "widget", "related", "recommended", "trending", "popular", "more-stories", "rail", "tags", "share", "social", "promo", "teaser")),
    "notice": (("div", "section", "aside", "p"), ("cookie", "cookie-banner", "consent", "notice", "gdpr", "alert", "paywall", "popup", "modal", "overlay", "disclaimer")),
    "ad": (("div", "aside", "section", "ins", "iframe"), ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "ad-slot", "adsbygoogle", "promo", "banner-ad")),
    "form": (("form", "div"), ("newsletter", "subscribe", "signup", "search", "login", "contact", "form", "search-form")),
    "comments": (("section", "div", "ol", "aside"), ("comments", "comment", "comment-list", "reader-comments", "replies", "discussion", "disqus", "responses")),
}
ARTICLE = ("", "", "post", "content", "article-body", "story", "entry-content", "post-body", "main-content", "article", "main", "story-text", "text", "body", "page-content")
NEUTRAL = ("row", "col", "box", "inner", "outer", "wrap", "wrapper", "container", "section", "block", "module", "item", "grid", "cell", "panel", "group", "left", "right", "center", "layout", "page", "site")


class Maker:
    """Makes pages; the habits of each are drawn by `page`."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.telling, self.classless, self.div_text, self.quoted, self.ends = 0.8, False, False, True, "....!?"

    def words(self, least: int, most: int) -> str:
        r = self.r
        return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9))) for _ in range(r.randint(least, most)))

    def title(self, least: int = 1, most: int = 9) -> str:
        return self.words(least, most).capitalize()

    def sentence(self, least: int = 4, most: int = 25) -> str:
        return self.words(least, most).capitalize() + self.r.choice(self.ends)

    def prose(self, most: int = 5) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 1, 2, 3, self.r.randint(1, most)))))

    def link(self, least: int = 1, most: int = 4) -> str:
        return f'<a href="/{self.r.randint(1, 99)}">{self.title(least, most)}</a>'

    def listed(self, items: list[str], tag: str = "") -> str:
        tag = tag or self.r.choice(("ul", "ul", "ol"))
        return f"<{tag}>{''.join(f'<li>{x}</li>' for x in items)}</{tag}>"

    def links(self, least: int = 2, most: int = 9, longest: int = 4) -> list[str]:
        return [self.link(1, longest) for _ in range(self.r.randint(least, most))]

    def attribute(self, name: str) -> str:
        if not name or self.classless:
            return ""
        value = f'"{name}"' if self.quoted or " " in name else name
        return f' {self.r.choice(("class", "class", "class", "id"))}={value}'

    def made_up(self) -> str:
        r = self.r
        return r.choice(("css-", "x", "c", "sc-", "")) + "".join(r.choice("bcdfghjkqvwxyz0123456789") for _ in range(r.randint(2, 6)))

    def name(self, telling: str, chance: float | None = None) -> str:
        """A name that says what an element is, perhaps with another one, or one that says nothing."""
        r = self.r
        if telling and r.random() < (self.telling if chance is None else chance):
            return r.choice((telling, telling, telling, f"{telling} {r.choice(NEUTRAL)}", f"{r.choice(NEUTRAL)}-{telling}", f"{telling}-{self.words(1, 1)}"))
        return r.choice(("", r.choice(NEUTRAL), f"{r.choice(NEUTRAL)}-{r.randint(1, 12)}", self.made_up()))

    def section(self, kind: str) -> str:
        r = self.r
        tags, names = BOILERPLATE[kind]
        tag = r.choice(tags)
        own = tag in ("nav", "header", "footer", "aside", "form", "ins", "iframe")
        named = self.attribute(self.name(r.choice(names), 0.4 if own else None))
        if tag == "iframe":
            tag = "ins"
        if kind == "nav":
            inner = r.choice((self.listed(self.links(), "ul"), self.listed(self.links(), "ul"), " ".join(self.links()), " | ".join(self.links()), " &gt; ".join(self.links(2, 4)), self.listed([*self.links(1, 6), self.title(1, 2)], "ul")))
            inner = inner[4:-5] if tag == "ul" and inner.startswith("<ul>") else inner
        elif kind == "header":
            inner = r.choice((f"<h1>{self.title(1, 4)}</h1>", f"<h1>{self.link()}</h1>", self.link(), self.title(1, 4), f"<p>{self.title(2, 7)}</p>")) + r.choice(("", "", self.listed(self.links(), "ul"), f'<form><input name="q"><button>{self.title(1, 1)}</button></form>', f"<p>{self.title(2, 8)}</p>"))
        elif kind == "footer":
            inner = r.choice((f"&copy; {self.words(1, 4)} &middot; {self.sentence()}", f"<p>&copy; {self.title(2, 6)}</p>", f"{self.listed(self.links(), 'ul')}<p>{self.sentence()}</p>", f"<p>{self.prose(2)}</p>{' '.join(self.links(1, 4))}", f"<p>{self.title(2, 7)}</p>", self.listed([self.sentence(), *self.links(1, 4)])))
        elif kind == "aside":
            head = r.choice((f"<h{(n := r.randint(2, 5))}>{self.title(1, 3)}</h{n}>", f"<b>{self.title(1, 3)}</b>", ""))
            inner = head + r.choice((self.listed(self.links(2, 8, 8), "ul"), self.listed(self.links(2, 8, 8)), f"<p>{self.sentence()}</p>", "".join(f"<p>{self.link(3, 9)}</p>" for _ in range(r.randint(1, 5))), " ".join(self.links()), f"<p>{self.prose(2)}</p>"))
        elif kind == "form":
            field = r.choice(('<input name="q">', f"<textarea>{self.title(1, 4)}</textarea>", f"<select>{''.join(f'<option>{self.title(1, 2)}</option>' for _ in range(3))}</select>"))
            inner = f"{r.choice(('', f'<label>{self.title(1, 4)}</label>'))}{field}<button>{self.title(1, 2)}</button>" + r.choice(("", f"<p>{self.sentence()}</p>"))
            inner = inner if tag == "form" else f"<h3>{self.title(1, 4)}</h3><form>{inner}</form>" if r.random() < 0.4 else f"<form>{inner}</form>"
        elif kind == "comments":
            item = "li" if tag == "ol" else r.choice(("div", "article", "p", "div"))
            who = r.choice(("<b>{}</b> ", "<b>{}</b>", "<cite>{}</cite> ", "<h4>{}</h4>"))
            body = r.choice(("{}", "<p>{}", "<p>{}</p>", "<div>{}</div>")) if item != "p" else "{}"
            mine = self.attribute(self.name(r.choice(("comment", "reply", "comment-body", "c"))))
            inner = (f"<h3>{r.choice(('', '12 '))}{self.title(1, 3)}</h3>" if tag != "ol" else "") + "".join(f"<{item}{mine}>{who.format(self.title(1, 2))}{body.format(self.prose(4))}</{item}>" for _ in range(r.randint(1, 6)))
        elif kind == "notice" and tag == "p":
            inner = self.sentence()
        else:
            inner = r.choice((self.sentence(), f"<p>{self.sentence()}</p>", f"<p>{self.prose(3)}</p>", f"<p>{self.sentence()} {self.link()}</p><button>{self.title(1, 2)}</button>", f"{self.sentence()} {self.link()}"))
            if kind == "notice" and r.random() < 0.15:
                return f'<noscript data-y="0">{inner}</noscript>'
        return f'<{tag}{named} data-y="0">{inner}</{tag}>'

    def paragraph(self, text: str) -> str:
        r = self.r
        if self.div_text:
            return f"<div{self.attribute(self.name(''))}>{text}</div>"
        return f"<p>{text}</p>" if r.random() < 0.93 else f"<p>{text}"

    def block(self) -> str:
        r, kind = self.r, self.r.random()
        if kind < 0.58:
            return self.paragraph(self.prose(r.choice((1, 2, 5, 9))))
        if kind < 0.7:
            return f"<h{r.randint(2, 4)}>{self.title(1, 8)}</h2>"
        if kind < 0.74:
            return f"<p><b>{self.title(3, 14)}{r.choice(('', '.'))}<br><p>{self.prose(4)}</p>"
        if kind < 0.79:
            return self.listed([r.choice((self.sentence(2, 14), self.title(2, 12))) for _ in range(r.randint(2, 7))])
        if kind < 0.85:  # linked titles, and notes with a link
            return self.listed(r.choice((self.links(2, 9, 8), self.links(2, 9, 3), [f"{self.link(2, 5)} {self.sentence(2, 9)}" for _ in range(r.randint(2, 6))])))
        if kind < 0.88:
            return f"<blockquote><p>{self.prose(3)}</p></blockquote>"
        if kind < 0.91:
            return f"<pre>{self.words(3, 20)}</pre>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><{t}>{self.title(1, 4)}</{t}><{t}>{r.choice((self.title(1, 4), str(r.randint(1, 999))))}</{t}></tr>" for t in ("th", "td", "td", "td")[r.randint(0, 1):]) + "</table>"
        if kind < 0.97:
            return self.paragraph(f"{self.sentence()} {self.link(1, 5)} {self.words(1, 4)} {self.link(1, 3)} {self.sentence()}")
        return r.choice((f'<figure><img src="a.png"><figcaption>{self.sentence()}</figcaption></figure>', f"<dl><dt>{self.title(1, 3)}<dd>{self.sentence()}<dt>{self.title(1, 3)}<dd>{self.sentence()}</dl>", f"<section><h3>{self.title(1, 5)}</h3><p>{self.prose(4)}</p></section>"))

    def misleading(self) -> str:
        names = self.r.choice([n for _, n in BOILERPLATE.values()])
        return self.r.choice((f"{self.r.choice(names)}-{self.words(1, 1)}", f"{self.words(1, 1)}-{self.r.choice(names)}", self.r.choice(names)))

    def page(self) -> str:
        r = self.r
        self.telling, self.classless = r.choice((0.95, 0.95, 0.8, 0.5, 0.1)), r.random() < 0.08
        self.div_text, self.quoted = r.random() < 0.1, r.random() < 0.9
        self.ends = r.choice(("....!?",) * 4 + (("", "#", "%", "."), ("", ",", ".")))
        tag = r.choice(("article", "article", "article", "main", "div", "div", "div", "section", "td"))
        name = self.misleading() if r.random() < 0.12 else self.name(r.choice(ARTICLE), 0.4 if tag in ("article", "main") else None)
        blocks = [f"<h{r.choice('1112')}>{r.choice((self.title(2, 12), self.title(2, 12), self.sentence(3, 14)))}</h1>"] * (r.random() < 0.85) + [self.paragraph(self.prose()) for _ in range(r.randint(0, 2))] + [self.block() for _ in range(r.randint(1, 14))]
        blocks = [f'<div{self.attribute(self.name("") if r.random() < 0.7 else self.misleading())} data-y="1">{b}</div>' if r.random() < 0.06 else b for b in blocks]
        if r.random() < 0.15:  # the article in parts
            cut = r.randint(1, len(blocks))
            blocks = [f"<div{self.attribute(self.name(''))}>{''.join(blocks[:cut])}</div>", f"<div{self.attribute(self.name(''))}>{''.join(blocks[cut:])}</div>"]
        for kind in ("ad", "aside", "notice", "comments", "form", "nav"):
            if r.random() < 0.1:
                at = len(blocks) if kind == "comments" else r.randint(1, len(blocks))
                blocks.insert(at, self.section(kind))
        article = f'<{tag}{self.attribute(name)} data-y="1">{"".join(blocks)}</{tag}>'
        before = [self.section(k) for k in ("header", "nav", "notice", "ad") if r.random() < 0.6]
        after = [self.section(k) for k in ("aside", "comments", "form", "ad", "notice") if r.random() < 0.5]
        foot = [self.section("footer")] * (r.random() < 0.7)
        if tag == "td":
            side = f'<td{self.attribute(self.name("sidebar"))} data-y="0">{self.section("aside")}</td>'
            article = f"<table>{r.choice(('', f'<tr><td data-y=\"0\">{self.section("nav")}</td></tr>'))}<tr>{r.choice((article, side + article, article + side))}</tr></table>"
        for _ in range(r.choice((0, 0, 1, 1, 2, 3))):  # wrappers, with some of the page's sections inside
            cut = r.randint(0, len(after))
            article = f"<{(t := r.choice(('div', 'div', 'section', 'main')))}{self.attribute(self.name(''))}>{article}{''.join(after[:cut])}</{t}>"
            after = after[cut:]
        body = "".join([*before, article, *after, *foot])
        for _ in range(r.choice((0, 0, 1, 2))):
            body = f"<div{self.attribute(self.name(''))}>{body}</div>"
        title = f'<title data-y="0">{self.title(2, 8)}</title>' if r.random() < 0.9 else ""
        return f'<!DOCTYPE html><html lang="en"><head>{title}</head><body>{body}</body></html>'


def labelled_pages(n: int = 1000, seed: int = 7) -> list[str]:
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
