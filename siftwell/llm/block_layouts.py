"""Pages with known main text to learn from: usual layouts, filled with words of the corpus.

Every page is drawn by a seeded generator: which parts it has, in which order, what their elements are called, and how the
article is marked, if at all. The lists are plain values; nothing here is taken from any page.
"""

from __future__ import annotations

from random import Random
from typing import NamedTuple

# What parts of pages are usually called.
ARTICLE = "article post entry content story main body text single page blog news section post-content entry-content main-content article-body story-body articleBody".split()
MENU = "nav menu navbar navigation topnav breadcrumb breadcrumbs toolbar tabs pagination pager main-menu nav-links tags".split()
HEADER = "header masthead site-header top banner branding logo topbar page-header head".split()
FOOTER = "footer site-footer bottom colophon copyright legal foot page-footer credits".split()
SIDE = "sidebar aside widget related side rail recommended popular trending more-stories right-column secondary promo teaser".split()
NOTICE = "notice cookie cookies consent gdpr alert banner popup modal overlay newsletter paywall message cookie-banner announcement subscribe".split()
ADVERT = "ad ads advert advertisement sponsor sponsored banner-ad promo ad-slot adbox dfp commercial promoted".split()
COMMENT = "comments comment responses discussion replies reader-comments commentlist disqus feedback thread respond comment-body".split()
SHARE = "share social sharing follow buttons share-bar social-links".split()
SAYINGS = {
    "notice": "we use cookies to improve your experience accept all cookies|this site uses cookies read our privacy policy|subscribe to our newsletter|wir verwenden cookies akzeptieren|ce site utilise des cookies accepter|este sitio usa cookies aceptar".split("|"),
    "footer": "© 2024 all rights reserved|copyright · terms of use · privacy|© impressum datenschutz kontakt|© mentions légales tous droits réservés|© aviso legal todos los derechos reservados|contact us about jobs".split("|"),
    "comment": "reply|log in to comment|leave a reply|antworten|répondre|responder|posted by|says:|2 hours ago|like".split("|"),
    "share": "share|tweet|facebook|print|email this".split("|"),
    "form": "search|your email|sign up|send|name|password log in|suche|rechercher|buscar".split("|"),
    "side": "related articles|most read|you may also like|trending now|read more|auch interessant|à lire aussi|te puede interesar".split("|"),
    "ad": "advertisement|sponsored|buy now|anzeige|publicité|publicidad|shop the sale".split("|"),
    "menu": "home|news|about|contact|sports|login|start|accueil|inicio|next|previous|skip to content".split("|"),
}


class Page(NamedTuple):
    html: str
    kept: frozenset[str]


class Writer:
    """Draws one page."""

    def __init__(self, rng: Random, words: list[str]) -> None:
        self.rng, self.words = rng, words
        self.kept: set[str] = set()
        # Some sites don't say what their elements are for.
        self.silent = rng.random() < 0.12

    def some(self, low: int, high: int) -> str:
        """Between ``low`` and ``high`` words, short ones more often."""
        n = int(low + (high - low) * self.rng.random() ** 2)
        # Now and then a text of very few different words, or one of odd marks.
        words = self.rng.choices(self.words, k=2) if self.rng.random() < 0.06 else self.words
        out = self.rng.choices(words, k=max(1, n))
        glue = self.rng.choice((" | ", " *** ", " & ")) if self.rng.random() < 0.04 else " "
        return glue.join(out).capitalize() + self.rng.choice([".", ".", ".", "!", "?", ""])

    def said(self, kind: str) -> str:
        saying = self.rng.choice(SAYINGS[kind])
        return saying.capitalize() if self.rng.random() < 0.7 else f"{saying} {self.some(1, 6)}"

    def named(self, names: list[str], tags: str) -> tuple[str, str]:
        """An opening and a closing tag; a name stands in the class, the id or (for a telling tag) nowhere."""
        tag = self.rng.choice(tags.split())
        telling = tag not in ("div", "section", "ul", "span", "td")
        if self.silent:
            name = "".join(self.rng.choices("bcdfgjkqvwxz", k=self.rng.randint(1, 4)))
            return (f'<{tag} class="{name}">' if self.rng.random() < 0.5 else f"<{tag}>"), f"</{tag}>"
        if telling and self.rng.random() < 0.5:
            return f"<{tag}>", f"</{tag}>"
        key, name = self.rng.choice(("class", "class", "id")), self.rng.choice(names)
        if self.rng.random() < 0.2:
            name += self.rng.choice((" clearfix", " wide", "-inner", "-1", " js-x", "_box", " row"))
        return f'<{tag} {key}="{name}">', f"</{tag}>"

    def links(self, kind: str, low: int, high: int) -> str:
        items = [self.said(kind) if self.rng.random() < 0.4 else self.some(1, 5) for _ in range(self.rng.randint(low, high))]
        anchors = [f'<a href="/{i}">{t}</a>' for i, t in enumerate(items)]
        if self.rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{a}</li>" if self.rng.random() < 0.95 else f"<li>{a}" for a in anchors) + "</ul>"
        return self.rng.choice((" | ", " ", "<br>", " · ")).join(anchors)

    def keep(self, text: str) -> str:
        self.kept.add(" ".join(text.split()))
        return text

    def paragraph(self) -> str:
        text = self.keep(self.some(1, self.rng.choice((4, 30, 120))))
        cut = text.find(" ")
        if cut > 0 and self.rng.random() < 0.2:
            tag = self.rng.choice(("b", "em", "strong", "i", "span", 'a href="/x"'))
            text = f"<{tag}>{text[:cut]}</{tag.split()[0]}>{text[cut:]}"
        return f"<p>{text}" + ("</p>" if self.rng.random() < 0.9 else "")

    def article_part(self) -> str:
        draw = self.rng.random()
        if draw < 0.66:
            return self.paragraph()
        if draw < 0.73:
            tag = self.rng.choice(("h2", "h3", "h4"))
            return f"<{tag}>{self.keep(self.some(1, 9))}</{tag}>"
        if draw < 0.89:
            tag = self.rng.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{self.keep(self.some(1, 20))}</li>" for _ in range(self.rng.randint(2, 6))) + f"</{tag}>"
        if draw < 0.92:
            return f"<blockquote>{self.paragraph()}</blockquote>"
        if draw < 0.94:
            rows = ["".join(f"<td>{self.keep(self.some(1, 4))}</td>" for _ in range(3)) for _ in range(self.rng.randint(1, 4))]
            return "<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>"
        if draw < 0.96:
            return f"<figure><img src='a.png'><figcaption>{self.keep(self.some(2, 12))}</figcaption></figure>"
        if draw < 0.97:
            return f"<pre>{self.keep(self.some(2, 12))}</pre>"
        return f"<div>{self.paragraph()}{self.paragraph()}</div>"

    def inside(self) -> str:
        """What stands inside articles without being of them."""
        return self.rng.choice((self.advert, self.form, self.share, self.side, self.notice))()

    def article(self) -> str:
        parts = [self.article_part() for _ in range(int(1 + 14 * self.rng.random() ** 1.5))]
        for _ in range(self.rng.choice((0, 0, 0, 1, 1, 2))):
            parts.insert(self.rng.randint(0, len(parts)), self.inside())
        if self.rng.random() < 0.7:
            tag = self.rng.choice(("h1", "h1", "h2"))
            title = f"<{tag}>{self.keep(self.some(1, 12))}</{tag}>"
            parts.insert(0, title)
        opening, closing = self.named(ARTICLE, "article article article main div div div section td")
        body = opening + "".join(parts) + closing
        if opening.startswith("<td"):
            body = f"<table><tr>{body}</tr></table>"
        if self.rng.random() < 0.3:
            # The main column may hold more than the article.
            opening, closing = self.named(["main", "wrapper", "container", "page", "column", "site", "app", "root", "content"], "div main div section")
            extra = self.rng.choice((self.comments, self.share, self.side))() if self.rng.random() < 0.5 else ""
            body = opening + body + extra + closing
        return body

    def part(self, names: list[str], tags: str, *inner: str) -> str:
        opening, closing = self.named(names, tags)
        return opening + "".join(inner) + closing

    def maybe_wrapped(self, text: str) -> str:
        tag = self.rng.choice(("p", "p", "div", "span", "h3", ""))
        return f"<{tag}>{text}</{tag}>" if tag else text

    def menu(self) -> str:
        return self.part(MENU, "nav nav div ul", self.links("menu", 2, 9))

    def header(self) -> str:
        inner = [f"<{(tag := self.rng.choice(('h1', 'div', 'p', 'a href=/')))}>{self.some(1, 4)}</{tag.split()[0]}>"]
        if self.rng.random() < 0.4:
            inner.append(self.maybe_wrapped(self.some(2, 9)))
        if self.rng.random() < 0.4:
            inner.append(self.rng.choice((self.menu, self.form))())
        return self.part(HEADER, "header header div", *inner)

    def footer(self) -> str:
        inner = [self.maybe_wrapped(f"{self.said('footer')} {self.some(1, 12) if self.rng.random() < 0.6 else ''}")]
        if self.rng.random() < 0.4:
            inner.append(self.links("menu", 2, 6))
        if self.rng.random() < 0.2 and not self.silent:
            inner.append(self.maybe_wrapped(self.some(3, 40)))
        return self.part(FOOTER, "footer footer div", *inner)

    def advert(self) -> str:
        text = self.said("ad") if self.silent or self.rng.random() < 0.4 else self.some(2, 30)
        return self.part(ADVERT, "div div aside section", self.maybe_wrapped(text))

    def side(self) -> str:
        inner = [f"<h3>{self.said('side')}</h3>"] if self.rng.random() < 0.7 else []
        inner.append(self.links("side", 2, 7))
        if self.rng.random() < 0.4 and not self.silent:
            inner.append(self.maybe_wrapped(self.some(3, 60)))
        return self.part(SIDE, "aside aside div section", *inner)

    def notice(self) -> str:
        text = f"{self.said('notice')} {self.some(2, 25) if self.rng.random() < 0.5 and not self.silent else ''}"
        return self.part(NOTICE, "div div section dialog", self.maybe_wrapped(text), "<button>OK</button>" if self.rng.random() < 0.5 else "")

    def form(self) -> str:
        return f"<form action='/s'>{self.maybe_wrapped(self.said('form'))}<input name='q'><button>{self.said('form')}</button></form>"

    def share(self) -> str:
        return self.part(SHARE, "div ul div", self.links("share", 2, 5))

    def comments(self) -> str:
        inner = [f"<h3>{self.rng.choice(('Comments', '3 comments', 'Kommentare', 'Commentaires', 'Comentarios', 'Responses'))}</h3>"]
        for _ in range(self.rng.randint(1, 5)):
            text = f"{self.said('comment')} {'' if self.silent else self.some(1, 60)}"
            inner.append(self.rng.choice(("<div class='comment'>{}</div>", "<li>{}</li>", "<p>{}</p>", "<article class='comment'><p>{}</p></article>")).format(text))
        return self.part(COMMENT, "section div div ol", *inner)

    def page(self) -> Page:
        chance = self.rng.random
        before = [f() for f, p in ((self.notice, 0.25), (self.header, 0.5), (self.menu, 0.7), (self.advert, 0.4), (self.form, 0.1), (self.share, 0.1)) if chance() < p]
        after = [f() for f, p in ((self.share, 0.2), (self.advert, 0.2), (self.comments, 0.4), (self.side, 0.4), (self.notice, 0.1), (self.menu, 0.15), (self.footer, 0.8), (self.notice, 0.1)) if chance() < p]
        if chance() < 0.2:
            before.append(self.side())
        if chance() < 0.05 and not self.silent:
            middle = self.links("menu", 3, 12)
        else:
            middle = self.article()
        inner = "".join(before) + middle + "".join(after)
        if chance() < 0.3:
            opening, closing = self.named(["page", "wrapper", "container", "site", "outer", "layout"], "div")
            inner = opening + inner + closing
        return Page(f"<html><body>{inner}" + ("</body></html>" if chance() < 0.9 else ""), frozenset(self.kept))


def drawn_pages(seed: int, n: int, words: list[str]) -> list[Page]:
    rng = Random(seed)
    return [Writer(rng, words).page() for _ in range(n)]
