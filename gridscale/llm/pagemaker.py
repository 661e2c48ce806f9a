"""Made pages with known labels, from which the block labeller learns.

A page is a list of (html, label) parts drawn by rule: menus, banners, notices, adverts, sidebars, forms, comments and
footers around an article, in containers with telling, meaningless or no names. Words are made of random letters, so
that nothing of a language is learnt but the short list of words that such parts use on real sites.
"""

from __future__ import annotations

import random

# Words of page furniture in four languages, and names that page builders give to containers.
MENU = "home about contact products services blog news archive login register search help faq shop cart account menu accueil produits actualités contacto inicio noticias startseite kontakt über datenschutz impressum anmelden sitemap forum downloads".split()
FOOT = "copyright rights reserved privacy policy terms conditions cookies imprint powered sitemap derechos reservados mentions légales droits alle rechte vorbehalten © | ·".split()
NOTICE = "cookies accept consent settings privacy website experience agree decline subscribe newsletter browser enable javascript continue akzeptieren accepter aceptar notice update".split()
ADVERT = "advertisement sponsored promo sale offer buy now discount free click deal anzeige publicité publicidad werbung shop order today".split()
COMMENT = "comment comments reply replies says said posted report like share answer guest anonymous antworten répondre responder kommentar ago".split()
RELATED = "related popular recent posts tags categories archives more read follow next previous share tweet trending weiterlesen aussi también".split()
NAMES = {
    "menu": "nav navbar menu navigation topbar main-nav primary-menu nav-links breadcrumb breadcrumbs tabs toolbar pagination pager".split(),
    "header": "header site-header masthead branding logo page-header top banner hero-banner".split(),
    "footer": "footer site-footer page-footer colophon copyright bottom legal credits".split(),
    "notice": "cookie cookie-banner consent notice alert popup modal gdpr overlay message-bar".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo banner-ad ad-slot adsbox".split(),
    "side": "sidebar aside widget related related-posts recent popular tags share social rail widget-area".split(),
    "form": "form search-form newsletter subscribe login signup contact-form".split(),
    "comment": "comments comment comment-list comment-body replies discussion respond disqus".split(),
    "main": "content main article post entry entry-content post-content article-body main-content story text page-content body-text blog-post".split(),
}
ROLES = {"menu": "navigation", "header": "banner", "footer": "contentinfo", "side": "complementary", "form": "search", "main": "main"}
TAGS = {"menu": ["nav"], "header": ["header"], "footer": ["footer"], "notice": ["aside", "dialog"], "advert": ["aside", "ins"], "side": ["aside"], "form": ["form"], "comment": ["section"], "main": ["article", "main", "section"]}

Part = tuple[str, int | None]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.within = False

    def word(self) -> str:
        letters = self.r.choice(["etaoinshrdlu", "etaoinshrdlucmfwypvbgk", "éèêaeiourstnlç", "äöüßenrstai", "ñáóíoaesrn", "абвгдеиклмнорст"])
        return "".join(self.r.choice(letters) for _ in range(self.r.choice([1, 2, 2, 3, 4, 5, 6, 7, 8, 11])))

    def sentence(self, n: int | None = None) -> str:
        r = self.r
        w = [self.word() for _ in range(n or r.choice([1, 2, 4, 6, 9, 13, 18, 26]))]
        w[0] = w[0].capitalize()
        if r.random() < 0.08:  # text that isn't plain, which is text all the same
            junk = r.choice([" | ", "*** ", "### ", "&amp;&amp;&amp; ", " - ", " / "])
            return junk.join(w) + r.choice(["", ".", junk])
        w = [x + r.choice([",", ",", ",", "&amp;", ";"]) if r.random() < 0.08 else x for x in w]
        return " ".join(w) + r.choice([".", ".", ".", ".", "!", "?", "", "…"])

    def prose(self, most: int = 8) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def mixed(self, words: list[str], n: int) -> str:
        """Some of ``words`` among made ones."""
        return " ".join(self.r.choice(words) if self.r.random() < 0.5 else self.word() for _ in range(n)).capitalize()

    def box(self, kind: str, inside: list[Part]) -> list[Part]:
        """A container; its tag or name tells the kind, or, outside articles only, nothing."""
        r = self.r
        clear = r.random() * (0.85 if self.within else 1)
        tag = r.choice(TAGS[kind]) if clear < 0.45 else r.choice(["div", "div", "div", "section", "td", "span"] if kind != "main" else ["div", "div", "section", "td"])
        attributes = ""
        if clear > 0.3 or tag in ("section", "div") and r.random() < 0.4:
            name = r.choice(NAMES[kind]) if clear < 0.85 else self.word() if r.random() < 0.5 else ""
            if name:
                attributes += f' {r.choice(["class", "class", "id"])}="{name}{r.choice(["", "", f" {self.word()}", "-1"])}"'
        if kind in ROLES and r.random() < 0.15:
            attributes += f' role="{ROLES[kind]}"'
        out = [(f"<{tag}{attributes}>", None), *inside]
        if r.random() < 0.25:
            out = [("<div>", None), *out, ("</div>", None)]
        return [*out, (f"</{tag}>", None)]

    def links(self, words: list[str], label: int = 0) -> list[Part]:
        r, n = self.r, self.r.randint(2, 9)
        texts = [self.mixed(words, r.randint(1, 3)) if r.random() < 0.5 else self.sentence(r.randint(1, 7)).rstrip(".") for _ in range(n)]
        if r.random() < 0.7:
            return [("<ul>", None), *((f'<li><a href="/{k}">{t}</a></li>', label) for k, t in enumerate(texts)), ("</ul>", None)]
        if r.random() < 0.5:
            return [(f'<div><a href="/{k}">{t}</a></div>', label) for k, t in enumerate(texts)]
        return [("<p>" + " | ".join(f'<a href="#">{t}</a>' for t in texts) + "</p>", label)]

    def menu(self) -> list[Part]:
        return self.box("menu", self.links(MENU))

    def header(self) -> list[Part]:
        r = self.r
        parts = [(f"<{t}>{self.mixed(MENU, r.randint(1, 4))}</{t}>", 0) for t in r.sample(["h1", "h2", "p", "div", "span"], r.randint(1, 2))]
        return self.box("header", parts + (self.menu() if r.random() < 0.5 else []))

    def footer(self) -> list[Part]:
        r = self.r
        own = [(f"<{t}>&copy; {self.mixed(FOOT, r.randint(2, 8))} {self.prose(1)}</{t}>", 0) for t in [r.choice(["p", "div", "small", "span"])]]
        if r.random() < 0.4:
            own = [(f"&copy; {self.word()}.example.com &middot; {self.prose(2)}", 0)]
        return self.box("footer", own + (self.links(FOOT) if r.random() < 0.5 else []))

    def notice(self) -> list[Part]:
        return self.box("notice", [(f"<p>{self.mixed(NOTICE, self.r.randint(5, 25))}. {self.prose(2)}</p>", 0), ("<button>" + self.mixed(NOTICE, 1) + "</button>", 0)])

    def advert(self) -> list[Part]:
        r = self.r
        if r.random() < 0.5:
            return self.box("advert", [(self.prose(3), 0)])
        return self.box("advert", [(f"<{t}>{self.mixed(ADVERT, r.randint(2, 12))} {self.prose(2)}</{t}>", 0) for t in [r.choice(["p", "a", "div"])]])

    def side(self) -> list[Part]:
        r, out = self.r, []
        for _ in range(r.randint(1, 3)):
            out.append((f"<{(h := r.choice(['h2', 'h3', 'h4', 'p']))}>{self.mixed(RELATED, r.randint(1, 3))}</{h}>", 0))
            out += self.links(RELATED) if r.random() < 0.7 else [(f"<p>{self.prose(2)}</p>", 0)]
        return self.box("side", out)

    def form(self) -> list[Part]:
        r = self.r
        return self.box("form", [(f"<label>{self.mixed(NOTICE + MENU, r.randint(1, 3))}</label>", 0), ('<input type="text" name="q">', None), (f"<button>{self.mixed(MENU, 1)}</button>", 0)] + ([(f"<p>{self.mixed(NOTICE, r.randint(4, 12))}.</p>", 0)] if r.random() < 0.4 else []))

    def comments(self) -> list[Part]:
        r = self.r
        out = [(f"<h3>{r.randint(1, 99)} {self.mixed(COMMENT, r.randint(1, 2))}</h3>", 0)]
        for _ in range(r.randint(1, 6)):
            out += [("<div class=\"comment\">" if r.random() < 0.6 else "<li>", None), (f"<p><b>{self.word().capitalize()}</b> {r.choice(COMMENT)} {r.randint(1, 28)} {self.word()}</p>", 0), (f"<p>{self.prose(4)}</p>", 0), (f'<a href="#">{r.choice(COMMENT)}</a>', 0), ("</div>" if out[-1][0] != "<li>" else "</li>", None)]
        return self.box("comment", out)

    def article(self) -> list[Part]:
        """Heading and paragraphs, with what articles hold besides."""
        r = self.r
        out: list[Part] = [(f"<{(h := r.choice(['h1', 'h1', 'h1', 'h2']))}>{self.sentence(r.randint(1, 14))}</{h}>", 1)] if r.random() < 0.85 else []
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 12, 18, 30, 45])):
            k = r.random()
            if k < 0.66:
                out.append((f"<p>{self.prose()}</p>", 1))
            elif k < 0.74:
                out.append((f"<p><b>{self.sentence()}<br>", 1))
            elif k < 0.79:
                out.append((f"<h3>{self.sentence(r.randint(1, 6)).rstrip('.')}</h3>", 1))
            elif k < 0.83:
                out.append((f"<blockquote>{self.prose(3)}</blockquote>", 1))
            elif k < 0.88:
                out += [("<ul>", None), *((f"<li>{self.sentence()}</li>", 1) for _ in range(r.randint(2, 5))), ("</ul>", None)]
            elif k < 0.91:
                out.append((f'<p>{self.sentence()} <a href="/x">{self.sentence(3)}</a> {self.sentence()}</p>', 1))
            elif k < 0.93:
                out.append((f"<div>{self.prose(4)}</div>", 1))
            elif k < 0.95:
                out += [("<table>", None), *((f"<tr><td>{self.word()}</td><td>{r.randint(1, 999)}</td></tr>", 1) for _ in range(r.randint(1, 4))), ("</table>", None)]
            elif k < 0.955:
                out.append((f"<pre>{self.prose(2)}</pre>", 1))
            elif k < 0.975:  # furniture words within an article are text of the article
                out.append((f"<p>{' '.join(r.choices(r.choice([FOOT, NOTICE, MENU, COMMENT, RELATED, ADVERT]), k=r.randint(1, 6))).capitalize()}.</p>", 1))
            else:
                self.within = True
                out += self.advert() if k < 0.99 else self.side()
                self.within = False
        return out or [(f"<p>{self.prose()}</p>", 1)]

    def page(self) -> list[Part]:
        r = self.r
        before = [p for p in (self.notice, self.header, self.menu, self.menu, self.advert, self.form, self.side) if r.random() < 0.38]
        after = [p for p in (self.advert, self.side, self.comments, self.comments, self.form, self.menu, self.notice) if r.random() < 0.3]
        r.shuffle(before)
        r.shuffle(after)
        article = self.article()
        if r.random() < 0.9:
            article = self.box("main", article)
        if r.random() < 0.25:
            self.within = True
            inner = [x for p in after[:1] for x in p()]
            self.within = False
            article, after = self.box("main", article + inner), after[1:]
        out = [x for p in before for x in p()] + article + [x for p in after for x in p()]
        out += self.footer() if r.random() < 0.8 else []
        if r.random() < 0.2:
            out = self.wrapped("div", out)
        return self.wrapped("html", self.wrapped("body", out)) if r.random() < 0.8 else out

    def wrapped(self, tag: str, inside: list[Part]) -> list[Part]:
        name = f' class="{self.word()}"' if self.r.random() < 0.3 else ""
        return [(f"<{tag}{name}>", None), *inside, (f"</{tag}>", None)]


def made_pages(n: int, seed: int = 0) -> list[list[Part]]:
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
