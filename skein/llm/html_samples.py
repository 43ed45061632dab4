"""Invented web pages with known main text, to train the block labeller on.

Every page is drawn from rules: pseudo-words of a random alphabet, the parts
that pages have, and the several ways in which authors mark them up. The
main text carries a private mark, which the labels are read from.
"""

from __future__ import annotations

import numpy as np

MARK = ""
#: Words that parts of pages other than the article tend to have (fixed values), by part and in several languages.
CUES = {
    "nav": "home about contact products services news blog shop support help archive topics sign in log in register search menu startseite kontakt über uns inicio contacto accueil contactez",
    "cookie": "we use cookies to improve your experience accept all reject manage preferences privacy policy this site uses cookies consent agree diese website verwendet cookies akzeptieren utilizamos cookies aceptar nous utilisons des cookies accepter",
    "notice": "notice attention important please note maintenance subscribers only javascript must be enabled your browser is out of date skip to content warning alert hinweis aviso",
    "ad": "advertisement sponsored buy now sale offer discount shop today limited deal promoted free shipping anzeige publicidad publicité",
    "side": "related articles popular most read recent posts categories tags trending you may also like follow us newsletter recommended ähnliche artículos relacionados à lire aussi",
    "form": "name email password subscribe submit send your email address search sign up message required field reset login anmelden enviar envoyer",
    "comments": "comments reply says said on at posted by report like leave a comment kommentare antworten comentarios responder commentaires répondre ago",
    "footer": "copyright all rights reserved terms of use privacy policy imprint impressum contact sitemap powered by © 2024 2023 inc ltd datenschutz aviso legal mentions légales",
    "share": "share tweet print email this facebook twitter whatsapp save bookmark teilen compartir partager",
}
CLASSES = {
    "nav": "nav menu navbar navigation main-menu topnav site-nav breadcrumbs breadcrumb menu-list",
    "header": "header site-header masthead top branding page-header logo topbar",
    "cookie": "cookie cookie-banner consent gdpr cookie-notice privacy-notice cc-window",
    "notice": "notice alert message banner warning flash announcement",
    "ad": "ad ads advert advertisement ad-slot sponsored promo banner-ad adsbox google-ad",
    "side": "sidebar side rail widget widget-area secondary related aside related-posts recommended teaser",
    "form": "form subscribe newsletter login search-form signup contact-form",
    "comments": "comments comment-list commentlist discussion responses comment-thread user-comments disqus",
    "comment": "comment comment-body reply response user-comment",
    "footer": "footer site-footer bottom page-footer colophon foot",
    "share": "share social share-buttons sharing social-links",
    "main": "content main article post entry post-content article-body entry-content story main-content text body-text",
}


class Maker:
    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        parts = "a e i o u th er on an re in st nd ch en de qu la le sch ung keit ción que aux é è ü ö ñ ä eau tion ing ly b d f g k l m n p s t v z".split()
        self.parts = [parts[k] for k in self.r.permutation(len(parts))[: int(self.r.integers(14, 30))]]
        self.vocabulary = ["".join(self.pick(self.parts) for _ in range(int(self.r.integers(1, 6)))) for _ in range(150)]
        self.plain = self.r.random() < 0.25  # a page whose class names say nothing

    def pick(self, of):
        return of[int(self.r.integers(len(of)))]

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def words(self, n: int) -> list[str]:
        return [self.pick(self.vocabulary) for _ in range(n)]

    def prose(self, n: int) -> str:
        out, at = [], 0
        kind = self.r.random()
        while at < n:
            s = self.words(min(n - at, int(self.r.integers(1, 14))))
            at += len(s)
            s[0] = s[0].capitalize()
            s[-1] += "." if self.chance(0.95) else self.pick("?!:")
            out += [w + "," if self.chance(0.08) else w for w in s[:-1]] + s[-1:]
        if kind < 0.05:
            out = [w.upper() + "!!" for w in out]
        elif kind < 0.1:
            out = [w + self.pick(["***", "###", "$$$", "%%%", "&amp;&amp;"]) for w in out]
        elif kind < 0.14:
            out = [x for w in out for x in (w, "|")][:-1]
        elif kind < 0.18:
            out = [out[k % 5] for k in range(len(out))]
        elif kind < 0.21:
            out[len(out) // 2 : len(out) // 2] = [self.pick(["&lt;", "token", "=", "12345678", "10.0.0.1", "a@b.example", "(c)", "&#8212;"]) for _ in range(3)]
        return " ".join(out)

    def cue(self, kind: str, n: int) -> str:
        words = CUES[kind].split()
        at = int(self.r.integers(max(1, len(words) - n)))
        s = words[at : at + n]
        return " ".join(s).capitalize() if self.chance(0.6) else " ".join(s)

    def attr(self, kind: str) -> str:
        if self.chance(0.2):
            return ""
        name = self.pick(CLASSES[kind].split())
        if self.plain:
            name = f"{self.pick('abcxyz')}{int(self.r.integers(100))}"
        elif self.chance(0.2):
            name += f" {self.pick(['col', 'clearfix', 'row', 'wrapper', 'container', 'block', 'box'])}-{int(self.r.integers(12))}"
        return f' {self.pick(["class", "class", "id"])}="{name}"'

    def box(self, kind: str, inner: str, tags: str) -> str:
        tag = self.pick(tags.split())
        a = self.attr(kind)
        if tag == "div" and not a:
            a = f' class="{self.pick(CLASSES[kind].split())}"'
        return f"<{tag}{a}>{inner}</{tag}>"

    def links(self, kind: str, n: int) -> str:
        say = lambda: self.pick(self.vocabulary).capitalize() + (self.pick([".", ",", ""])) if self.chance(0.6) else self.cue(kind, int(self.r.integers(1, 3)))
        items = [f'<a href="/{k}">{say()}</a>' for k in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.chance(0.7) else self.pick([" | ", " ", " / "]).join(items)

    def paragraph(self, main: bool) -> str:
        n = int(self.pick([2, 5, 12, 30, 60, 120]) * self.r.random()) + 1
        text = self.prose(n)
        if self.chance(0.2):
            w = text.split(" ")
            k = int(self.r.integers(len(w)))
            tag = self.pick(["b", "i", "em", "strong", "a", "span", "code"])
            w[k] = f'<{tag}{" href=/x" if tag == "a" else ""}>{w[k]}</{tag}>'
            text = " ".join(w)
        if self.chance(0.06):
            text = f"<b>{text}<br>"
        return (MARK if main else "") + text

    def article(self) -> str:
        out = []
        if self.chance(0.9):
            out.append(f"<h1>{MARK}{self.prose(int(self.r.integers(1, 10)))}</h1>")
        closed = self.chance(0.8)
        for _ in range(int(self.r.integers(1, 16))):
            x = self.r.random() * (0.94 if self.plain else 1)
            if x < 0.72:
                out.append(f"<p>{self.paragraph(True)}" + ("</p>" if closed else ""))
            elif x < 0.8:
                t = self.pick(["h2", "h3"])
                out.append(f"<{t}>{MARK}{self.prose(int(self.r.integers(1, 7)))}</{t}>")
            elif x < 0.86:
                t = self.pick(["ul", "ol"])
                out.append(f"<{t}>" + "".join(f"<li>{MARK}{self.prose(int(self.r.integers(1, 15)))}" + ("</li>" if closed else "") for _ in range(int(self.r.integers(2, 6)))) + f"</{t}>")
            elif x < 0.9:
                out.append(f"<blockquote>{self.pick(['', '<p>'])}{self.paragraph(True)}</blockquote>")
            elif x < 0.92:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{MARK}{self.prose(int(self.r.integers(1, 4)))}</td>" for _ in range(3)) + "</tr>" for _ in range(int(self.r.integers(1, 4)))) + "</table>")
            elif x < 0.94:
                out.append(f"<pre>{self.paragraph(True)}</pre>")
            elif x < 0.96:
                out.append(self.box("ad", self.pick(["", self.cue("ad", 2) + " "]) + self.paragraph(False), "div aside ins"))
            elif x < 0.98:
                out.append(self.box("side", self.links("side", 4), "aside div"))
            else:
                out.append(self.box("share", self.links("share", 4), "div ul"))
        body = "".join(out)
        x = self.r.random() * (0.7 if self.plain else 1)
        if x < 0.5:
            return f"<article{self.attr('main') if self.chance(0.5) else ''}>{body}</article>"
        if x < 0.7:
            return f"<main>{body}</main>" if self.chance(0.5) else f"<main><article>{body}</article></main>"
        return self.box("main", body, "div div section")

    def part(self, kind: str) -> str:
        if kind == "nav":
            return self.box("nav", self.links("nav", int(self.r.integers(2, 9))), "nav nav div")
        if kind == "header":
            return self.box("header", self.pick([f"<h2>{self.prose(2)}</h2>", f"<a href=/>{self.prose(1)}</a>", f"<p>{self.prose(6)}</p>"]) + (self.part("nav") if self.chance(0.4) else ""), "header header div")
        if kind == "cookie":
            return self.box("cookie", f"<p>{self.cue('cookie', 10)}. {self.pick(['', self.prose(6)])}</p><button>{self.cue('cookie', 1)}</button>", "div section")
        if kind == "notice":
            return self.box("notice", f"<{self.pick(['p', 'span', 'strong'])}>{self.cue('notice', 4)} {self.prose(int(self.r.integers(2, 14)))}", "div section")
        if kind == "ad":
            return f"<!-- ad {int(self.r.integers(99))} -->" + self.box("ad", self.pick(["", "", self.cue("ad", 3) + ". "]) + self.prose(int(self.r.integers(1, 25))), "div div ins section")
        if kind == "side":
            return self.box("side", f"<h3>{self.cue('side', 2)}</h3>" + self.pick([self.links("side", 5), f"<p>{self.prose(20)}</p><p>{self.prose(8)}</p>"]), "aside aside div section")
        if kind == "form":
            return f"<form{self.attr('form')}>" + "".join(f"<label>{self.cue('form', 1)}</label><input>" for _ in range(2)) + self.pick([f"<p>{self.prose(9)}</p>", ""]) + f"<select><option>{self.prose(1)}<option>{self.prose(1)}</select><button>{self.cue('form', 1)}</button></form>"
        if kind == "comments":
            one = lambda: self.box("comment", self.pick([f"<b>{self.pick(self.vocabulary)}</b> {self.cue('comments', 1)}", f"<h4>{self.pick(self.vocabulary)}</h4>", f"<p>{self.pick(self.vocabulary)}, 3 days ago</p>", ""]) + f"<p>{self.paragraph(False)}</p>" + self.pick(["<a href=#>Reply</a>", ""]), "div li article p")
            head = self.pick([f"<h2>{self.pick(['Comments', 'Responses', 'Discussion', 'Kommentare', 'Comentarios', 'Commentaires'])}</h2>", f"<h3>{int(self.r.integers(50))} comments</h3>", ""])
            return self.box("comments", head + "".join(one() for _ in range(int(self.r.integers(1, 6)))) + (self.part("form") if self.chance(0.3) else ""), "section div ol div")
        return self.box("footer", self.pick([f"<p>&copy; {self.pick(['2023', '2024', 'm.example.net', 'site.example.org &middot;'])} {self.prose(int(self.r.integers(1, 12)))}</p>", f"&copy; {self.pick(self.vocabulary)}.example.com &middot; {self.prose(int(self.r.integers(1, 12)))}", f"<p>{self.cue('footer', 8)}</p>" + self.links("footer", 4)]), "footer footer div")

    def page(self) -> str:
        before = [k for k, p in (("cookie", 0.15), ("notice", 0.15), ("header", 0.4), ("nav", 0.75), ("ad", 0.45), ("side", 0.15), ("form", 0.1)) if self.chance(p)]
        after = [k for k, p in (("ad", 0.2), ("side", 0.35), ("form", 0.2), ("comments", 0.35), ("nav", 0.1), ("footer", 0.8), ("cookie", 0.1)) if self.chance(p)]
        if self.chance(0.2):
            before = [before[k] for k in self.r.permutation(len(before))]
        body = "".join(map(self.part, before)) + self.article() + "".join(map(self.part, after))
        if self.chance(0.25):
            body = f'<div class="{self.pick(["wrapper", "page", "container", "site", "layout"])}">{body}</div>'
        head = f"<head><title>{self.prose(int(self.r.integers(1, 9)))}</title><style>p{{}}</style></head>"
        return f"<!DOCTYPE html><html>{head}<body>{body}" + ("</body></html>" if self.chance(0.9) else "")


def sample_pages(n: int, seed: int = 5) -> list[str]:
    return [Maker(seed * 1_000_003 + k).page() for k in range(n)]
