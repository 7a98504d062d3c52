"""Labelled pages that the block tagger of ``html_text`` learns from.

A labelled page is HTML in which elements that hold main text carry the attribute ``data-main`` (the tagger reads it as
the label and as nothing else). ``labelled_pages`` writes a bounded set of them from layouts: semantic elements, named
``div`` elements, or bare ones, with the parts around an article that pages of the kind have. Words are invented, so
only layout, names and the shape of a text can be learned.
"""

from __future__ import annotations

import random

_SYLLABLES = ["an en er re on st ti th le sh ou in or ed ing ble and the", "der sch ein ung lich ver ich te zu auf ge ben", "que le eau oi tion aux ment de la ré par", "ción os mente la ra do ga ez ll que as", "ka mo ri su ta ne yo shi ku to"]
#: Names of classes and ids, as pages use them.
_NAMES = {
    "nav": "nav menu navbar navigation main-nav top-menu breadcrumb breadcrumbs pagination pager toc topbar skip-links tabs",
    "header": "header site-header masthead page-header banner-top logo branding site-title tagline",
    "footer": "footer site-footer page-footer bottom copyright colophon legal credits footer-links imprint",
    "aside": "sidebar aside side-column widget related related-posts recommended popular trending most-read tags tag-cloud archive blogroll see-also more-stories teaser-list author-box rail",
    "notice": "cookie cookie-banner cookie-notice consent gdpr notice alert notification announcement newsletter-popup modal popup paywall warning message-bar",
    "ad": "ad ads advert advertisement adsense banner sponsored sponsor promo promotion commercial dfp ad-slot ad-container outbrain",
    "form": "form search search-box login signup subscribe newsletter contact-form comment-form poll survey",
    "comment": "comments comment comment-list comment-body discussion replies reply responses disqus reader-comments user-comments feedback thread",
    "share": "share social social-share sharing follow buttons toolbar actions print-link",
    "main": "content main article post entry story article-body post-content entry-content story-text main-content page-content body-text text blog-post prose",
}
NAMES = {k: v.split() for k, v in _NAMES.items()}


class Writer:
    """Writes one page after another from one random stream."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(self.parts) for _ in range(self.r.randint(1, 3)))

    def words(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(least, most)))

    def sentences(self, least: int, most: int) -> str:
        out = []
        for _ in range(self.r.randint(least, most)):
            s = self.words(1, 22)
            if self.r.random() < 0.4:
                s = s.replace(" ", ", ", 1)
            if self.noisy:
                s = " ".join(w + self.r.choice(["***", "###", "%%%", "$$$", "&amp;&amp;", ""]) for w in s.split())
            if self.r.random() < 0.15:
                s = s.replace(" ", f' <a href="/{self.word()}">{self.word()}</a> ', 1)
            if self.r.random() < 0.1:
                s = s.replace(" ", f" <{self.r.choice(['b', 'i', 'em', 'strong', 'code', 'span'])}>{self.word()} ", 1) + self.r.choice(["</b>", "</i>", ""])
            out.append(s.capitalize() + self.r.choice(".....?!:"))
        return self.r.choice([" ", " ", "\n"]).join(out)

    def tag(self, kind: str, plain: str, semantic: str = "") -> tuple[str, str]:
        """Start and end of an element of a kind: semantic, named or bare, as the page's style has it."""
        if semantic and self.style == "semantic":
            name = f' class="{self.r.choice(NAMES[kind])}"' if self.r.random() < 0.3 else ""
            return f"<{semantic}{name}>", f"</{semantic}>"
        if self.style == "bare" and kind not in ("ad", "notice", "comment"):
            return f"<{plain}>", f"</{plain}>"
        name = self.r.choice(NAMES[kind])
        name += self.r.choice(["", "", "-" + self.word(), " " + self.word(), "_1"])
        where = self.r.choice(["class", "class", "id"])
        return f'<{plain} {where}="{name}">', f"</{plain}>"

    def within(self, kind: str, inner: str, plain: str = "div", semantic: str = "") -> str:
        a, b = self.tag(kind, plain, semantic)
        return a + inner + b

    def links(self, least: int, most: int) -> str:
        one = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(least, most))]
        return self.r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in one) + "</ul>", "<ul>" + "".join(f"<li>{x}" for x in one) + "</ul>", " | ".join(one), "".join(f"<div>{x}</div>" for x in one)])

    def nav(self) -> str:
        return self.within("nav", self.links(2, 9), "div", "nav")

    def header(self) -> str:
        inner = self.r.choice(["<h1>{}</h1>", "<div>{}</div>", "<p>{}</p>", '<a href="/">{}</a>']).format(self.words(1, 4))
        return self.within("header", inner + (self.nav() if self.r.random() < 0.5 else "") + self.r.choice(["", f"<p>{self.words(2, 8)}</p>"]), "div", "header")

    def footer(self) -> str:
        inner = self.r.choice([f"&copy; {self.words(1, 4)} &middot; {self.sentences(1, 2)}", f"<p>&copy; {self.r.randint(1990, 2030)} {self.words(1, 5)}</p>", f"<p>{self.sentences(1, 2)}</p>" + self.links(2, 6), f"{self.words(1, 3)}.example.com {self.sentences(1, 1)}", f"<address>{self.words(3, 8)}</address>" + self.links(2, 5)])
        return self.within("footer", inner, "div", "footer")

    def aside(self) -> str:
        inner = f"<h3>{self.words(1, 4)}</h3>" + self.r.choice([self.links(3, 8), f"<p>{self.sentences(1, 3)}</p>", "".join(f"<h4><a href='/x'>{self.words(2, 6)}</a></h4><p>{self.sentences(1, 1)}</p>" for _ in range(self.r.randint(1, 4)))])
        return self.within("aside", inner, "div", "aside")

    def notice(self) -> str:
        text = self.sentences(1, 3)
        return self.within("notice", self.r.choice([f"<p>{text}</p><button>{self.words(1, 2)}</button>", text, f'{text} <a href="/x">{self.words(1, 2)}</a>']), "div", self.r.choice(["", "", "dialog"]))

    def ad(self) -> str:
        text = self.sentences(1, 2)
        return self.within("ad", self.r.choice([text, f"<p>{text}</p>", f'<a href="/x">{self.words(2, 8)}</a>', f"<h4>{self.words(1, 4)}</h4><p>{text}</p>"]), self.r.choice(["div", "div", "section", "aside"]))

    def form(self) -> str:
        inner = f"<form action='/x'><label>{self.words(1, 3)}</label><input name=q>{self.r.choice(['', f'<p>{self.sentences(1, 2)}</p>'])}<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><textarea>{self.words(0, 4)}</textarea><button>{self.words(1, 2)}</button></form>"
        return self.r.choice([inner, self.within("form", inner), self.within("form", f"<h3>{self.words(1, 3)}</h3><p>{self.sentences(1, 1)}</p>" + inner)])

    def comments(self) -> str:
        one = lambda: self.r.choice(["<li>{}<p>{}</p></li>", "<div class=comment><b>{}</b><p>{}</p></div>", "<article class='comment'><h4>{}</h4><p>{}</p></article>", "<p>{}: {}</p>"]).format(self.words(1, 2), self.r.choice([self.sentences(1, 5), self.sentences(1, 2)]))
        inner = f"<h3>{self.words(1, 3)}</h3><{(t := self.r.choice(['ol', 'ul', 'div']))}>" + "".join(one() for _ in range(self.r.randint(1, 6))) + f"</{t}>" + (self.form() if self.r.random() < 0.3 else "")
        return self.within("comment", inner, self.r.choice(["div", "section", "section"]))

    def share(self) -> str:
        return self.within("share", self.r.choice([self.links(2, 5), "".join(f"<button>{self.word()}</button>" for _ in range(3)), f"<span>{self.words(1, 2)}</span>" + self.links(2, 4)]))

    def main_block(self) -> str:
        kind, m = self.r.random(), " data-main"
        if kind < 0.68:
            return f"<p{m}>{self.sentences(1, self.r.choice([1, 3, 10]))}" + self.r.choice(["</p>", "</p>", "<br>", ""])
        if kind < 0.78:
            return f"<h{(n := self.r.randint(2, 4))}{m}>{self.words(1, 8)}</h{n}>"
        if kind < 0.86:
            items = "".join(f"<li{m}>{self.r.choice([self.words(1, 6), self.sentences(1, 2)])}</li>" for _ in range(self.r.randint(2, 6)))
            return self.r.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format(items)
        if kind < 0.9:
            return f"<blockquote{m}>{self.r.choice([f'<p{m}>{self.sentences(1, 3)}</p>', self.sentences(1, 3)])}</blockquote>"
        if kind < 0.93:
            return f"<figure><img src=x alt='{self.words(1, 3)}'><figcaption{m}>{self.sentences(1, 1)}</figcaption></figure>"
        if kind < 0.96:
            return "<table>" + "".join(f"<tr><th{m}>{self.words(1, 2)}<td{m}>{self.words(1, 4)}</tr>" for _ in range(self.r.randint(2, 5))) + "</table>"
        if kind < 0.98:
            return f"<pre{m}>{self.words(4, 20)}</pre>"
        return f"<dl><dt{m}>{self.words(1, 3)}<dd{m}>{self.sentences(1, 2)}</dl>"

    def main(self) -> str:
        head = f"<h1 data-main>{self.title}</h1>"
        head = self.r.choice([head, head, f"<header>{head}</header>", "", f"<div><h2 data-main>{self.title}</h2></div>"]) if self.style != "semantic" or self.r.random() < 0.3 else head
        body = [self.main_block() for _ in range(self.r.choice([1, 2, self.r.randint(2, 12), self.r.randint(4, 25)]))]
        if self.r.random() < 0.5:
            body[0] = f"<p data-main>{self.r.choice(['', '<b>'])}{self.sentences(1, 2)}<br>"
        for part in (self.ad, self.share, self.aside, self.form, self.notice, self.nav):
            if self.r.random() < 0.08:
                body.insert(self.r.randint(0, len(body)), part())
        inner = head + self.r.choice(["", "\n"]).join(body)
        if self.style == "semantic":
            kind = self.r.choice(["article", "article", "main", "section"])
            name = f' class="{self.r.choice(NAMES["main"])}"' if self.r.random() < 0.3 or kind == "section" else ""
            inner = f"<{kind}{name}>{inner}" + self.r.choice([f"</{kind}>"] * 3 + [""])
            return f"<main>{inner}</main>" if kind == "article" and self.r.random() < 0.3 else inner
        return self.within("main", inner, self.r.choice(["div", "div", "section", "td"]) if self.style == "named" else "div")

    def page(self) -> str:
        self.parts = self.r.choice(_SYLLABLES).split()
        self.noisy = self.r.random() < 0.15
        self.style = self.r.choice(["semantic", "semantic", "semantic", "named", "named", "bare"])
        self.title = self.words(2, 9).capitalize()
        some = lambda share, part: part() if self.r.random() < share else ""
        top = [some(0.5, self.header), some(0.8, self.nav), some(0.3, self.notice), some(0.4, self.ad), some(0.2, self.form), some(0.2, self.aside)]
        low = [some(0.3, self.share), some(0.3, self.comments), some(0.4, self.aside), some(0.2, self.ad), some(0.2, self.form), some(0.2, self.notice)]
        self.r.shuffle(low)
        end = [some(0.9, self.footer), some(0.1, self.notice)]
        title = self.r.choice(["<title>{}</title>", "<title>{} - " + self.word() + "</title>"]).format(self.title)
        return f"<!DOCTYPE html><html><head><meta charset=utf-8>{title}<style>p{{margin:0}}</style><script>var t='<p>';</script></head><body>" + "".join(top) + self.main() + "".join(low + end) + self.r.choice(["</body></html>", ""])


def labelled_pages(n: int = 1000, seed: int = 7) -> list[str]:
    w = Writer(seed)
    return [w.page() for _ in range(n)]
