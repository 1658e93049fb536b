"""Invented pages of many layouts, for training the extraction of main texts.

Every block of main text begins with ``MARK``, which the training strips; so a page
is its own label. Words are invented, so trees can learn structure and names only.
"""

from __future__ import annotations

import random

MARK = ""
_SYLLABLES = "ba de fi go lu ma ne pi ro su ta ve ka zo chi ren tor ing al est ou ä é un mer sol".split()
_NAMES = {
    "main": "content main-content post post-body entry entry-content story article-body text main-text page-content articleBody single-post prose body-copy".split(),
    "nav": "nav navbar menu main-menu navigation breadcrumb breadcrumbs topnav site-nav pagination nav-links toc tabs".split(),
    "ad": "ad ads advert advertisement ad-slot sponsored promo google-ad ad-banner adsense sponsor-box promoted ad-container".split(),
    "comment": "comments comment-list commentlist responses discussion disqus_thread comment-section replies reader-comments".split(),
    "footer": "footer site-footer colophon copyright bottom legal page-footer foot imprint".split(),
    "header": "header site-header masthead top banner head branding page-header topbar".split(),
    "side": "sidebar side widget-area related related-posts recommended popular trending right-rail widgets more-stories".split(),
    "notice": "notice cookie-notice cookie-banner consent gdpr alert popup modal privacy-notice warning site-notice".split(),
    "form": "search search-form login newsletter subscribe contact-form signup register".split(),
    "share": "share social share-buttons social-links follow-us sharing post-tags".split(),
    "plain": "row col box container wrapper inner block section grid c1 x7 css-1a2b area left panel wrap unit".split(),
}


class Layout:
    """One page, drawn from a seed."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.rng
        out = []
        for _ in range(r.randint(low, high)):
            word = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
            out.append(word + (r.choice(",.,;") if r.random() < 0.12 else ""))
        return " ".join(out).capitalize()

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 22).rstrip(",.;") + self.rng.choice("....!?") for _ in range(self.rng.randint(low, high)))

    def inline(self, text: str) -> str:
        """Some words in inline elements."""
        r, out = self.rng, []
        for word in text.split(" "):
            if r.random() < 0.03:
                tag = r.choice(["b", "i", "em", "strong", "span", "code", 'a href="/x"', 'span class="x"'])
                word = f"<{tag}>{word}</{tag.split()[0]}>"
            out.append(word + ("<br>" if r.random() < 0.01 else ""))
        return r.choice([" ", " ", " ", "\n  "]).join(out)

    def attributes(self, kind: str, sure: float = 0.8) -> str:
        r = self.rng
        if r.random() > sure:
            return "" if r.random() < 0.6 else f' class="{r.choice(_NAMES["plain"])}"'
        name = r.choice(_NAMES[kind])
        if r.random() < 0.2:
            name = r.choice(["site-", "page-", "js-", "main-", "the-"]) + name
        if r.random() < 0.3:
            name += r.choice(["-wrapper", "-inner", "-box", " clearfix", " row", "-1", " col-8"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def box(self, kind: str, inside: str, tags: str = "div", sure: float = 0.8) -> str:
        r = self.rng
        tag = r.choice(tags.split())
        sure = sure if tag in ("div", "section", "ul", "p", "td") else 0.4
        out = f"<{tag}{self.attributes(kind, sure)}>{inside}</{tag}>"
        return self.box("plain", out, "div", 0.5) if r.random() < 0.15 else out

    def links(self, low: int = 2, high: int = 12) -> str:
        r = self.rng
        items = [f'<a href="/{i}">{self.words(1, r.choice([1, 1, 2, 6]))}</a>' for i in range(r.randint(low, high))]
        form = r.random()
        if form < 0.6:
            return "<ul>" + "".join(f"<li>{item}" + ("</li>" if r.random() < 0.9 else "") for item in items) + "</ul>"
        if form < 0.8:
            return r.choice([" | ", " ", " &middot; ", "\n", " &raquo; "]).join(items)
        return "".join(f"<div>{item}</div>" for item in items)

    def nav(self) -> str:
        head = f"<h2>{self.words(1, 2)}</h2>" if self.rng.random() < 0.15 else ""
        return self.box("nav", head + self.links(), self.rng.choice(["nav", "nav", "div", "div", "ul div"]))

    def ad(self) -> str:
        r = self.rng
        inside = r.choice([self.sentences(1, 2), f"<p>{self.sentences(1, 3)}</p>", f'<a href="/ad"><b>{self.words(2, 8)}</b></a>', f"<span>{self.words(1, 1)}</span><p>{self.words(4, 20)}</p><a href='#'>{self.words(1, 3)}</a>", self.words(1, 6)])
        return r.choice(["<!-- ad 1 -->", "", ""]) + self.box("ad", inside, "div div div aside ins section p", 0.93)

    def notice(self) -> str:
        inside = f"<p>{self.sentences(1, 4)}</p>" if self.rng.random() < 0.6 else self.sentences(1, 3)
        if self.rng.random() < 0.5:
            inside += self.rng.choice(["<button>Ok</button>", '<a href="#">Ok</a>', f'<a href="/privacy">{self.words(1, 2)}</a>'])
        return self.box("notice", inside, "div div section p aside", 0.93)

    def form(self) -> str:
        inside = f"<label>{self.words(1, 3)}</label><input name=q>" + (f"<p>{self.sentences(1, 2)}</p>" if self.rng.random() < 0.5 else "") + self.rng.choice(["<button>Go</button>", "<input type=submit>", f"<select><option>{self.words(1, 2)}</select>"])
        head = f"<h3>{self.words(1, 4)}</h3>" if self.rng.random() < 0.4 else ""
        return self.box("form", head + inside, "form form form div", 0.9)

    def side(self) -> str:
        r = self.rng
        parts = [r.choice([f"<h{r.randint(2, 4)}>{self.words(1, 4)}</h3>", ""]) + r.choice([self.links(), f"<p>{self.sentences(1, 3)}</p>", self.links(), self.ad(), self.form()]) for _ in range(r.randint(1, 3))]
        return self.box("side", "".join(self.box("plain", p, "div section", 0.3) if r.random() < 0.5 else p for p in parts), r.choice(["aside", "aside", "div", "div section"]), 0.92)

    def header(self) -> str:
        r = self.rng
        name = r.choice([f"<h1>{self.words(1, 3)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.words(1, 3)}</p>", f"<div>{self.words(1, 3)}</div>"])
        parts = [name] + [p for p, q in ((f"<p>{self.words(2, 10)}</p>", 0.4), (self.nav(), 0.4), (self.form(), 0.2)) if r.random() < q]
        return self.box("header", "".join(parts), r.choice(["header", "header", "div", "div section"]), 0.92)

    def footer(self) -> str:
        r = self.rng
        parts = [p for p, q in ((f"&copy; {self.words(1, 3)} &middot; {self.words(2, 10)}", 0.7), (f"<p>{self.sentences(1, 3)}</p>", 0.5), (self.links(), 0.5), (f"<address>{self.words(2, 6)}</address>", 0.1)) if r.random() < q] or [self.words(1, 8)]
        return self.box("footer", "".join(parts), r.choice(["footer", "footer", "div", "div section"]), 0.92)

    def comments(self) -> str:
        r = self.rng
        tag = r.choice(["div", "div", "li", "article", "p"])
        one = []
        for _ in range(r.randint(1, 6)):
            who = r.choice([f"<b>{self.words(1, 2)}</b> ", f"<div>{self.words(1, 2)}</div>", f"<cite>{self.words(1, 2)}</cite>: "]) if tag != "p" else f"<b>{self.words(1, 2)}</b>: "
            said = self.sentences(1, 5) if tag == "p" or r.random() < 0.4 else "".join(f"<p>{self.sentences(1, 4)}</p>" for _ in range(r.randint(1, 2)))
            one.append(f"<{tag}" + (r.choice([' class="comment"', ' class="comment-body"', ' class="reply"', ' id="comment-7"']) if r.random() < 0.7 else "") + f">{who}{said}</{tag}>")
        head = f"<h{r.randint(2, 4)}>{self.words(1, 3)}</h3>" if r.random() < 0.6 else ""
        body = "".join(one)
        body = f"<{r.choice(['ol', 'ul'])}>{body}</ol>" if tag == "li" else body
        return self.box("comment", head + body + (self.form() if r.random() < 0.3 else ""), "section div div aside", 0.97)

    def share(self) -> str:
        return self.box("share", self.links(2, 5), "div ul p", 0.9)

    def block(self) -> str:
        """One block of main text."""
        r = self.rng
        form = r.random()
        if form < 0.68:
            text = self.inline(self.sentences(*r.choice([(1, 1), (1, 4), (1, 4), (3, 9)])))
            if r.random() < 0.15:
                text = f"<b>{text}<br>"
                return f"<p>{MARK}{text}"
            return f"<p{self.attributes('plain', 0.08)}>{MARK}{text}" + ("</p>" if r.random() < 0.93 else "")
        if form < 0.71:
            return f"<p>{MARK}{self.words(1, 3)}</p>"
        if form < 0.79:
            k = r.randint(2, 4)
            return f"<h{k}>{MARK}{self.words(1, 8)}</h{k}>"
        if form < 0.86:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{MARK}{self.inline(self.words(1, 20))}</li>" for _ in range(r.randint(2, 8))) + f"</{tag}>"
        if form < 0.89:
            return f"<blockquote>{MARK}{self.sentences(1, 3)}</blockquote>" if r.random() < 0.5 else f"<blockquote><p>{MARK}{self.sentences(1, 3)}</p></blockquote>"
        if form < 0.91:
            return f"<pre>{MARK}{self.words(3, 30)}</pre>"
        if form < 0.94:
            rows = "".join("<tr>" + "".join(f"<td>{MARK}{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4)))
            return f"<table>{rows}</table>"
        if form < 0.96:
            return f'<figure><img src="x.png" alt="no text"><figcaption>{MARK}{self.words(2, 12)}</figcaption></figure>'
        if form < 0.98:
            return f"<div>{MARK}{self.inline(self.sentences(1, 5))}</div>"
        return f"<section><h2>{MARK}{self.words(1, 5)}</h2>" + "".join(f"<p>{MARK}{self.sentences(1, 4)}</p>" for _ in range(r.randint(1, 3))) + "</section>"

    def article(self) -> str:
        r = self.rng
        title = f"<h1>{MARK}{self.words(1, 12)}</h1>"
        if r.random() < 0.12:
            title = f"<header>{title}</header>"
        parts = [title] if r.random() < 0.85 else []
        if r.random() < 0.25:
            parts.append(r.choice([f"<p class='byline'>{MARK}{self.words(2, 5)}</p>", f"<div>{MARK}{self.words(2, 6)}</div>", f"<time>{MARK}{self.words(1, 3)}</time>", f"<p><i>{MARK}{self.words(2, 8)}</i></p>"]))
        if r.random() < 0.1:
            parts += [f"{MARK}{self.inline(self.sentences(1, 6))}<br><br>" for _ in range(r.randint(1, 5))]
        else:
            parts += [self.block() for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12, 20]))]
        for make, q in ((self.ad, 0.25), (self.share, 0.15), (self.side, 0.15), (self.notice, 0.07), (self.form, 0.07), (self.nav, 0.07)):
            if r.random() < q:
                parts.insert(r.randint(1, len(parts)), make())
        body = "".join(parts)
        if r.random() < 0.05:
            body += self.comments()
        form = r.random()
        if form < 0.4:
            return f"<article{self.attributes('main', 0.3)}>{body}</article>"
        if form < 0.55:
            return f"<main{self.attributes('main', 0.3)}>{body}</main>"
        if form < 0.65:
            return f"<main><article>{body}</article></main>"
        if form < 0.75:
            return f"<section{self.attributes('main', 0.6)}>{body}</section>"
        return f"<div{self.attributes('main', 0.75)}>{body}</div>"

    def page(self) -> str:
        r = self.rng
        wrap = lambda x: self.box("plain", x, "div", 0.9) if r.random() < 0.4 else x
        before = [make() for make, q in ((self.notice, 0.25), (self.header, 0.45), (self.nav, 0.65), (self.ad, 0.4), (self.form, 0.1), (self.side, 0.12), (self.nav, 0.1)) if r.random() < q]
        if r.random() < 0.2:
            r.shuffle(before)
        after = [make() for make, q in ((self.share, 0.15), (self.ad, 0.25), (self.side, 0.35), (self.comments, 0.35), (self.form, 0.15), (self.footer, 0.75), (self.notice, 0.15)) if r.random() < q]
        if r.random() < 0.15:
            r.shuffle(after)
        article = self.article() if r.random() < 0.97 else ""
        if r.random() < 0.1:
            side = self.side() if r.random() < 0.5 else self.nav()
            cells = [f"<td>{side}</td>", f"<td{self.attributes('main', 0.4)}>{article}</td>"]
            if r.random() < 0.3:
                cells.reverse()
            article = f"<table><tr>{''.join(cells)}</tr></table>"
        inside = r.choice(["", "\n"]).join([*before, wrap(article), *after])
        if r.random() < 0.2:
            inside = self.box("plain", inside, "div", 0.95)
        if r.random() < 0.03:
            inside = f'<form action="/">{inside}</form>'
        script = '<script>var t="</p>";run(0);</script>' if r.random() < 0.5 else ""
        page = f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><style>p{{margin:0}}</style>{script}</head><body>{inside}"
        return page + ("</body></html>" if r.random() < 0.9 else "")
