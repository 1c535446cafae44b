"""Labelled pages to train the extractor on: layouts of several families, made from a seed.

named: role words in class and id, semantic tags or not. hashed: class names that say nothing. bare: no class, no id, no semantic
tags. table: nested layout tables. lists: an article mostly of lists, definitions, code and headings. thread: a first post
with replies under it. headed: an article and readers' comments in containers without names that tell, under a heading that does. short: a few
paragraphs and hardly anything else. Texts of the article begin with MARK; the extractor's training reads the labels from it and takes it off."""

from __future__ import annotations

import random

MARK = "\ue000"  # of the private use area

#: Class and id words by the role of what they name.
ROLES = {
    "article": ["article", "post", "entry", "content", "story", "main-content", "article-body", "post-content", "entry-content", "text", "body-text",
        "page-content"],
    "nav": ["nav", "menu", "navbar", "main-nav", "navigation", "topmenu", "breadcrumb", "breadcrumbs", "pagination", "toc"],
    "header": ["header", "site-header", "masthead", "branding", "top-bar", "page-header", "logo"],
    "footer": ["footer", "site-footer", "bottom", "colophon", "copyright", "legal", "page-footer"],
    "sidebar": ["sidebar", "aside", "widget", "related", "rail", "side", "secondary", "popular", "more-stories", "recommended"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot", "partner"],
    "notice": ["cookie", "cookie-notice", "consent", "notice", "banner", "alert", "gdpr", "popup", "modal", "paywall", "privacy"],
    "comments": ["comments", "comment", "comment-list", "discussion", "replies", "disqus", "responses", "reader-comments"],
    "share": ["share", "social", "sharing", "tools", "follow", "meta", "byline", "tags"],
    "form": ["search", "newsletter", "subscribe", "signup", "login", "contact-form", "form"],
    "plain": ["wrap", "container", "row", "col", "inner", "layout", "page", "grid", "outer", "block"],
}
#: What boilerplate says, by role; words that are made up stand for {}.
SAYINGS = {
    "nav": ["Home", "About us", "Contact", "Log in", "Sign up", "News", "Products", "Menu", "Next page", "Back to top"],
    "header": ["Welcome to {}", "{} | {}", "The {} blog", "Skip to content"],
    "footer": ["&copy; 2024 {}. All rights reserved.", "Copyright 2019-2024 {} Inc.", "Terms of service | Privacy policy",
        "{} is a registered trademark of {}.", "Powered by {}", "Impressum", "Mentions l&eacute;gales", "Todos los derechos reservados."],
    "sidebar": ["Related articles", "Most popular", "You may also like", "Read more", "Recent posts", "Archives", "Recommended for you", "Tags"],
    "ad": ["Advertisement", "Sponsored content", "Advertisement: {} {}", "Sponsored by {}", "Buy now and save 20%", "Anzeige", "Publicidad"],
    "notice": ["We use cookies to improve your experience.", "Accept all cookies", "By using this site you agree to our privacy policy.",
        "Subscribe to read the full {}.", "Your browser is out of date.", "Wir verwenden Cookies.", "Utilizamos cookies."],
    "comments": ["Comments", "3 comments", "Leave a reply", "{} says: {} {}", "Reply", "Log in to comment", "Posted by {} 2 hours ago"],
    "heading": ["Comments", "Comments", "3 comments", "Comments (12)", "27 Comments", "Reader comments", "Leave a comment", "Replies", "4 replies",
        "Responses", "5 responses", "Discussion", "Join the discussion", "Kommentare", "Commentaires", "Comentarios", "Leave a reply"],
    "share": ["Share this", "Tweet", "Share on {}", "Follow us on {}", "Posted on 2024-01-15 by {}", "Filed under {}", "Print", "5 min read"],
    "form": ["Search", "Subscribe to our newsletter", "Your email address", "Submit", "Enter your name"],
}
TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"],
    "ad": ["div", "aside", "section"], "notice": ["div", "section", "p"], "comments": ["section", "div", "ol"], "share": ["div", "ul", "p"], "form": ["form"]}
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve é ü ß ción ñ ç eau".split()


class Maker:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.choice([1, 1, 2, 2, 3, 4]))) + (self.rng.choice(["%%%", "***", "&amp;",
            "&eacute;", "!!"]) if self.rng.random() < self.odd else "")

    odd, family = 0.0, "named"

    def sentence(self) -> str:
        rng, r = self.rng, self.rng.random()
        text = " ".join(self.word() for _ in range(rng.randrange(1, 18)))
        if r < 0.08:
            return f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} {text}."
        if r < 0.14:
            return f"{text} {rng.randrange(10**rng.randrange(1, 9))}"
        if r < 0.2:
            return rng.choice([text, text.upper(), text.replace(" ", " | ")])
        return text.capitalize() + rng.choice(".....!?:")

    def sentences(self, n: int) -> str:
        return " ".join(self.sentence() for _ in range(n))

    def inline(self, text: str) -> str:
        r = self.rng.random()
        if r < 0.12:
            return f'{text} <a href="/{self.word()}">{self.word()} {self.word()}</a> {self.sentences(1)}'
        if r < 0.2:
            return f"<b>{text}</b>"
        if r < 0.28:
            return f"<em>{text}</em> {self.sentences(1)}"
        return text

    def saying(self, role: str) -> str:
        said = self.rng.choice(SAYINGS[role])
        while "{}" in said:
            said = said.replace("{}", self.word(), 1)
        return said

    def named(self, role: str) -> str:
        if self.family in ("bare", "table"):
            return ""
        if self.family == "headed" and self.rng.random() < 0.4:
            return ""
        if self.family in ("hashed", "headed"):
            rng = self.rng
            name = rng.choice(["css-", "sc-", "_", "x", "jsx-"]) + "".join(rng.choice("abcdefghijkmnpqrstuvwxyz0123456789")
                for _ in range(rng.choice([5, 6, 8])))
            return f' class="{name}"'
        r, name = self.rng.random(), self.rng.choice(ROLES[role])
        return f' class="{name}"' if r < 0.6 else f' id="{name}"' if r < 0.75 else f' class="{name} {self.rng.choice(ROLES["plain"])}"' if r < 0.85 else ""

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{self.word()}">{self.word()}{" " + self.word() if self.rng.random() < 0.4 else ""}</a></li>' for _ in range(n))

    def boiler(self, role: str) -> str:
        rng = self.rng
        said = self.family not in ("named", "lists") or rng.random() < 0.4  # without names that tell, words must
        tag = rng.choice(TAGS[role]) if self.family in ("named", "lists", "thread") or rng.random() < 0.15 and self.family in ("hashed", "headed",
            "short") else rng.choice(["div", "div", "ul"]) if role in ("nav", "share") else "form" if role == "form" else "div"
        if self.family in ("named", "lists", "thread"):
            named = self.named(role) if tag in ("nav", "header", "footer", "aside", "form") else f' class="{rng.choice(ROLES[role])}"'
        else:
            named = self.named(role)
        short = self.sentences(rng.choice([1, 1, 1, 2, 3])) if not said else " ".join([self.saying(role), *([self.sentence()] if rng.random() < 0.3 else [])])
        if role == "nav":
            inner = self.links(rng.randrange(2, 9)) if tag == "ul" else f"<ul>{self.links(rng.randrange(2, 9))}</ul>"
            if said:
                inner = f'<li><a href="/">{self.saying("nav")}</a></li>' + inner if tag == "ul" else inner.replace("<ul>",
                    f'<ul><li><a href="/">{self.saying("nav")}</a></li>', 1)
        elif role == "header":
            inner = rng.choice([f"<a href='/'>{self.word()}</a>", f"<h1>{self.word()} {self.word()}</h1><p>{short}</p>", f"<div>{short}</div>",
                f"<h2>{self.word()}</h2>" + f"<ul>{self.links(4)}</ul>"])
        elif role == "footer":
            inner = rng.choice([f"&copy; {self.word()}.example &middot; {short}", f"<p>&copy; 2024 {short}</p>", f"<ul>{self.links(4)}</ul><p>{short}</p>",
                f"<small>{short}</small>"])
        elif role == "sidebar":
            inner = f"<h3>{self.saying(role) if said else self.word()}</h3>" + rng.choice([f"<ul>{self.links(5)}</ul>", f"<p>{short}</p>",
                f"<div><a href='/x'>{short}</a></div><p>{self.sentences(2)}</p>"])
        elif role == "comments":
            item = "li" if tag == "ol" else rng.choice(["div", "p", "article"])
            inner = ("" if tag == "ol" else f"<h3>{self.saying(role) if said else self.word()}</h3>")
            inner += "".join(f'<{item} class="comment"><b>{self.word()}</b> {self.sentences(rng.randrange(1, 5))}</{item}>' for _ in range(rng.randrange(1, 5)))
        elif role == "share":
            inner = self.links(4) if tag == "ul" else short if said else rng.choice([f"<a href='#'>{self.word()}</a> <a href='#'>{self.word()}</a>",
                self.word() + " " + self.word()])
        elif role == "form":
            inner = f"<label>{self.saying(role) if said else self.word()}</label><input name='q'><p>{short}</p><button>{self.word()}</button>"
        elif tag == "p":
            inner = rng.choice([short, f"<a href='/go'>{short}</a>"])
        else:
            inner = rng.choice([short, f"<p>{short}</p>", f"<a href='/go'>{short}</a>", f"<span>{short}</span> <button>{self.word()}</button>"])
        return f"<{tag}{named}>{inner}</{tag}>"

    def comments(self) -> str:
        """Readers' comments of any shape under a heading, in containers whose names tell nothing."""
        rng = self.rng
        name = lambda: rng.choice(["", self.named("plain")])
        head = rng.choice(["h2", "h3", "h3", "h4", "div", "p", "b"])
        tag, item = rng.choice([("div", "div"), ("div", "div"), ("ul", "li"), ("ol", "li"), ("div", "article"), ("section", "div"), ("div", "p")])
        shape = rng.randrange(5)

        def one() -> str:
            who, text = f"{self.word()} {self.word()}" if rng.random() < 0.5 else self.word(), self.sentences(rng.randrange(1, 6))
            if item == "p" or shape == 0:
                return f"<{item}{name()}><b>{who}</b> {text}</{item}>"
            if shape == 1:
                return f"<{item}{name()}><div{name()}>{who}</div><p>{text}</p></{item}>"
            if shape == 2:
                return f"<{item}{name()}><p>{text}</p></{item}>"
            if shape == 3:
                return f"<{item}{name()}><span>{who}</span> <small>{rng.randrange(1, 28)} May</small><div{name()}>{text}</div><a href='#'>{self.word()}</a></{item}>"
            return f"<{item}{name()}>{text}</{item}>"

        inner = "".join(one() for _ in range(rng.randrange(1, 7)))
        heading = f"<{head}{name()}>{self.saying('heading')}</{head}>"
        inner = heading + (f"<{tag}>{inner}</{tag}>" if tag in ("ul", "ol") or rng.random() < 0.4 else inner)
        return f"<{'div' if tag in ('ul', 'ol') else tag}{name()}>{inner}</{'div' if tag in ('ul', 'ol') else tag}>"

    def paragraph(self) -> str:
        rng = self.rng
        text = MARK + self.sentences(rng.choice([1, 1, 2, 3, 5, 8]))
        if rng.random() < 0.05 and self.family in ("named", "lists", "thread"):  # articles say such things too
            text = MARK + self.saying(rng.choice([role for role in SAYINGS if role != "heading"]))
        r = rng.random()
        if r < 0.08:
            return f"<p><b>{text}<br>"
        if r < 0.15:
            return f"<p>{text}"
        if r < 0.22:
            return f"<div>{self.inline(text)}</div>"
        return f"<p>{self.inline(text)}</p>"

    def other(self) -> str:
        rng, line = self.rng, lambda: MARK + self.sentences(1)
        return rng.choice([
            lambda: f"<h{rng.randrange(2, 5)}>{MARK}{self.word()} {self.word()}</h2>",
            lambda: "<ul>" + "".join(f"<li>{line()}</li>" for _ in range(rng.randrange(1, 5))) + "</ul>",
            lambda: "<ol>" + "".join(f"<li>{line()}" for _ in range(rng.randrange(1, 5))) + "</ol>",
            lambda: f"<blockquote><p>{line()}</p></blockquote>",
            lambda: "<table>" + "".join(f"<tr><td>{MARK}{self.word()}</td><td>{line()}</td></tr>" for _ in range(2)) + "</table>",
            lambda: f"<figure><img src='a.png' alt='x'><figcaption>{line()}</figcaption></figure>",
            lambda: f"<pre>{line()}</pre>",
        ])()

    def parts(self) -> list[str]:
        """The blocks of an article."""
        rng = self.rng
        out = [f"<h1>{MARK}{' '.join(self.word() for _ in range(rng.randrange(2, 10)))}</h1>"] if rng.random() < 0.85 else []
        plain = 0.3 if self.family == "lists" else 0.85
        for _ in range(rng.choice([1, 2, 4, 6, 9, 14]) + 3 * (self.family == "lists")):
            out.append(self.paragraph() if rng.random() < plain else self.other())
            if rng.random() < 0.06 and self.family not in ("bare", "table"):
                out.append(self.boiler(rng.choice(["ad", "sidebar", "share", "notice", "form"])))
        return out

    def article(self) -> str:
        rng = self.rng
        inner = "".join(self.parts())
        if self.family == "headed":
            tag = rng.choice(["div", "div", "article", "main", "section"])
            return f"<{tag}{self.named('article')}>{inner}</{tag}>"
        if self.family in ("hashed", "bare"):
            inner = f"<div{self.named('plain')}>{inner}</div>"
            return f"<div{self.named('article')}>{inner}</div>" if rng.random() < 0.7 or self.family == "bare" else f"<article{self.named('article')}>{inner}</article>"
        wrapped = rng.random()
        if wrapped < 0.5:
            return f"<article{self.named('article') if rng.random() < 0.4 else ''}>{inner}</article>"
        if wrapped < 0.65:
            return f"<main><div{self.named('article')}>{inner}</div></main>"
        if wrapped < 0.75:
            return f"<main>{inner}</main>"
        return f'<div class="{rng.choice(ROLES["article"])}">{inner}</div>'

    def body(self) -> str:
        rng = self.rng
        before = [self.boiler(r) for r in ("notice", "header", "nav", "ad", "form") if rng.random() < 0.55]
        after = [self.boiler(r) for r in ("share", "sidebar", "comments", "ad", "nav", "form", "notice") if rng.random() < 0.4]
        foot = self.boiler("footer") if rng.random() < 0.85 else ""
        if self.family == "table":
            side = "".join(self.boiler(r) for r in ("nav", "sidebar", "ad") if rng.random() < 0.6)
            cells = [f"<td width=150>{side}</td>" if side else "", f"<td>{''.join(self.parts())}</td>",
                f"<td>{''.join(after)}</td>" if after and rng.random() < 0.5 else ""]
            if rng.random() < 0.3:
                cells = cells[::-1]
            head = f"<tr><td colspan=3>{''.join(before)}</td></tr>" if before else ""
            return f"<table width=100%>{head}<tr valign=top>{''.join(cells)}</tr>" + (f"<tr><td colspan=3>{foot}</td></tr>" if foot else "") + "</table>"
        if self.family == "short":
            inner = "".join(self.paragraph() for _ in range(rng.choice([1, 1, 1, 2, 3])))
            head = rng.choice(["", "", f"<h1>{MARK}{self.word()} {self.word()}</h1>"])
            return rng.choice([head + inner, f"<div>{head}{inner}</div>", f"<article>{head}{inner}</article>", f"{head}{inner}{foot}"])
        if self.family == "headed":
            after = [self.boiler(r) for r in ("share", "sidebar", "ad", "form") if rng.random() < 0.25]
            both = [self.article(), *after[: len(after) // 2], self.comments(), *after[len(after) // 2 :]]
            middle = f"<div{self.named('plain')}>{''.join(both)}</div>" if rng.random() < 0.5 else "".join(both)
            return f"{''.join(before)}{middle}{foot}"
        if self.family == "thread":
            replies = "".join(f'<div class="{rng.choice(["reply", "comment", "response"])}"><b>{self.word()}</b> <p>{self.sentences(rng.randrange(1, 6))}</p></div>' for _ in range(rng.randrange(1, 8)))
            first = f'<div class="{rng.choice(["post", "question", "article"])}">{"".join(self.parts())}</div>'
            return f'{"".join(before)}<div>{first}<div class="{rng.choice(["replies", "comments", "responses"])}">{replies}</div></div>{foot}'
        if rng.random() < 0.3:
            before.append(self.boiler("sidebar"))
        middle = self.article()
        if rng.random() < 0.35:
            middle = f"<div{self.named('plain')}>{middle}{''.join(after)}</div>"
            after = []
        return f"{''.join(before)}<!-- x -->{middle}{''.join(after)}{foot}"

    def page(self, family: str = "named") -> str:
        rng = self.rng
        self.family, self.odd = family, rng.choice([0, 0, 0, 0.5])
        inline = rng.choice(["<style>p{margin:0}</style>", "", "<style>.a{color:red}</style>", '<link rel="stylesheet" href="/s.css">'])
        script = rng.choice(["<script>var t='</p>';</script>", "", '<script src="/a.js"></script>', "<script>if (a<b) { track(1); }</script>"])
        return f"<!DOCTYPE html><html><head><title>{self.word()}</title>{inline}{script}</head><body>{self.body()}" + ("</body></html>"
            if rng.random() < 0.9 else "")


#: Families of layouts and how many pages of each are trained on.
FAMILIES = {"named": 450, "hashed": 140, "bare": 140, "table": 80, "lists": 50, "thread": 60, "headed": 140, "short": 160}


def labelled_pages(pages: dict[str, int] | None = None, seed: int = 11) -> list[str]:
    make = Maker(random.Random(seed))
    return [make.page(family) for family, n in (FAMILIES if pages is None else pages).items() for _ in range(n)]
