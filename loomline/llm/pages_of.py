"""Generated web pages with their main text, to fit the classifier of page blocks on."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

SYLLABLES = "ka lo mi ter an sel ou ne ri va do pen ga tu sha li mor ec un os ha bel cri wen thi ar".split()


class Writer:
    """Random words, and pages made of them."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        text = self.words(low, high).capitalize()
        if self.r.random() < 0.3:
            text = text.replace(" ", ", ", 1)
        return text + self.r.choice("....?!")

    def text(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def links(self, n: int, shape: str = "<li>{}</li>") -> str:
        return "".join(shape.format(f'<a href="/{self.word()}">{self.words(1, 3).capitalize()}</a>') for _ in range(n))

    def one(self, *choices: str | Callable[[], str]) -> str:
        c = self.r.choice(choices)
        return c if isinstance(c, str) else c()

    def maybe(self, chance: float, make: Callable[[], str]) -> str:
        return make() if self.r.random() < chance else ""

    # what is no main text

    def menu(self) -> str:
        n = self.r.randint(3, 9)
        return self.one(
            lambda: f"<nav><ul>{self.links(n)}</ul></nav>",
            lambda: f'<div class="{self.r.choice(["menu", "navbar", "main-nav", "topbar links", "navigation"])}">{self.links(n, "{} ")}</div>',
            lambda: f'<ul id="{self.r.choice(["menu", "nav", "navigation"])}">{self.links(n)}</ul>',
            lambda: f'<div role="navigation"><p>{self.words(1, 2)}</p>{self.links(n, "<span>{}</span> | ")}</div>',
        )

    def header(self) -> str:
        name = self.words(1, 3).title()
        inside = self.one(f"<a href='/'>{name}</a>", f"<h1>{name}</h1>", f"<h1><a href='/'>{name}</a></h1><p>{self.sentence()}</p>", f"<p>{name}</p><span>{self.sentence()}</span>", f"<div>{self.text(1, 2)}</div>")
        return self.one(f"<header>{inside}{self.maybe(0.4, self.menu)}</header>", f'<div id="header">{inside}</div>', f'<div class="masthead">{inside}</div>', f'<div role="banner">{inside}</div>', f'<header class="site-header">{inside}</header>', f'<div class="site-header">{inside}</div>')

    def advert(self) -> str:
        name = self.r.choice(["ad", "ads", "advert", "advertisement", "ad-slot", "promo", "sponsored", "banner-ad", "sponsor box"])
        tag = self.r.choice(["div", "div", "aside", "section"])
        return f'<{tag} class="{name}">{self.one(self.text(1, 2), "<p>" + self.text(1, 3) + "</p>", "Advertisement", "<a href=x>" + self.sentence() + "</a>")}</{tag}>'

    def notice(self) -> str:
        name = self.r.choice(["cookie-banner", "cookie-consent", "notice", "alert alert-info", "notification", "gdpr", "popup", "modal"])
        body = self.one("We use cookies. " + self.sentence(), self.text(1, 4), "<p>" + self.text(1, 3) + "</p><button>OK</button>")
        return self.one(f'<div class="{name}">{body}</div>', f'<div id="{name.split()[0]}">{body}</div>', f'<div role="alert">{body}</div>', f"<dialog>{body}</dialog>", f"<noscript>{self.sentence()}</noscript>", f'<div style="display:none">{self.text(1, 3)}</div>')

    def sidebar(self) -> str:
        inside = f"<h3>{self.words(1, 3)}</h3><ul>{self.links(self.r.randint(2, 6))}</ul>" + self.maybe(0.5, lambda: f"<p>{self.text(1, 4)}</p>") + self.maybe(0.3, lambda: f"<ul><li>{self.sentence()}</li><li>{self.words(2, 5)}</li></ul>")
        return self.one(f"<aside>{inside}</aside>", f'<div id="sidebar">{inside}</div>', f'<div class="widget-area sidebar">{inside}</div>', f'<div class="right-rail">{inside}</div>', f'<div role="complementary">{inside}</div>', f'<section class="widget">{inside}</section>')

    def related(self) -> str:
        cards = "".join(f"<article class='card'><h3><a href=/{self.word()}>{self.sentence()}</a></h3><p>{self.sentence()}</p></article>" for _ in range(self.r.randint(1, 3)))
        return self.one(f'<div class="related"><h4>Related</h4><ul>{self.links(4)}</ul></div>', f'<section class="related-posts">{cards}</section>', f'<div class="recommended"><p>{self.words(2, 4)}</p>{self.links(3, "<p>{}</p>")}</div>', f'<section class="more-stories"><h2>{self.words(1, 3)}</h2>{cards}</section>')

    def form(self) -> str:
        inside = self.one(f"<label>{self.words(1, 4)}</label><input name=q><button>Go</button>", f"<p>Subscribe to our newsletter. {self.sentence()}</p><input><select><option>a</option></select>", f"<h3>{self.words(2, 4)}</h3><p>{self.text(1, 2)}</p><input type=submit>")
        return self.one(f"<form action=/s>{inside}</form>", f'<form class="newsletter">{inside}</form>', f'<div class="newsletter-signup">{inside}</div>', f'<div class="login">{inside}</div>')

    def comments(self) -> str:
        n = self.r.randint(1, 6)
        one = lambda: self.one(f"<p>{self.text(1, 6)}</p>", f"<div class=comment><b>{self.word()}</b><p>{self.text(1, 4)}</p></div>", f"<li>{self.word()}: {self.text(1, 3)}</li>")
        body = "".join(one() for _ in range(n))
        own = "".join(f"<li><article class='comment-body'><p>{self.text(1, 5)}</p></article></li>" for _ in range(n))
        return self.one(f'<section id="comments"><h2>{n} comments</h2>{body}</section>', f'<div class="comments">{body}</div>', f'<ol class="comment-list">{own}</ol>', f'<div id="disqus_thread">{body}</div>', f'<div class="reader-comments"><h3>{self.words(1, 3)}</h3>{body}{self.maybe(0.5, self.form)}</div>', f'<section class="post-comments">{body}</section>', f'<div class="discussion">{body}</div>')

    def social(self) -> str:
        tag, shape = self.r.choice([("ul", "<li>{}</li>"), ("div", "{} ")])
        return f'<{tag} class="{self.r.choice(["share", "social", "share-buttons", "social-links", "tags"])}">{self.links(3, shape)}</{tag}>'

    def crumbs(self) -> str:
        return f'<div class="breadcrumbs">{self.links(2, "{} &gt; ")}{self.words(1, 4)}</div>'

    def footer(self) -> str:
        inside = self.one(f"&copy; {self.word()}.com &middot; {self.text(1, 2)}", f"<p>Copyright 20{self.r.randint(10, 29)} {self.words(1, 4)}. All rights reserved.</p>", f"<ul>{self.links(4)}</ul><p>{self.text(1, 3)}</p>", f"<p>{self.text(1, 3)}</p>")
        return self.one(f"<footer>{inside}</footer>", f'<div id="footer">{inside}</div>', f'<div class="site-footer">{inside}</div>', f'<div role="contentinfo">{inside}</div>', f"<p>&copy; {self.words(1, 4)}</p>")

    def beside(self) -> str:
        return self.one(self.advert, self.notice, self.sidebar, self.related, self.form, self.social, self.crumbs, self.menu)

    # main text: (html, blocks)

    def paragraph(self) -> tuple[str, list[str]]:
        r, kind = self.r, self.r.random()
        if kind < 0.5:
            t = self.text(1, 7)
            return self.one(f"<p>{t}</p>", f"<p>{t}", f"<p class='{self.word()}'>{t}</p>"), [t]
        if kind < 0.58:
            t = self.one(self.sentence(1, 3), self.words(1, 3).capitalize() + ".", self.words(1, 2))
            return f"<p>{t}</p>", [t]
        if kind < 0.68:
            a, b, c = self.sentence(), self.words(1, 4), self.sentence()
            return f'<p>{a} <a href="/{self.word()}">{b}</a> <em>{c}</em></p>', [f"{a} {b} {c}"]
        if kind < 0.75:
            t = self.words(2, 7).capitalize()
            return self.one(f"<h2>{t}</h2>", f"<h3>{t}</h3>"), [t]
        if kind < 0.82:
            items = [self.one(self.sentence(2, 12), self.words(1, 5)) for _ in range(r.randint(2, 5))]
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{i}</li>" for i in items) + f"</{tag}>", items
        if kind < 0.86:
            t = self.text(1, 3)
            return self.one(f"<blockquote>{t}</blockquote>", f"<blockquote><p>{t}</p></blockquote>", f"<pre>{t}</pre>"), [t]
        if kind < 0.9:
            t = self.sentence()
            return f"<figure><img src=x><figcaption>{t}</figcaption></figure>", [t]
        if kind < 0.94:
            cells = [self.words(1, 4) for _ in range(4)]
            return "<table>" + "".join(f"<tr><td>{cells[i]}</td><td>{cells[i + 1]}</td></tr>" for i in (0, 2)) + "</table>", cells
        t = self.text(1, 5)
        return self.one(f"<div>{t}</div>", f'<div class="{self.word()}">{t}</div>', f"<p><math><mi>{t}</mi></math></p>", f"<section><p>{t}</p></section>"), [t]

    def body(self) -> tuple[str, list[str]]:
        parts, blocks = [], []
        for _ in range(self.r.choice([1, 2, 3, 5, 8, 12])):
            h, b = self.paragraph()
            parts.append(h)
            blocks += b
            if self.r.random() < 0.07:
                parts.append(self.one(self.advert, self.related, self.social, self.form, lambda: f"<aside><h4>{self.words(1, 3)}</h4><ul>{self.links(2)}</ul></aside>"))
        return "".join(parts), blocks

    def article(self) -> tuple[str, list[str]]:
        body, blocks = self.body()
        title = self.words(2, 9).capitalize() + self.r.choice(["", ".", "?"])
        by = f"By {self.words(1, 2).title()}"
        tail = self.maybe(0.15, lambda: f"<footer>{self.social()}</footer>") + self.maybe(0.12, self.comments)
        shape = self.r.randrange(16)
        if shape < 4:
            return f"<article><h1>{title}</h1>{body}{tail}</article>", [title, *blocks]
        if shape == 4:
            return f"<main><h1>{title}</h1>{body}</main>", [title, *blocks]
        if shape == 5:
            return f'<div id="{self.r.choice(["content", "main", "main-content"])}"><h1>{title}</h1>{body}</div>', [title, *blocks]
        if shape == 6:
            return f'<div class="post"><h1>{title}</h1><div class="entry-content">{body}</div>{tail}</div>', [title, *blocks]
        if shape == 7:
            return f'<article class="post"><header class="{self.r.choice(["entry-header", "post-header", "x"])}"><h1>{title}</h1><p>{by}</p></header><div class="entry-content">{body}</div>{tail}</article>', [title, by, *blocks]
        if shape == 8:
            return f'<article><div class="{self.r.choice(["article-header", "header", "heading", "article__head"])}"><h1>{title}</h1></div>{body}</article>', [title, *blocks]
        if shape == 9:
            return f"<article><header><h1>{title}</h1></header>{body}{tail}</article>", [title, *blocks]
        if shape == 10:
            return f"<h1>{title}</h1>{body}", [title, *blocks]
        if shape == 11:
            return f'<main><h1>{title}</h1><article>{body}</article></main>', [title, *blocks]
        if shape == 12:
            return f'<div><h1>{title}</h1><div class="text">{body}</div></div>', [title, *blocks]
        if shape == 13:
            return f"<table><tr><td>{self.menu()}</td><td><h1>{title}</h1>{body}</td></tr></table>", [title, *blocks]
        if shape == 14:
            return f'<article>{body}</article>', blocks
        return f'<div itemprop="articleBody"><h2>{title}</h2>{body}</div>', [title, *blocks]

    def page(self) -> tuple[str, list[str]]:
        html, blocks = self.article()
        for _ in range(self.r.choice([0, 0, 1, 2])):
            name = self.one("reviews", "legal-news", "site-content header-image", "page", "wrapper", "has-sidebar", "container", "row", "content-with-sidebar", "no-ads", "col-8", "comments-open")
            html = self.one(f'<div class="{name}">{html}</div>', f'<div id="{self.word()}">{html}</div>', f'<section class="{name}">{html}</section>')
            if self.r.random() < 0.3:
                html = self.one(html + self.sidebar(), self.sidebar() + html)
        if self.r.random() < 0.1:
            html = f'<form method="post" action="/page.aspx"><input type=hidden>{html}</form>'
        before = "".join(self.maybe(0.5, x) for x in (self.header, self.menu, self.advert, self.notice)) + self.maybe(0.3, self.beside)
        after = "".join(self.maybe(0.35, x) for x in (self.related, self.comments, self.sidebar, self.form, self.social)) + self.maybe(0.8, self.footer) + self.maybe(0.2, self.notice)
        if self.r.random() < 0.1:
            before, html = "", f"<form id='aspnetForm'>{before}{html}" + "</form>"
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 4)}</title></head><body>{before}{html}{after}</body></html>", blocks


def generated(seed: int, n: int) -> Iterator[tuple[str, list[str]]]:
    """(page, blocks of its main text) of n pages."""
    writer = Writer(seed)
    for _ in range(n):
        yield writer.page()
