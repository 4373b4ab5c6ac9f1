"""Labelled pages: layouts whose parts are labelled by hand, filled with words of the corpus at hand.

No table has labelled pages, so these are made: a layout says which parts a page has, how they nest and what they are called,
and ``data-main`` marks each part as main text or not. The words come from a bounded sample of the pages (or, without any,
from a short list), so that lengths and punctuation are those of the corpus; names are drawn from usual ones, and some
are meaningless, so that no single name decides.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages whose words fill the layouts, about, and characters of each.
SAMPLE, SAMPLE_CHARS = 200, 4000

# What parts of pages are usually called, and what stands in them.
FILLER = "the of and to in that it is was for on are as with they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she".split()
ARTICLE_NAMES = "article post entry content story main post-body entry-content article-body articleBody page-content post_content text body-text blog-post news-text".split()
MENU_NAMES = "nav menu navbar main-menu topnav navigation breadcrumb breadcrumbs site-nav sub-menu pagination pager skip-links".split()
HEAD_NAMES = "header site-header masthead top banner page-header branding logo topbar".split()
FOOT_NAMES = "footer site-footer foot bottom colophon page-footer copyright credits".split()
SIDE_NAMES = "sidebar side widget widget-area right-column rail secondary related related-posts recommended more-stories trending popular most-read tags share social author-box promo-links".split()
AD_NAMES = "ad ads advert advertisement sponsored banner-ad promo ad-slot google-ad sponsor adsbox teaser-ad commercial".split()
NOTICE_NAMES = "cookie cookie-banner cookie-notice notice alert gdpr consent privacy-notice message warning popup modal overlay paywall subscribe-notice disclaimer".split()
FORM_NAMES = "newsletter signup search search-form subscribe contact-form login comment-form respond feedback poll".split()
COMMENT_NAMES = "comments comment comment-list commentlist disqus discussion replies reply reader-comments responses comment-body user-comments".split()
BARE_NAMES = "box col-8 row wrapper inner c1 x-27 module left grid container section-2 block item".split()
SHORT = {
    "menu": "Home;News;About us;Contact;Sports;Products;Archive;Login;Next page;Previous;Start;Accueil;Inicio;Startseite;Impressum".split(";"),
    "notice": "We use cookies to improve this site.;This site uses cookies. Accept all or manage preferences.;Your browser is out of date.;You have read 3 of 5 free articles this month.;Please enable JavaScript.;Wir verwenden Cookies.;Nous utilisons des cookies.;Este sitio utiliza cookies.".split(";"),
    "ad": "Advertisement;Sponsored;Buy now and save 50 %;Anzeige;Publicité;Publicidad;Limited offer, click here!".split(";"),
    "form": "Subscribe to our newsletter;Your e-mail;Search;Send;Leave a reply;Name;Password;Sign up now;Post comment".split(";"),
    "side": "Related stories;Most read;Share this;Tags;Follow us on social media;Recent posts;About the author;You may also like;Trending now".split(";"),
    "foot": "All rights reserved.;Privacy policy;Terms of use;© 2024 Example Ltd.;Copyright 2023;Back to top;© example.org · Impressum".split(";"),
    "comment": "Reply;Report;3 comments;2 hours ago;Great article, thanks!;I do not agree at all.;Comments (12);Load more comments".split(";"),
}


class Maker:
    """Draws labelled pages; the same seed and words give the same pages."""

    def __init__(self, words: list[str], seed: int = 13):
        self.rng, self.words = random.Random(seed), words or FILLER

    def some(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        at = self.rng.randrange(max(1, len(self.words) - n))
        text = " ".join(self.words[at : at + n]) or "word"
        return text[0].upper() + text[1:]

    def prose(self) -> str:
        """A paragraph, now and then a very short one; some with links, breaks and marks in them."""
        r = self.rng
        text = self.some(*r.choice([(1, 2), (2, 8), (8, 25), (25, 90), (25, 90), (60, 150)]))
        text = text if text[-1] in ".!?" or r.random() < 0.1 else text + "."
        if r.random() < 0.2:
            a, _, b = text.partition(" ")
            text = f'<a href="/x">{a}</a> {b}'
        if r.random() < 0.2:
            text = f"<b>{text}<br>" if r.random() < 0.5 else f"<em>{text}</em>"
        return text

    def short(self, kind: str) -> str:
        return self.rng.choice(SHORT[kind]) if self.rng.random() < 0.5 else self.some(1, 12)

    def open(self, names: list[str], tags: list[str], main: int | None = None) -> tuple[str, str]:
        """A start tag and its end tag: a telling element without a name, or a plain one with a name."""
        r = self.rng
        tag = r.choice(tags)
        name = r.choice(names)
        if r.random() < 0.3:
            name += " " + r.choice(BARE_NAMES)
        how = "" if tag not in ("div", "section", "ul", "p", "table", "span") and r.random() < 0.5 else f' {r.choice(["class", "class", "id"])}="{name}"'
        mark = "" if main is None else f' data-main="{main}"'
        return f"<{tag}{how}{mark}>", f"</{tag}>"

    def links(self) -> str:
        r = self.rng
        items = [f'<a href="/{k}">{self.short("menu")}</a>' for k in range(r.randint(1, 8))]
        if r.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return r.choice([" | ", " ", " · "]).join(items)

    def part(self, kind: str) -> str:
        """A part that is not main."""
        r = self.rng
        texts = lambda low, high: "".join(f"<{t}>{self.prose() if r.random() < 0.5 else self.short(kind)}</{t}>" for t in r.choices(["p", "p", "div", "span", "li", "h3"], k=r.randint(low, high)))
        names, tags, inner = {
            "menu": (MENU_NAMES, ["nav", "nav", "div", "ul"], self.links),
            "head": (HEAD_NAMES, ["header", "header", "div"], lambda: r.choice([f"<h1>{self.some(1, 4)}</h1>", f"<div>{self.some(1, 5)}</div>", f"<p>{self.some(2, 8)}</p>", ""]) + (self.part("menu") if r.random() < 0.5 else self.some(1, 3))),
            "foot": (FOOT_NAMES, ["footer", "footer", "div"], lambda: r.choice([self.links(), self.short("foot"), f"&copy; {self.some(1, 3)} &middot; {self.some(3, 14)}.", texts(1, 3)])),
            "side": (SIDE_NAMES, ["aside", "aside", "div", "section"], lambda: f"<h3>{self.short('side')}</h3>" + r.choice([self.links(), texts(1, 3)])),
            "ad": (AD_NAMES, ["div", "div", "aside", "section"], lambda: r.choice([self.short("ad"), self.prose(), texts(1, 2)])),
            "notice": (NOTICE_NAMES, ["div", "div", "section", "dialog", "p"], lambda: r.choice([self.short("notice"), self.short("notice"), self.some(5, 30)]) + r.choice(["", "<button>OK</button>"])),
            "form": (FORM_NAMES, ["form", "form", "div"], lambda: f"<label>{self.short('form')}</label><input><button>{self.short('form')}</button>" + texts(0, 1)),
            "comment": (COMMENT_NAMES, ["section", "div", "ol", "ul"], lambda: f"<h3>{self.short('comment')}</h3>" + "".join(self.remark() for _ in range(r.randint(1, 4)))),
        }[kind]
        begin, end = self.open(names, tags, 0)
        return begin + inner() + end

    def remark(self) -> str:
        r = self.rng
        return r.choice(['<div class="comment">{}</div>', "<li>{}</li>", "<article>{}</article>", "<div>{}</div>"]).format(f"<p>{self.some(1, 2)}</p><p>{self.prose()}</p>")

    def body(self) -> str:
        """The article: a heading, paragraphs and what else articles hold, with a part in between that is none of it."""
        r = self.rng
        out = []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            out.append(r.choices(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<h2>{}</h2><p>{}</p>", "<blockquote>{}</blockquote>", "<ul><li>{}</li><li>{}</li></ul>", "<pre>{}</pre>", "<figure><img src=x><figcaption>{}</figcaption></figure>", "<table><tr><td>{}</td><td>{}</td></tr></table>"], weights=[12, 3, 2, 2, 1, 1, 0.5, 0.7, 0.5])[0])
            out[-1] = re.sub(r"\{\}", lambda _: self.prose(), out[-1])
            if r.random() < 0.2:
                out.append(self.part(r.choice(["ad", "side", "form", "notice"])))
        return "".join(out)

    def page(self) -> str:
        r = self.rng
        title = self.some(3, 12)
        some = lambda kinds, p: [self.part(k) for k in kinds if r.random() < p]
        before = some(["notice", "head", "menu", "ad", "menu", "form"], 0.4)
        after = some(["comment", "side", "ad", "form", "foot", "notice"], 0.4)
        if r.random() < 0.5:
            r.shuffle(before)
        begin, end = self.open(ARTICLE_NAMES, ["article", "article", "article", "main", "div", "div", "section", "td"], 1)
        if begin.startswith("<td"):
            begin, end = f"<table><tr><td data-main=0>{self.links()}</td>{begin}", f"{end}</tr></table>"
        head = f"<h1>{title}</h1>"
        if r.random() < 0.2:
            head = f"<header>{head}</header>"
        inside = some(["comment", "side"], 0.12)
        core = begin + (head if r.random() < 0.9 else "") + self.body() + "".join(inside) + end
        if r.random() < 0.3:
            core = f'<div class="{r.choice(BARE_NAMES)}">{core}{self.part("side") if r.random() < 0.5 else ""}</div>'
        if r.random() < 0.2:
            core = f'<main id="{r.choice(BARE_NAMES)}">{core}</main>'
        closing = "</body></html>" if r.random() < 0.9 else ""
        return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>p{{}}</style><script>var t="</p>"</script></head><body>{"".join(before)}{core}{"".join(after)}{closing}'


def words_of(pages: DataFrame, html_col: str = "html") -> list[str]:
    """Words for the layouts: of about `SAMPLE` different pages, picked by hash, and of `SAMPLE_CHARS` characters of each.

    The sample bounds what the driver takes (at most twice `SAMPLE` starts of pages, whatever the table's size); nothing
    else is learnt from it than how words and sentences look.
    """
    html = F.col(f"`{html_col}`")
    text = F.substring(F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style|head)\b.*?</\1>", " "), r"(?s)<[^>]*>", " "), 1, SAMPLE_CHARS)
    share = min(1.0, SAMPLE / max(1, pages.count()))
    picked = pages.where(html.isNotNull()).withColumn("h", F.xxhash64(html)).where(F.pmod("h", F.lit(1 << 20)) / float(1 << 20) < share)
    rows = picked.groupBy("h").agg(F.first(text).alias("t")).limit(2 * SAMPLE).collect()
    return [w for r in sorted(rows, key=lambda r: r["h"]) for w in r["t"].replace("&", " ").split()]


def labelled_pages(words: list[str], n: int = 600, seed: int = 13) -> list[str]:
    """``n`` labelled pages; the first ones of a seed are the same for any ``n``."""
    maker = Maker(words, seed)
    return [maker.page() for _ in range(n)]
