"""Made-up pages with known labels, to train the block labeller on: varied layouts around random words.

Many pages tell nothing by their names: marks are taken off, elements become plain divisions or a layout of tables, so
that the labeller learns from links, lengths, order and common phrases as well.
"""

from __future__ import annotations

import math
import random
import re

MAIN, OTHER = "\ue000", "\ue001"  # private signs that mark a block's label
# fixed values: what page templates commonly call their parts
SYLLABLES = "an ba co de el fi ga he in jo ka le mo ne or pa qui re sa te un ver wi xo ya zu sch ung tion ment eur que los del é ü ñ ist ble th".split()
COMMON = (
    "the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no she other its may these what them than some him time into only do such my new about out also two any up first could our then most me should after said your over many before must through back years where much people way well state each day how long little very still own work made between water under never since number off part use year high place three number same went came "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des et en un une du dans que est pour qui sur pas plus par avec il au sont ce se "
    "el los las y en un una que por con para se del al es lo como más su"
).split()
MENU = ("nav", "div class=menu", "div class=navbar", "div id=navigation", "ul class=nav-links", "div class=topnav", "div class=breadcrumbs", "div role=navigation", "div class=pagination", "div class=toolbar")
HEAD = ("header", "div id=header", "div class=site-header", "div class=masthead", "div class=page-header", "div class=branding", "header class=top")
FOOT = ("footer", "div id=footer", "div class=site-footer", "div class=copyright", "div class=legal", "footer class=bottom", "div class=colophon", "div id=colophon", "footer id=colophon", "div id=bottom", "div class=credits")
SIDE = ("aside", "div class=sidebar", "div id=side", "div class=widget", "section class=related", "div class=recommended", "aside class=more", "div class=trending", "div class=tags", "div class=author-box", "div id=secondary", "div class=widget-area", "div id=right", "div class=rail", "div class=col-side", "div id=tertiary")
NOTICE = ("div class=cookie-banner", "div class=notice", "div id=gdpr", "div class=alert", "div class=consent", "div class=popup", "div class=modal", "div role=alert", "div class=newsletter", "div class=paywall", "div class=cookies", "section class=notice")
ADS = ("div class=ad", "div class=ads", "div class=advert", "div id=ad-1", "div class=sponsored", "div class=promo", "aside class=advertisement", "div class=banner-ad", "section class=ad")
TALK = ("section id=comments", "div class=comments", "div id=disqus", "ol class=comment-list", "div class=reader-comments", "section class=discussion", "div class=responses", "div class=comment", "section class=comments", "div id=respond", "div class=replies", "div class=thread", "div id=reviews", "ul class=commentlist", "div class=feedback")
SHARE = ("div class=share", "div class=social", "ul class=share-buttons", "div class=follow")
BODY = ("article", "main", "div class=content", "div id=content", "div class=post", "div class=entry-content", "div class=article-body", "section class=story", "div class=text", "main id=main", "div class=post-body", "section", "div", "div id=primary", "div id=main", "div class=hentry", "div class=story-body", "article class=post")
OUTER = ("", "div", "div class=wrapper", "div id=page", "div class=container", "main", "div class=layout", "section")
PHRASES = (
    "home about contact", "log in", "subscribe", "read more", "© all rights reserved", "privacy terms", "accept cookies", "share this", "advertisement", "comments reply", "search", "next previous",
    "related posts", "follow us", "sign up newsletter", "home", "about", "about us", "contact", "news", "archive", "sitemap", "login", "register", "help", "faq", "blog", "shop", "my account", "menu", "skip to content",
)
SIDE_TITLES = ("recent posts", "popular posts", "categories", "archives", "tags", "related articles", "you may also like", "most read", "trending", "about the author", "recent comments", "latest news", "links", "blogroll", "see also", "more stories", "recommended")
SIDE_LINES = ("sign up for our newsletter and never miss a story", "follow us on social media for updates", "click here to see more", "browse by month", "written by our staff", "get the latest news in your inbox", "download our app")
FOOT_LINES = (
    "copyright 2021 all rights reserved", "© 2019 example inc all rights reserved", "copyright 1999 example company", "terms of service privacy policy contact us", "powered by example", "site map privacy legal notice",
    "all content is the property of its owners", "designed by example studio", "last updated 12 march 2004", "webmaster", "best viewed in any browser",
)
NOTICE_LINES = (
    "we use cookies to improve your experience on this site", "by continuing to use this site you agree to our use of cookies", "accept all", "please enable javascript", "subscribe to continue reading", "you have reached your limit of free articles",
    "join our newsletter", "this site uses cookies", "your privacy matters to us", "please log in to continue",
)
AD_LINES = ("advertisement", "sponsored", "sponsored content", "buy now and save", "limited time offer", "shop the sale today", "special offer free shipping on all orders", "ads by example", "promoted", "try it free for 30 days")
TALK_TITLES = ("comments", "3 comments", "12 comments", "2 responses", "leave a reply", "discussion", "reader comments", "what do you think", "join the conversation", "5 thoughts on")
TALK_HEADS = ("says", "wrote", "said on", "2 days ago", "3 hours ago", "posted on may 4 2012 at 10 12 am", "march 3 2015 at 9 15 pm", "anonymous", "reply", "permalink", "report", "5 points")
TALK_LINES = ("great post", "thanks for sharing", "i agree with this", "nice article thank you", "i think you are wrong", "first", "lol", "can someone explain", "i tried this and it works", "what about")


class Layouts:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def pick(self, of: tuple[str, ...]) -> str:
        return self.rng.choice(of)

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, least: int, most: int) -> str:
        n = int(math.exp(self.rng.uniform(math.log(least), math.log(most + 1))))
        common = self.pick((0.0, 0.3, 0.5, 0.6))
        made = [self.pick(COMMON) if self.chance(common) else "".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 3))) for _ in range(n)]
        if self.chance(0.15):
            made = [w.upper() + "!!" for w in made]
        return " ".join(made).capitalize() + self.pick((".", ".", "", "!", " #%&amp;"))

    def wrap(self, opening: str, inner: str) -> str:
        if not opening:
            return inner
        name, _, mark = opening.partition(" ")
        key, _, value = mark.partition("=")
        return f'<{name} {key}="{value}">{inner}</{name}>' if mark else f"<{name}>{inner}</{name}>"

    def side_text(self) -> str:
        return OTHER + (self.pick(PHRASES) if self.chance(0.4) else self.words(1, 12))

    def links(self) -> str:
        each = [f'<a href="/x">{self.side_text()}</a>' for _ in range(self.rng.randint(1, 7))]
        if self.chance(0.7):
            return "<ul>" + "".join(f"<li>{a}</li>" for a in each) + "</ul>"
        return "".join(self.wrap(self.pick(("div", "p", "span")), a) for a in each)

    def line(self, of: tuple[str, ...], most: int) -> str:
        """One of the phrases, words, or one before the other."""
        kind = self.rng.random()
        phrase = self.pick(of)
        phrase = phrase.capitalize() if self.chance(0.6) else phrase
        return OTHER + (phrase if kind < 0.4 else f"{phrase} {self.words(1, most)}" if kind < 0.6 else self.words(2, most))

    def menu(self) -> str:
        if self.chance(0.2):  # all in one line
            inner = self.pick((" | ", " · ", " / ", " ")).join(f'<a href="/x">{self.side_text()}</a>' if self.chance(0.8) else self.side_text() for _ in range(self.rng.randint(2, 7)))
            return self.wrap(self.pick(MENU), inner)
        return self.wrap(self.pick(MENU), self.links())

    def header(self) -> str:
        inner = self.wrap(self.pick(("h1", "h2", "div class=logo", "p")), self.side_text())
        return self.wrap(self.pick(HEAD), inner + (self.menu() if self.chance(0.5) else "") + (f"<p>{self.side_text()}</p>" if self.chance(0.4) else ""))

    def footer(self) -> str:
        text = OTHER + ("&copy; " if self.chance(0.4) else "") + self.line(FOOT_LINES, 30).removeprefix(OTHER)
        inner = text if self.chance(0.4) else f"<p>{text}</p>" + (self.links() if self.chance(0.5) else "")
        return self.wrap(self.pick(FOOT), inner)

    def sidebar(self) -> str:
        title = self.wrap(self.pick(("h2", "h3", "h4")), self.line(SIDE_TITLES, 6)) if self.chance(0.7) else ""
        return self.wrap(self.pick(SIDE), title + (self.links() if self.chance(0.6) else f"<p>{self.line(SIDE_LINES, 40)}</p>"))

    def notice(self) -> str:
        text = self.line(NOTICE_LINES, 40)
        return self.wrap(self.pick(NOTICE), (text if self.chance(0.4) else f"<p>{text}</p>") + (f"<button>{self.side_text()}</button>" if self.chance(0.5) else ""))

    def advert(self) -> str:
        text = self.line(AD_LINES, 40)
        return self.wrap(self.pick(ADS), text if self.chance(0.5) else f"<p>{text}</p>")

    def form(self) -> str:
        inner = "".join(f"<label>{self.side_text()}</label><input>" for _ in range(self.rng.randint(1, 3)))
        inner += f"<p>{OTHER}{self.words(2, 20)}</p>" * self.chance(0.4) + f"<select><option>{self.side_text()}<option>{self.side_text()}</select>" * self.chance(0.3)
        return self.wrap(self.pick(("form", "form class=search", "form id=contact")), inner + f"<button>{self.side_text()}</button>")

    def comments(self) -> str:
        outer = self.pick(TALK)
        each = ""
        for _ in range(self.rng.randint(1, 6)):
            body = "".join(f"<p>{self.line(TALK_LINES, 80)}</p>" for _ in range(self.rng.randint(1, 2)))
            name = self.wrap(self.pick(("span", "b", "h4", "div class=author", "div class=meta", "cite")), self.line(TALK_HEADS, 3) + (" " + self.pick(TALK_HEADS)) * self.chance(0.5)) * self.chance(0.7)
            after = self.wrap(self.pick(("div", "a", "span", "p")), OTHER + self.pick(("Reply", "Like", "Report", "reply", "Quote"))) * self.chance(0.3)
            each += self.wrap("li" if outer.startswith("ol") else self.pick(("div class=comment", "div", "article class=comment", "p", "", "li", "blockquote")), name + body + after)
        return self.wrap(outer, self.wrap(self.pick(("h2", "h3", "h4", "p", "div")), self.line(TALK_TITLES, 8)) * self.chance(0.75) + each)

    def share(self) -> str:
        return self.wrap(self.pick(SHARE), self.links())

    def main_block(self) -> str:
        text = MAIN + self.words(1, 80)
        kind = self.rng.random()
        if kind < 0.55:
            return f"<p>{text}</p>"
        if kind < 0.65:
            return f"<p><b>{text}<br>" + ("</b></p>" if self.chance(0.5) else "")
        if kind < 0.73:
            return self.wrap(self.pick(("h2", "h3", "h4")), MAIN + self.words(1, 12))
        if kind < 0.81:
            return self.wrap(self.pick(("ul", "ol")), "".join(f"<li>{MAIN}{self.words(1, 25)}</li>" for _ in range(self.rng.randint(1, 4))))
        if kind < 0.86:
            return f"<blockquote>{text}</blockquote>" if self.chance(0.5) else f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.9:
            return "<table>" + "".join(f"<tr><td>{MAIN}{self.words(1, 6)}</td><td>{MAIN}{self.words(1, 6)}</td></tr>" for _ in range(2)) + "</table>"
        if kind < 0.93:
            return f"<figure><img><figcaption>{MAIN}{self.words(2, 20)}</figcaption></figure>"
        if kind < 0.96:
            return f"<pre>{text}</pre>"
        return f'<p><a href="/y">{text}</a></p>' if self.chance(0.4) else f"<div>{text}</div>"

    def article(self) -> str:
        heading = f"<h1>{MAIN}{self.words(1, 14)}</h1>" * self.chance(0.85)
        inner = heading
        for _ in range(int(math.exp(self.rng.uniform(0, math.log(25))))):
            inner += self.main_block()
            if self.chance(0.05):
                inner += self.pick((self.advert, self.share, self.notice, self.sidebar))()
        if self.chance(0.12):
            inner += self.pick((self.share, self.comments, self.sidebar, self.form))()
        return inner if self.chance(0.12) else self.wrap(self.pick(BODY) if self.chance(0.65) else "article", inner)

    def parts(self) -> tuple[list[str], str, list[str]]:
        before = [f() for f, p in ((self.header, 0.5), (self.menu, 0.6), (self.notice, 0.3), (self.advert, 0.4), (self.sidebar, 0.2), (self.form, 0.15)) if self.chance(p)]
        after = [f() for f, p in ((self.share, 0.2), (self.comments, 0.4), (self.sidebar, 0.35), (self.advert, 0.3), (self.form, 0.2), (self.notice, 0.2), (self.menu, 0.2)) if self.chance(p)]
        self.rng.shuffle(before)
        self.rng.shuffle(after)
        return before, self.article() if self.chance(0.97) else "", after

    def page(self) -> str:
        before, article, after = self.parts()
        footer = self.footer() if self.chance(0.75) else ""
        kind = self.rng.random()
        if kind < 0.15:  # a layout of tables
            top, rows = before[: len(before) // 2], [f"<td>{x}</td>" for x in before[len(before) // 2 :]]
            beside = [f"<td>{x}</td>" for x in after] if self.chance(0.4) else []
            body = "".join(f"<tr><td>{x}</td></tr>" for x in top) + "<tr>" + "".join(rows) + f"<td>{article}{'' if beside else ''.join(after)}</td>" + "".join(beside) + "</tr>" + f"<tr><td>{footer}</td></tr>" * bool(footer)
            page = self.plain(f"<html><body><table>{body}</table></body></html>", True)
            return re.sub("</?div>", "", page) if self.chance(0.5) else page
        page = f"<html><body>{self.wrap(self.pick(OUTER), ''.join(before) + article + ''.join(after))}{footer}</body></html>"
        return page if kind < 0.6 else self.plain(page, kind < 0.9)

    def plain(self, page: str, elements: bool) -> str:
        """Without classes, ids and roles; with ``elements``, named parts become divisions too."""
        page = re.sub(' (?:class|id|role)="[^"]*"', "", page)
        if elements and self.chance(0.25):  # paragraphs are divisions too
            page = re.sub(r"<(/?)p\b", r"<\1div", page)
        return re.sub(r"<(/?)(?:nav|aside|header|footer|article|main|section)\b", r"<\1div", page) if elements else page
