"""The block splitter on broken and very long pages, the labeller's gradient, and everyday pages labelled by hand."""

import time

import numpy as np
import pytest

from wayline.llm import html_extract
from wayline.llm.html_blocks import blocks

P1 = "The council voted on Tuesday to rebuild the old bridge over the river, which has been closed since the flood of last spring."
P2 = "Work is expected to start in the autumn and to take about eighteen months, according to the engineer in charge of the project."
P3 = "Residents who live on the north bank said that they had waited long enough, and that the detour costs them half an hour every day."
C1, C2 = "I live right there and it is about time that they fixed it.", "Who is going to pay for all of this I wonder"

#: (page, blocks of main text): each of another everyday shape
EVERYDAY = {
    "blog": (f'<body><div id="page"><div id="masthead"><a href="/">My Blog</a></div><ul id="menu"><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul><div id="primary"><div class="hentry"><h1>A bridge returns</h1><p>{P1}</p><p>{P2}</p></div><div id="comments"><h3>2 comments</h3><ol class="commentlist"><li><cite>Ann</cite> says<p>{C1}</p></li><li><cite>Bob</cite> says<p>{C2}</p></li></ol><div id="respond"><h3>Leave a reply</h3><form><input></form></div></div></div><div id="secondary"><h3>Recent posts</h3><ul><li><a href="/x">Spring walks</a></li><li><a href="/y">Old mills</a></li></ul><h3>Archives</h3><ul><li><a href="/z">May 2012</a></li></ul></div><div id="colophon">Proudly powered by example</div></div></body>', ["A bridge returns", P1, P2]),
    "semantic": (f'<body><header><nav><a href="/">Home</a> <a href="/n">News</a></nav></header><main><article><h1>A bridge returns</h1><p>{P1}</p><h2>When</h2><p>{P2}</p><ul><li>Autumn start</li><li>Eighteen months of work</li></ul></article><aside><h2>Related</h2><a href="/q">Another story</a></aside></main><footer><p>Copyright 2020 The Paper. All rights reserved.</p></footer></body>', ["A bridge returns", P1, "When", P2, "Autumn start", "Eighteen months of work"]),
    "bare": (f'<body><div><a href="/">Home</a> | <a href="/a">About</a> | <a href="/c">Contact</a></div><div><h1>A bridge returns</h1><div>{P1}</div><div>{P2}</div><div>{P3}</div></div><div>Copyright 2011</div></body>', ["A bridge returns", P1, P2, P3]),
    "tables": (f'<body><table><tr><td><a href="/">Home</a> | <a href="/a">About</a></td></tr><tr><td><a href="/1">One</a><br><a href="/2">Two</a></td><td><h2>A bridge returns</h2><p>{P1}</p><p>{P2}</p></td></tr><tr><td>Copyright 1999 Example Company</td></tr></table></body>', ["A bridge returns", P1, P2]),
    "news": (f'<body><div class="cookie-consent"><p>We use cookies to improve your experience on this site.</p><button>Accept all</button></div><div class="top-bar"><a href="/">Log in</a></div><div class="story-body"><h1>A bridge returns</h1><p>{P1}</p><div class="ad-slot">Advertisement</div><p>{P2}</p><p>{P3}</p></div><div class="related-links"><h4>More stories</h4><ul><li><a href="/r">A flood remembered</a></li><li><a href="/s">The ferry</a></li></ul></div><div class="newsletter-signup"><p>Sign up for our newsletter and never miss a story.</p><form><input><button>Sign up</button></form></div></body>', ["A bridge returns", P1, P2, P3]),
    "forum": (f'<body><div class="navbar"><a href="/">Forum</a></div><div class="content"><h1>A bridge returns</h1><p>{P1}</p><p>{P3}</p></div><div class="replies"><div class="reply"><b>ann</b> 2 days ago<p>{C1}</p><a href="#">Reply</a></div><div class="reply"><b>bob</b> 3 hours ago<p>{C2}</p><a href="#">Reply</a></div></div><div class="footer">Terms of service Privacy policy</div></body>', ["A bridge returns", P1, P3]),
    "old": (f'<html><body><center><h1>A bridge returns</h1></center><p>{P1}<p>{P2}<p>{P3}<hr><font size=1>Last updated 12 March 2004 by the webmaster</font></body></html>', ["A bridge returns", P1, P2, P3]),
    "plain-comments": (f'<body><div><a href="/">Home</a></div><div><h1>A bridge returns</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div><div><h3>2 comments</h3><div><span>Ann says</span><p>{C1}</p><a href="#">Reply</a></div><div><span>Bob says</span><p>{C2}</p><a href="#">Reply</a></div></div></body>', ["A bridge returns", P1, P2, P3]),
}


def test_everyday_pages():
    model = html_extract.labeller()
    hits = extra = missed = 0
    for page, wanted in EVERYDAY.values():
        got = html_extract.main_texts(model, [page])[0].split("\n")
        hits += len(set(got) & set(wanted))
        extra += len(set(got) - set(wanted))
        missed += len(set(wanted) - set(got))
    assert hits / (hits + extra) >= 0.85 and hits / (hits + missed) >= 0.9


@pytest.mark.parametrize("page", ["<div>x" * 85_000, "<b>y</span>" * 45_000, '<a "' * 125_000, "<a x='" * 85_001, "<b>" * 50_000 + "<li>z</li>" * 30_000, "<p>q" * 125_000, "<" * 500_000, "<!--" * 125_000, "<script>" * 60_000])
def test_splitter_takes_time_in_proportion(page):
    began = time.time()
    blocks(page)
    assert time.time() - began < 15


def test_blocks():
    page = '<div class="a b" id=c>one &amp; two<p>three <b>four</b><br>five<li>six<li>seven</div><p title="x>y">eight</p> nine <a href=z>ten</a><p x="unclosed>eleven'
    assert [(p[-1] if p else "", t, n) for p, t, n in blocks(page)] == [("div a b c", "one & two", 0), ("p", "three four five", 0), ("li", "six", 0), ("li", "seven", 0), ("p", "eight", 0), ("", "nine ten", 3), ("p", "eleven", 0)]


def test_very_long_page_is_labelled_whole():
    page = "<article><h1>Title</h1>" + "".join(f"<p>{P1} Number {k}.</p>" for k in range(3000)) + "</article>"
    got = html_extract.main_texts(html_extract.labeller(), [page])[0].split("\n")
    assert len(got) >= 2990


def test_gradient_is_the_slope():
    pages, labels = html_extract.made_up(3, 5)
    model = html_extract.BlockLabeller(1)
    known = [[html_extract.seen(b) for b in page] for page in pages]

    def loss():
        rows, _, _ = model.inputs(known)
        x, valid, turned = model.padded(rows)
        y = model.padded([v[:, None] for v in labels])[0][:, :, 0]
        z = model.logits(x, turned)[0]
        return ((np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z) * valid).sum() / valid.sum()

    grads = model.step(known, labels)
    rng = np.random.default_rng(0)
    for p, g in zip(model.parameters(), grads):
        places = np.argwhere(np.abs(g) > np.abs(g).max() / 2)
        at = tuple(places[rng.integers(len(places))])
        was, e = p[at], 1e-5
        p[at] = was + e
        up = loss()
        p[at] = was - e
        down = loss()
        p[at] = was
        assert g[at] == pytest.approx((up - down) / (2 * e), rel=1e-3, abs=1e-8)


def test_clashing_columns(spark):
    rows = [(1, "u", "<article><p>" + P1 + "</p></article>", "x", 3, True)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id int, url string, html string, text string, n_chars int, kept boolean")).collect()
    assert got[0]["text"] == P1 and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
