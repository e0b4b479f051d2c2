"""Hand-labelled layouts that the training pages aren't made of."""

import pytest

from quillbase.llm import html_extract

P1 = "The council met on Tuesday evening to discuss the new bridge, which has been delayed twice since the spring."
P2 = "Residents said that they had waited long enough. Several of them spoke for more than ten minutes, and the room was full."
P3 = "A final vote is expected in June, once the engineers have answered the remaining questions about the foundations."
CONSENT = "We and our partners store information on your device to improve this site. You can change your choice at any time in the settings."
NAV = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul>'
FOOT = "<footer><p>&copy; 2024 The Bridge Post. All rights reserved.</p><a href='/t'>Terms</a> <a href='/p'>Privacy</a></footer>"
BODY = f"<p>{P1}</p><p>{P2}</p><p>{P3}</p>"
WANT = f"{P1}\n\n{P2}\n\n{P3}"
LAYOUTS = {
    "story between boxes": (f'<div class="consent-box"><p>{CONSENT}</p></div><div class="story">{BODY}</div><div class="promo"><p>Get our app today and read more stories for free.</p></div>', WANT),
    "bare div": (f"<div><p>{P1}</p><p>{P2}</p></div>", f"{P1}\n\n{P2}"),
    "bare body": (f"<h1>Bridge again delayed</h1>{BODY}", f"Bridge again delayed\n\n{WANT}"),
    "controls in article": (f'<article>{BODY}<button>Print this</button><select><option>Small</option><option>Large</option></select></article>{FOOT}', WANT),
    "form in article": (f'<article><p>{P1}</p><p>{P2}</p><form action="/m"><label>Your address</label><p>Sign up for our daily letter.</p><input><button>Send</button></form><p>{P3}</p></article>', WANT),
    "unclosed quote": (f'<article><p class="x>{P1}</p><p class="y">{P2}</p><p>{P3}</p></article>', WANT),
    "unclosed tag": (f"<article><p>{P1}</p><p>{P2}</p><p>{P3}</p></article><div class='footer'", WANT),
    "main and aside": (f"<header><a href='/'>The Bridge Post</a></header><nav>{NAV}</nav><main><h1>Delay</h1>{BODY}</main><aside><h3>Most read</h3>{NAV}</aside>{FOOT}", f"Delay\n\n{WANT}"),
    "content id": (f'<div id="top-nav">{NAV}</div><div id="content"><h2>Bridge talks</h2>{BODY}</div><div id="sidebar"><h4>Weather</h4><p>Rain until noon.</p></div>', f"Bridge talks\n\n{WANT}"),
    "table layout": (f"<table><tr><td><a href='/a'>Home</a><br><a href='/b'>News</a><br><a href='/c'>Sport</a></td><td>{BODY}</td></tr></table>", WANT),
    "line breaks": (f"<div class='nav'>{NAV}</div><div class='post'>{P1}<br><br>{P2}</div>", f"{P1} {P2}"),
    "comments with class": (f"<article>{BODY}</article><section class='comments'><h3>2 comments</h3><div class='comment'><p>I have read all of this and I don't agree with a word of it. Why now?</p></div><div class='comment'><p>Well said, and about time too. My street has been closed for a year.</p></div></section>", WANT),
    "comments inside": (f"<article><h1>Vote</h1>{BODY}<div id='comments'><div class='reply'><p>This is my long reply to the article above. I think that it is wrong.</p></div></div></article>", f"Vote\n\n{WANT}"),
    "advert between": (f"<div class='entry-content'><p>{P1}</p><div class='ad'><p>Buy two tyres and get the third for nothing. Only this week in all our shops.</p></div><p>{P2}</p><p>{P3}</p></div>", WANT),
    "wrapped in form": (f"<form id='aspnetForm' action='/'><div class='menu'>{NAV}</div><div class='article-body'>{BODY}</div></form>", WANT),
    "deep wrappers": ("<div>" * 40 + f"<div class='menu'>{NAV}</div><article>{BODY}</article>" + "</div>" * 40, WANT),
    "lists in article": (f"<nav>{NAV}</nav><article><p>{P1}</p><ul><li>The bridge was first planned in 1988.</li><li>It has been closed since March.</li></ul><p>{P2}</p></article>", f"{P1}\n\nThe bridge was first planned in 1988.\n\nIt has been closed since March.\n\n{P2}"),
    "quote and heading": (f"<article><p>{P1}</p><h2>What they say</h2><blockquote><p>{P2}</p></blockquote><p>{P3}</p></article>{FOOT}", f"{P1}\n\nWhat they say\n\n{P2}\n\n{P3}"),
    "inline links": (f"<nav>{NAV}</nav><article><p>{P1} <a href='/x'>Our earlier report</a> told of the costs.</p><p>{P2}</p></article>", f"{P1} Our earlier report told of the costs.\n\n{P2}"),
    "scripts and styles": (f"<style>p{{}}</style><script>var x = '<p>no</p>';</script><article>{BODY}<script>if (a < b) {{ c(); }}</script></article><noscript>Turn it on.</noscript>", WANT),
    "references": ("<article><p>Caf&eacute; &amp; bar &#8212; the owner&nbsp;said it would open again in May, after the bridge. &lt;p&gt; isn't a tag here, it is only text.</p><p>" + P1 + "</p></article>", f"Café & bar — the owner said it would open again in May, after the bridge. <p> isn't a tag here, it is only text.\n\n{P1}"),
    "newsletter box": (f"<div class='post-body'>{BODY}</div><div class='newsletter-signup'><h3>Stay informed</h3><p>Subscribe to our letter and get the news each morning. You can leave whenever you like.</p></div>", WANT),
    "related after": (f"<main><article>{BODY}</article><div class='related'><h3>Read more</h3><div><h4><a href='/1'>Tunnel opens early</a></h4><p>The tunnel under the hill opened a week early.</p></div></div></main>", WANT),
    "breadcrumbs and share": (f"<div class='breadcrumbs'><a href='/'>Home</a> &gt; <a href='/n'>News</a> &gt; Bridge</div><article>{BODY}</article><div class='share'><a href='/f'>Share</a> <a href='/t'>Post</a></div>", WANT),
    "attribute with markup": (f"<article><p title=\"a > b\" data-tip='<b>tip</b>'>{P1}</p><p>{P2}</p></article>", f"{P1}\n\n{P2}"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    source, want = LAYOUTS[name]
    assert html_extract.main_texts([f"<html><head><title>No</title></head><body>{source}</body></html>"], html_extract.weights()) == [want]


def test_strange_pages():
    # nothing but furniture, markup cut short, deep nesting, a long page: no crash, and markup never shows
    w = html_extract.weights()
    pages = ["", None, "<", "<p", "<a href='", "a < b > c", "<div>" * 3000 + "x", "</p></div>" * 50, "<p class=\"a\"b'c>" * 200, f"<article>{BODY * 3000}</article>", f"<nav>{NAV}</nav>{FOOT}"]
    got = html_extract.main_texts(pages, w)
    assert got[0] == got[1] == "" and got[-2] == "\n\n".join([WANT] * 3000) and got[-1] == ""
    assert not any("<p" in x or "<div" in x for x in got[5:])


def test_tables(spark):
    schema = "page_id long, url string, html string, text int"
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0
    page = LAYOUTS["bare div"]
    rows = [(1, None, page[0], 5), (1, None, page[0], 6), (None, "u", None, 7)]
    got = html_extract.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["text"], r["n_chars"]) for r in got) == [("", 0), (page[1], len(page[1])), (page[1], len(page[1]))]
