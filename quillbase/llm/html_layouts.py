"""Labelled pages for training the extraction, composed from a seed: articles in many layouts among page furniture.

A page is a list of parts; what is article carries data-keep, what is furniture inside an article data-drop. Half of all
pages have class names that say nothing, so that elements, density, links and places must tell.
"""

from __future__ import annotations

import numpy as np

_WORDS = "the a of and in to it was for on that with as by from at this had not are but they which one were all there when who more will no out so said what up its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must through years where much your way well down should because long each just state those people too mister good".split()
#: Class words that furniture and articles carry, when they carry any that tell.
_SAYS = {
    "menu": "nav navigation menu navbar topnav mainmenu", "crumbs": "breadcrumb breadcrumbs crumbs", "head": "header masthead topbar siteheader branding", "foot": "footer colophon copyright legal bottom",
    "side": "sidebar aside widget rail secondary", "ad": "ad ads advert advertisement sponsored banner promo promotion", "consent": "cookie cookies consent gdpr privacy notice alert modal popup overlay", "mail": "newsletter subscribe signup login register paywall",
    "share": "share social sharing follow", "related": "related recommended popular trending teaser more", "comments": "comment comments disqus discussion replies reply respond", "pager": "pagination pager tags tag meta toolbar search",
    "article": "article content post entry story text body main page single",
}
_DULL = "wrap container box row col inner outer block section group layout grid x1 x2 module panel item".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        self.told = self.r.random() < 0.5
        self.rough = self.r.random() < 0.12  # an article of lists of words rather than sentences

    def pick(self, items):
        return items[int(self.r.integers(len(items)))]

    def words(self, low: int, high: int) -> str:
        return " ".join(self.pick(_WORDS) for _ in range(int(self.r.integers(low, high + 1))))

    def sentence(self, low: int = 7, high: int = 22) -> str:
        s = self.words(low, high)
        return s[0].upper() + s[1:] + self.pick([".", ".", ".", ".", "?", "!"])

    def prose(self, low: int, high: int) -> str:
        if self.rough and self.r.random() < 0.7:
            return self.pick([" | ", ", ", " "]).join(self.words(1, 2) for _ in range(int(self.r.integers(3, 6 * high))))
        return " ".join(self.sentence() for _ in range(int(self.r.integers(low, high + 1))))

    def title(self, low: int = 2, high: int = 7) -> str:
        return self.words(low, high).capitalize()

    def link(self, text: str) -> str:
        return f'<a href="/{self.pick(_WORDS)}">{text}</a>'

    def named(self, kind: str | None, says: float = 0.8) -> str:
        """A class or id, or nothing; one that tells, of pages and parts that tell."""
        words = []
        if kind and self.r.random() < says:
            words.append(self.pick(_SAYS[kind].split()))
        if self.r.random() < 0.4:
            words.append(self.pick(_DULL))
        if not words:
            return ""
        return f' {self.pick(["class", "class", "id"])}="{self.pick(["-", " ", "_"]).join(words)}"'

    def links(self, low: int, high: int, tag: str) -> str:
        items = [self.link(self.title(1, 3)) for _ in range(int(self.r.integers(low, high + 1)))]
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.pick([" ", " | ", " &middot; "]).join(items)

    def furniture(self, kind: str) -> str:
        r, says = self.r, 1.0 if self.told else 0.75
        div = lambda body, tag="div", k=kind, s=says: f"<{tag}{self.named(k, s)}>{body}</{tag}>"
        if kind == "menu":
            return self.pick([div(self.links(3, 8, "ul"), "nav"), div(self.links(3, 8, "ul"), s=0.6), div(self.links(3, 8, ""), s=0.6), f"<nav>{self.links(3, 9, 'ul')}</nav>", f"<ul{self.named(kind, 0.5)}>{self.links(4, 8, 'ul')[4:]}"])
        if kind == "crumbs":
            return div(self.link(self.title(1, 1)) + " &gt; " + self.link(self.title(1, 2)) + " &gt; " + self.title(1, 2))
        if kind == "head":
            return self.pick([f"<header{self.named('head', 0.5)}><h1>{self.title(1, 3)}</h1><p>{self.title(3, 7)}</p></header>", div(f"<h1>{self.link(self.title(1, 3))}</h1><p>{self.sentence(4, 8)}</p>"), f"<header><a href='/'>{self.title(1, 2)}</a> <span>{self.title(2, 5)}</span></header>"])
        if kind == "foot":
            body = f"&copy; {self.title(1, 3)}. " + (self.sentence(4, 9) if r.random() < 0.6 else "All rights reserved.")
            return self.pick([f"<footer{self.named('foot', 0.4)}>{body} {self.links(1, 4, '')}</footer>", f"<footer><p>{body}</p><p>{self.sentence()}</p>{self.links(2, 5, 'ul')}</footer>", div(f"<p>{body}</p>{self.links(2, 4, '')}"), f"<footer>{body} {self.prose(1, 2)}</footer>"])
        if kind == "side":
            body = f"<h3>{self.title(1, 3)}</h3>" + self.pick([f"<p>{self.sentence()}</p>", "", f"<p>{self.prose(1, 3)}</p>"]) + self.links(2, 6, "ul")
            return self.pick([f"<aside{self.named('side', 0.6)}>{body}</aside>", div(body)])
        if kind == "ad":
            body = self.pick([self.sentence(4, 10), self.prose(1, 3), f"<p>{self.prose(1, 4)}</p>" + self.link("Buy now"), f"<b>Advertisement</b><p>{self.prose(1, 3)}</p>"])
            return div(body, self.pick(["div", "div", "aside", "section"]), s=1.0)
        if kind == "consent":
            return div(self.pick([f"<p>We use cookies. {self.prose(1, 4)}</p>", f"<p>{self.prose(2, 5)}</p><button>Accept all</button>", f"<h2>{self.title(2, 4)}</h2><p>{self.prose(1, 3)}</p><p>{self.link('Privacy policy')}</p>"]), self.pick(["div", "div", "section"]), s=1.0)
        if kind == "mail":
            body = f"<p>{self.sentence()}</p>"
            return self.pick([f'<form action="/s"><label>{self.title(1, 3)}</label>{body}<input name="q"><button>Go</button></form>', div(f"<h3>{self.title(2, 4)}</h3>{body}", s=1.0), div(f'{body}<form><select><option>One</option></select><p>{self.title(3, 6)}</p><input type="submit"></form>', s=0.7), f"<form{self.named('mail', 0.5)}><p>{self.prose(1, 2)}</p></form>"])
        if kind == "share":
            return div("<span>Share</span> " + self.links(2, 4, self.pick(["", "ul"])))
        if kind == "related":
            items = "".join(f"<li>{self.link(self.title(3, 8))}</li>" for _ in range(int(r.integers(2, 6))))
            return self.pick([div(f"<h3>{self.pick(['Related', 'Read more', 'More stories', 'Popular'])}</h3><ul>{items}</ul>"), div("".join(f"<div><h4>{self.link(self.title(3, 7))}</h4><p>{self.sentence(6, 14)}</p></div>" for _ in range(int(r.integers(2, 4)))), s=1.0)])
        if kind == "comments":
            one = lambda: self.pick([f"<div{self.named('comments', 0.8)}><b>{self.title(1, 2)}</b><p>{self.prose(1, 4)}</p></div>", f"<li><p>{self.prose(1, 3)}</p></li>"])
            many = "".join(one() for _ in range(int(r.integers(1, 5))))
            return div((f"<h3>{self.pick(['Comments', 'Comments', '3 comments', 'Discussion', 'Leave a reply'])}</h3>" if r.random() < 0.7 else "") + many, self.pick(["div", "section", "div"]), s=1.0)
        return div(self.links(2, 5, "") + " " + self.title(1, 3))

    def article(self) -> str:
        r = self.r
        out = [f"<{t}>{self.title(2, 9)}</{t}>" for t in [self.pick(["h1", "h1", "h2"])] if r.random() < 0.8]
        if r.random() < 0.2:  # text without paragraphs
            return "".join(out) + self.pick(["<br><br>", "<br>"]).join(self.prose(2, 5) for _ in range(int(r.integers(1, 4))))
        for _ in range(int(self.pick([1, 2, 2, 3, 4, 6, 9, 14]))):
            k = r.random()
            if k < 0.72:
                out.append(f"<p>{self.prose(1, 6)}{self.pick(['</p>', '</p>', '</p>', ''])}")
            elif k < 0.77:
                out.append(f"<p>{self.pick([self.title(2, 6), self.sentence(3, 6)])}</p>")
            elif k < 0.82:
                out.append(f"<h2>{self.title(1, 6)}</h2><p>{self.prose(1, 4)}</p>")
            elif k < 0.86:
                out.append(f"<{(t := self.pick(['ul', 'ol']))}>" + "".join(f"<li>{self.pick([self.title(2, 6), self.sentence()])}</li>" for _ in range(int(r.integers(2, 6)))) + f"</{t}>")
            elif k < 0.9:
                out.append(f"<blockquote><p>{self.prose(1, 2)}</p></blockquote>")
            elif k < 0.92:
                out.append(f"<p>{self.sentence()} {self.link(self.title(2, 4))} {self.sentence()}</p>")
            elif k < 0.95:
                out.append(f"<table><tr><td>{self.title(1, 2)}</td><td>{self.title(1, 3)}</td></tr><tr><td>{self.title(1, 2)}</td><td>{self.sentence(3, 6)}</td></tr></table>")
            else:
                out.append(self.pick([f"<pre>{self.words(3, 9)}</pre>", f"<figure><img src='i.png'><figcaption>{self.sentence(4, 9)}</figcaption></figure>"]))
        if not any(x.startswith("<p>") and len(x) > 60 for x in out):
            out.append(f"<p>{self.prose(2, 5)}</p>")
        for kind in ("ad", "mail", "share", "related", "comments", "consent"):  # furniture inside the article
            if r.random() < 0.13:
                f = self.furniture(kind)
                at = len(out) if kind in ("related", "comments", "share") else int(r.integers(1, len(out) + 1))
                out.insert(at, f"<div data-drop>{f}</div>" if r.random() < 0.3 else f.replace(">", " data-drop>", 1))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        hold = self.pick(["article", "main", "div", "div", "div", "section", "div", "td"])
        name = self.named("article", 1.0 if self.told and hold == "div" else 0.3)
        body = f"<{hold}{name} data-keep>{self.article()}</{hold}>"
        if hold == "td":
            left = f"<td{self.named('menu', 0.4)}>{self.links(3, 7, '')}</td>"
            body = f"<table><tr>{left if r.random() < 0.6 else ''}{body}</tr></table>"
        near = [self.furniture(k) for k in ("crumbs", "share", "related", "comments", "ad", "side", "pager") if r.random() < 0.18]
        first = int(r.integers(0, len(near) + 1))
        body = "".join([*near[:first], body, *near[first:]])
        for _ in range(int(r.integers(0, 3))):
            body = f"<{(t := self.pick(['div', 'div', 'main', 'section']))}{self.named(None)}>{body}</{t}>"
        top = [self.furniture(k) for k in ("head", "menu", "ad", "consent", "mail") if r.random() < 0.4]
        end = [self.furniture(k) for k in ("related", "comments", "side", "ad", "mail", "consent", "foot") if r.random() < (0.75 if k == "foot" else 0.25)]
        page = "".join([*top, body, *end])
        if r.random() < 0.06:
            page = f'<form id="aspnetForm">{page}</form>'
        if r.random() < 0.04:  # nothing but furniture
            page = "".join([*top, *end])
        return f"<html><body>{page}</body></html>"


def labelled_pages(n: int = 800, seed: int = 1000) -> list[str]:
    return [_Maker(seed + i).page() for i in range(n)]
