"""Main text of pages by a tree-structured graphical model.

A page's block elements and text runs are the nodes of a tree; each is content or not. A node's potential is linear
in its features: element, words of class and id, length, links, sentence ends and share of the page of what it holds,
enclosing form, first words of boxes, prose beside a run. Parent and child share a 2 x 2 potential. One pass up and one
down (sum-product) give each node's marginal, in training and in use. The weights are trained by gradient ascent on the
likelihood of labelled pages, which html_layouts composes, as the tables hold none. Runs whose marginal exceeds one half
are the text.

Null and empty pages have the text '' and no characters. Elements that were never closed end where HTML ends them; a
tag whose quotes don't close ends at its first >. Pages of any length and depth are read whole; rows that repeat, null
ids and urls, and columns of other names are no trouble.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C
from .html_layouts import labelled_pages

#: Elements whose content is markup's own, controls of forms, elements that stand alone, elements that don't break a line.
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "template", "svg", "math", "canvas", "object"}
CONTROLS = {"button", "select", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: An opening of the first ends an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    # a quoted value ends where a value can end; where none does, the quote is a character like others
    r"|<(/?)([a-zA-Z][^\s/><]*)((?>[^<>\"']+|\"[^\"<]*+\"|'[^'<]*+'|\"[^\"]{0,20000}+\"(?=[\s/>])|'[^']{0,20000}+'(?=[\s/>])|[\"'])*+)>"
    r"|<(/?)([a-zA-Z][^\s/><]*)([^<>]*)(?:>|(?=<)|\Z)",
    re.S,
)
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\">]*)\"?|'([^'>]*)'?|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_STOP = re.compile(r"[.!?…](?=[\s\"'»”)\]]|\Z)|[。！？]")
_BLANK = re.compile(r"[ \t\n\r\f\v   -     　]+")
#: Plain characters from which on a run with a sentence's end is prose.
PROSE = 60
#: First words of a box that may tell what it is.
HEADS = 3


class Page:
    """Nodes in page order (parents first): parent, features, and the text of runs."""

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.features: list[list[str]] = [["root"]]
        self.text: list[str] = [""]
        self.mark: list[bool] = [False]
        self.linked: list[float] = [0.0]
        self._form: list[int] = [0]
        self._names: list[tuple[str, ...]] = [()]
        self._read(source)
        self._context()

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]
        run: list[str] = []
        linked = anchors = at = 0
        n = len(source)

        def flush():
            nonlocal run, linked
            if run:
                raw = "".join(run)
                text = _BLANK.sub(" ", html.unescape(raw)).strip(" ")
                if text:
                    self._add(stack[-1][1], ["run", "run-in-" + stack[-1][0]], text, self.mark[stack[-1][1]], min(1.0, linked / len(raw)))
            run, linked = [], 0

        while at < n:
            m = _TOKEN.search(source, at)
            piece = source[at : m.start()] if m else source[at:]
            if piece:
                run.append(piece)
                linked += len(piece) if anchors else 0
            if not m:
                break
            at = m.end()
            slash, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            name = (name or "").lower()
            if not name:
                continue
            if slash:
                if name in INLINE:
                    anchors = max(0, anchors - (name == "a"))
                    continue
                if name in ("br", "p") and (name == "br" or all(x[0] != "p" for x in stack)):
                    flush() if name == "p" else run.append("\n")
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        flush()
                        del stack[k:]
                        break
                continue
            if (name in RAW or name in CONTROLS) and not rest.rstrip().endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                if name in RAW:
                    at = end.end() if end else n
                elif end:
                    run.append(" ")
                    at = end.end()
                continue
            if name == "br":
                run.append("\n")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            if name in INLINE:
                anchors += name == "a"
                continue
            flush()
            anchors = 0
            shut = CLOSES.get(name)
            if shut:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in shut:
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table"):
                        break
            elif stack[-1][0] == "p":  # any block ends a paragraph
                stack.pop()
            if name in ("html", "body"):
                continue
            words = tuple(w for t in _NAME.findall(rest) for w in _PART.findall("".join(t).lower()) if len(w) > 1) if rest else ()
            keep = "data-keep" in rest or (self.mark[stack[-1][1]] and "data-drop" not in rest)
            i = self._add(stack[-1][1], ["element", f"<{name}>", *(f".{w}" for w in words)], "", keep, 0.0, words)
            if name == "form":
                self._form[i] = i
            stack.append((name, i))
        flush()

    def _add(self, parent: int, features: list[str], text: str, mark: bool, linked: float, names: tuple[str, ...] = ()) -> int:
        self.parent.append(parent)
        self.features.append(features)
        self.text.append(text)
        self.mark.append(mark)
        self.linked.append(linked)
        self._form.append(self._form[parent])
        self._names.append(tuple(dict.fromkeys((*self._names[parent], *names))) if names else self._names[parent])
        return len(self.parent) - 1

    def _context(self) -> None:
        """Features of what a node holds and of what is beside it."""
        n = len(self.parent)
        plain, links, stops, prose = [0.0] * n, [0.0] * n, [0] * n, [0] * n
        first: list[str] = [""] * n
        runs = [i for i in range(n) if self.text[i]]
        for i in runs:
            size = len(self.text[i])
            links[i], plain[i] = size * self.linked[i], size * (1 - self.linked[i])
            stops[i] = len(_STOP.findall(self.text[i])) if plain[i] else 0
            prose[i] = int(plain[i] >= PROSE and stops[i] > 0)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            plain[p] += plain[i]
            links[p] += links[i]
            stops[p] += stops[i]
            prose[p] += prose[i]
            first[p] = self.text[i] or first[i] or first[p]
        total = plain[0] or 1.0
        share = lambda i: (0 if plain[i] < 0.05 * total else 1 if plain[i] < 0.2 * total else 2 if plain[i] < 0.5 * total else 3)
        linky = lambda i: (0 if links[i] == 0 else 1 if links[i] < 0.2 * plain[i] else 2 if links[i] < plain[i] else 3)
        heads = lambda t: [w for w in _PART.findall(t[:60].lower())[:HEADS]] if len(t) < 40 else []
        for i in range(1, n):
            fs = self.features[i]
            size = min(7, int(plain[i]).bit_length() // 2 + (plain[i] > 0))
            ends = 0 if not stops[i] else 1 if stops[i] == 1 else 2 if stops[i] < 5 else 3
            form = self._form[i]
            if form:
                fs.append(f"form{share(form)}")
            if self.text[i]:
                fs += [f"size{size}-link{linky(i)}", f"ends{ends}-link{linky(i)}", f"share{share(i)}", "stop" if self.text[i][-1] in ".!?…»”\"'" else "open"]
                fs += [f"in.{w}" for w in self._names[i]]
                fs += [f"says.{w}" for w in heads(self.text[i])]
                if "©" in self.text[i][:40]:
                    fs.append("copyright")
            else:
                fs += [f"holds{size}-link{linky(i)}", f"prose{min(3, prose[i])}", f"ends{ends}", f"share{share(i)}-link{linky(i)}"]
                fs += [f"first.{w}" for w in heads(first[i])]
        for k, i in enumerate(runs):
            before = prose[runs[k - 1]] if k else 0
            after = prose[runs[k + 1]] if k + 1 < len(runs) else 0
            self.features[i].append(f"beside{before}{after}{prose[i]}")


Weights = tuple[dict[str, float], list[list[float]]]


class Forest:
    """The trees of several pages, by depth, so that both passes go over whole levels."""

    def __init__(self, pages: list[Page]):
        size = np.array([len(p.parent) for p in pages], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(size)))
        self.parent = np.concatenate([np.array(p.parent, np.int64) + b * (np.array(p.parent) >= 0) for p, b in zip(pages, self.begin)]) if pages else np.zeros(0, np.int64)
        depth = np.zeros(len(self.parent), np.int64)
        for p, b in zip(pages, self.begin):
            d = [0] * len(p.parent)
            for i in range(1, len(d)):
                d[i] = d[p.parent[i]] + 1
            depth[b : b + len(d)] = d
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []

    def marginals(self, on: np.ndarray, edge) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node and the expected counts of (parent, child) states, from the nodes' potentials."""
        (e00, e01), (e10, e11) = edge
        n = len(self.parent)
        up = np.zeros((2, n))  # of the node's subtree, its own potential included
        up[1] = on
        to = np.zeros((2, n))  # messages to the parent
        for own in self.levels[:0:-1]:
            to[0, own], to[1, own] = np.logaddexp(e00 + up[0, own], e01 + up[1, own]), np.logaddexp(e10 + up[0, own], e11 + up[1, own])
            for k in (0, 1):
                np.add.at(up[k], self.parent[own], to[k, own])
        down = np.zeros((2, n))
        pairs = np.zeros((2, 2))
        for own in self.levels[1:]:
            p = self.parent[own]
            a, b = (down[k, p] + up[k, p] - to[k, own] for k in (0, 1))
            down[0, own], down[1, own] = np.logaddexp(a + e00, b + e10), np.logaddexp(a + e01, b + e11)
            z = np.logaddexp(down[0, own] + up[0, own], down[1, own] + up[1, own])
            pairs += [[np.exp(s + e + up[k, own] - z).sum() for k, e in enumerate(es)] for s, es in ((a, (e00, e01)), (b, (e10, e11)))]
        z = np.logaddexp(down[0] + up[0], down[1] + up[1])
        return np.exp(down[1] + up[1] - z), pairs


def potentials(pages: list[Page], unary: dict[str, float]) -> np.ndarray:
    get = unary.get
    return np.array([sum([get(f, 0.0) for f in fs]) for p in pages for fs in p.features], float)


def marginals(pages: list[Page], weights: Weights) -> np.ndarray:
    return Forest(pages).marginals(potentials(pages, weights[0]), weights[1])[0]


def train(pages: list[Page], rounds: int = 300, rate: float = 0.1, decay: float = 0.001, least: int = 8) -> Weights:
    """Gradient ascent (with each weight's own step) on the pages' likelihood: observed less expected counts of features,
    of at least so many nodes, and of edges."""
    forest = Forest(pages)
    number: dict[str, int] = {}
    cols = [number.setdefault(f, len(number)) for p in pages for fs in p.features for f in fs]
    cols = np.array(cols, np.int64)
    rows = np.repeat(np.arange(len(forest.parent)), [len(fs) for p in pages for fs in p.features])
    use = np.bincount(cols) >= least
    rows, cols = rows[use[cols]], cols[use[cols]]
    y = np.array([m for p in pages for m in p.mark], float)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[forest.parent[child]].astype(int), y[child].astype(int)), 1)
    w, edge = np.zeros(len(number)), np.array([[0.5, -0.5], [-0.5, 0.5]])
    state = [np.zeros((2, len(w))), np.zeros((2, 2, 2))]
    for t in range(1, rounds + 1):
        p, pairs = forest.marginals(np.bincount(rows, w[cols], len(y)), edge)
        grads = (np.bincount(cols, (y - p)[rows], len(w)) / len(pages) - decay * w / 10, (seen - pairs) / len(pages))
        for k, (x, g) in enumerate(zip((w, edge), grads)):
            m, v = state[k]
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            x += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return {f: float(w[i]) for f, i in number.items() if w[i]}, edge.tolist()


_trained: list[Weights] = []


def weights() -> Weights:
    if not _trained:
        _trained.append(train([Page(x) for x in labelled_pages()]))
    return _trained[0]


def main_texts(sources: list[str | None], w: Weights) -> list[str]:
    pages = [Page(x or "") for x in sources]
    p, at, out = marginals(pages, w), 0, []
    for page in pages:
        out.append("\n\n".join(t for t, x in zip(page.text, p[at : at + len(page.text)]) if t and x > 0.5))
        at += len(page.text)
    return out


def extract(pages: DataFrame, w: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row, from the whole html."""
    shared = pages.sparkSession.sparkContext.broadcast(w or weights())  # some thousand numbers

    def fn(b):
        texts = main_texts(b.column(b.schema.get_field_index("html")).to_pylist(), shared.value)
        return {"text": pa.array(texts, pa.string()), "n_chars": np.array([len(t) for t in texts], np.int64)}

    return C.map_texts(pages, fn, "text string, n_chars long", keep=("page_id", "url"), text="html")
