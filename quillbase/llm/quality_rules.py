"""Quality rules as a short-circuit cascade ordered by rejection per cost.

Counts are taken on bytes with numpy, whole texts, one pass. Null and empty texts have zero of everything and
fail the base rule. Whole texts of any length are counted; each row is judged on its own, so rows that repeat, null ids
and columns of other names are no trouble. The verdict doesn't depend on the order of the rules, so reruns agree although costs are
measured; only the time taken does.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
# first bytes of letters beyond ASCII: Latin, Greek, Cyrillic and others to 0x7FF, then all but the block of signs and dashes
_LETTER[195:226] = _LETTER[227:238] = True
WINDOW = 8


class Features:
    """Counts of some texts, each made when first asked for."""

    def __init__(self, texts: pa.Array):
        self.s = C.Scan(texts)
        self._got: dict[str, np.ndarray] = {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._got:
            self._got[name] = getattr(self, name)()
        return self._got[name]

    def n_words(self):
        return self.s.counts.astype(np.int64)

    def word_chars(self):
        return C.by_text(self.s.is_word & ((self.s.data & 0xC0) != 0x80), self.s.off)

    def n_symbols(self):
        return C.by_text(_SYMBOL[self.s.data], self.s.off)

    def n_upper(self):
        return C.by_text(_UPPER[self.s.data], self.s.off)

    def n_letters(self):
        return C.by_text(_LETTER[self.s.data], self.s.off)

    def n_doubled(self):
        """Words equal to the word before them."""
        h, docs = self["hashes"], self.s.docs()
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (docs[1:] == docs[:-1])
        return C.by_text(same, self.s.word_off)

    def hashes(self):
        return self.s.word_hash()

    def _lines(self):
        """Line hashes with the text of each, for lines with a word."""
        s = self.s
        if not len(s.start):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        breaks = np.flatnonzero(s.data == 10)
        first = np.unique(np.concatenate((s.off[:-1][s.off[:-1] < len(s.data)], breaks + 1)))
        first = first[first < len(s.data)]
        pw, inv = C.powers(len(s.data))
        body = np.where(s.data == 10, np.uint64(0), C._BYTE[s.data])
        h = np.add.reduceat(body * pw[: len(s.data)], first) * inv[first]
        words = np.diff(np.searchsorted(s.start, np.append(first, len(s.data))))
        docs = np.searchsorted(s.off, first, "right") - 1
        return C.mix(h[words > 0]), docs[words > 0]

    def n_dup_lines(self):
        h, docs = self._lines()
        key = C.mix(h ^ C.mix(docs.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        return np.bincount(docs[again], minlength=self.s.n).astype(np.int64)

    def n_repeat_words(self):
        h, docs = self["hashes"], self.s.docs()
        if len(h) < WINDOW:
            return np.zeros(self.s.n, np.int64)
        m = len(h) - WINDOW + 1
        w = h[:m].copy()
        for k in range(1, WINDOW):
            w = w * C._P + h[k : k + m]
        at = np.flatnonzero(docs[:m] == docs[WINDOW - 1 :])
        key = C.mix(C.mix(w[at]) ^ C.mix(docs[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        eq = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:][eq]] = True
        twice[order[:-1][eq]] = True
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + WINDOW, -1)
        return C.by_text(np.cumsum(cover)[:-1] > 0, self.s.word_off)


#: Rules: true where a text is rejected. Ratios hold for whole texts.
RULES: dict[str, Callable[[Features], np.ndarray]] = {
    "few_words": lambda f: f["n_words"] < 20,
    "repeated_windows": lambda f: 100 * f["n_repeat_words"] > 30 * f["n_words"],
    "symbols": lambda f: 10 * f["n_symbols"] > f["n_words"],
    "upper_case": lambda f: 10 * f["n_upper"] > 3 * f["n_letters"],
    "doubled_words": lambda f: 10 * f["n_doubled"] > 3 * f["n_words"],
    "repeated_lines": lambda f: 10 * f["n_dup_lines"] > 3 * (C.by_text(f.s.data == 10, f.s.off) + 1),
    "word_length": lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 20 * f["n_words"]),
}
BASE_RULES = ("few_words", "repeated_windows")


def measure(docs: DataFrame, rules: dict = RULES, sample_rows: int = 2000) -> dict[str, tuple[float, float]]:
    """Seconds a row and share rejected of each rule, each from fresh features, on about sample_rows rows."""
    n = docs.count()
    if not n:
        return {k: (0.0, 0.0) for k in rules}
    share = min(1.0, sample_rows / n)
    picked = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches):
        for b in C.slices(batches, "text"):
            out = []
            for name, rule in rules.items():
                began = time.perf_counter()
                hit = int(np.sum(rule(Features(b.column(0)))))
                out.append((name, time.perf_counter() - began, hit, b.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["rule", "s", "hit", "n"])

    got = picked.transform(C.arrow, run, "rule string, s double, hit long, n long").groupBy("rule").agg(F.sum("s"), F.sum("hit"), F.sum("n")).collect()
    return {r[0]: (r[1] / max(1, r[3]), r[2] / max(1, r[3])) for r in got} or {k: (0.0, 0.0) for k in rules}


def order(costs: dict[str, tuple[float, float]], rules: dict = RULES) -> list[str]:
    """By rejection per cost, highest first; ties and unmeasured rules in the given order."""
    return sorted(rules, key=lambda k: -(costs.get(k, (0, 0))[1] / max(costs.get(k, (0, 0))[0], 1e-9)))


def cascade(texts: pa.Array, names: list[str], rules: dict = RULES) -> np.ndarray:
    """Which texts pass all rules; each rule sees only what passed those before it."""
    alive = np.arange(len(texts))
    for name in names:
        if not len(alive):
            break
        part = texts if len(alive) == len(texts) else texts.take(pa.array(alive))
        alive = alive[~rules[name](Features(part))]
    out = np.zeros(len(texts), bool)
    out[alive] = True
    return out


def quality_rules(docs: DataFrame, sample_rows: int = 2000, rules: dict = RULES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row."""
    names = [k for k in order(measure(docs, rules, sample_rows), rules)]
    rest = [k for k in names if k not in BASE_RULES]

    def fn(b):
        t = b.column(b.schema.get_field_index("text"))
        f = Features(t)
        cols = {k: f[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        failed = np.zeros(len(t), bool)
        for k in BASE_RULES:
            failed |= rules[k](f) if k in rules else False
        # what the base passed goes down the cascade; the counts made for the result are used again
        alive = np.flatnonzero(~failed)
        for k in rest:
            if not len(alive):
                break
            alive = alive[~rules[k](f)[alive]] if k in _SHARED else alive[cascade(t.take(pa.array(alive)), [k], rules)]
        kept = np.zeros(len(t), bool)
        kept[alive] = True
        return cols | {"base_failed": failed, "kept": kept}

    return C.map_texts(docs, fn, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


#: Rules whose counts the result holds anyway.
_SHARED = {"symbols", "repeated_lines", "word_length"}
