"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is an embedding of the word (letters and digits only, hashed) beside the mean of the embeddings of its
3- and 4-byte pieces, so that unseen words with known beginnings are told too. Every window of WINDOW words that the
whole text holds is scored, one from each word on; a text's score is its highest window's. Trained in one executor
task on at most about ``train_rows`` labelled rows, half of each label, of each at most ``train_chars`` characters (of a
longer text, stretches spread evenly over it): windows inherit the text's label at first (texts are drawn by their
windows STEP apart, then any window of the text), then only each text's highest window of all does. Texts without words
(or null) score 0; without rows of both labels all texts score 0. Of several labels of one doc_id the highest counts.
Rows that repeat, and columns of any name beside doc_id and text, are no trouble: every row is scored on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW, STEP = 32, 28
WORD_BITS, PIECE_BITS = 15, 15
WORD_DIM, PIECE_DIM, HIDDEN, ATTEND = 8, 16, 8, 4
#: Windows scored at once, which the cache holds.
BLOCK = 6144
#: Pieces of a word beyond which it is summed alone.
LONG = 256
#: Of _odds: how often it squares, the quotient of least error, and the furthest x.
SQUARES, MIDDLE, WIDTH, POLE, BASE, FAR = 5, 1.7348793, 2.3624340, np.float32(0.24919311), np.float32(0.26826461), 80
ONE = np.float32(1)
_CORE = np.zeros(256, bool)
_CORE[48:58] = _CORE[97:123] = _CORE[128:] = True
Params = dict[str, np.ndarray]


class Words:
    """Distinct words of some texts: ``ids`` numbers each word, ``word`` and ``piece`` are columns of the tables."""

    def __init__(self, texts: pa.Array):
        s = C.Scan(texts, lower=True)
        self.word_off, self.n = s.word_off, s.n
        if not len(s.start):
            self.ids = np.zeros(0, np.int64)
            self.whole = np.zeros(0, np.uint64)
            self.word, self.piece, self.first, self.size, self.count = (np.zeros(0, np.int64) for _ in range(5))
            return
        # the whole word with its marks tells words apart; the core names its row
        whole = s.word_hash()
        order = np.argsort(whole)
        new = np.ones(len(order), bool)
        new[1:] = whole[order[1:]] != whole[order[:-1]]
        first = np.flatnonzero(new)
        at, count, ids = order[first], np.diff(np.append(first, len(order))), np.empty(len(order), np.int64)
        ids[order] = np.cumsum(new) - 1
        often = np.argsort(-count, kind="stable")  # frequent words lie together, which the scoring loop's cache likes
        place = np.empty_like(often)
        place[often] = np.arange(len(often))
        at, self.ids, self.count = at[often], place[ids], count[often]
        self.whole = whole[at]
        nxt = np.append(s.is_word[1:], False)
        nxt[s.off[1:-1][(s.off[1:-1] > 0) & (s.off[1:-1] < len(s.data))] - 1] = False
        end = np.flatnonzero(s.is_word & ~nxt) + 1
        begin, length = s.start[at], (end - s.start)[at]
        # each word as a break, its bytes and two breaks
        first = np.concatenate(([0], np.cumsum(length + 3)))
        buf = np.zeros(first[-1] + 3, np.uint32)
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        data = s.data[np.repeat(begin, length) + inside]
        buf[np.repeat(first[:-1] + 1, length) + inside] = data
        core, start = _CORE[data], np.cumsum(length) - length
        run = np.cumsum(core)
        pw, inv = C.powers(len(data) + 1)
        h = C.mix(np.add.reduceat(np.where(core, C._BYTE[data] * pw[run], np.uint64(0)), start) * inv[run[start]])
        self.word = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        p = np.repeat(first[:-1], length) + inside
        a = buf[p] * np.uint32(0x9E3779B1) + buf[p + 1] * np.uint32(0x85EBCA77) + buf[p + 2] * np.uint32(0xC2B2AE3D)
        b = (a ^ (buf[p + 3] + np.uint32(1)) * np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1)
        a = (a ^ (a >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        self.piece = np.stack(((a >> np.uint32(32 - PIECE_BITS)), (b >> np.uint32(32 - PIECE_BITS))), 1).astype(np.int64).ravel()
        self.first, self.size = 2 * (np.cumsum(length) - length), 2 * length

    @classmethod
    def joined(cls, parts: list[Words]) -> Words:
        """The words of all parts' texts, one part after the other."""
        out = cls.__new__(cls)
        out.n = sum(p.n for p in parts)
        out.word_off = np.concatenate([[0], *(p.word_off[1:] + at for p, at in zip(parts, np.cumsum([0, *(len(p.ids) for p in parts)])))])
        _, at, own = np.unique(np.concatenate([p.whole for p in parts]), return_index=True, return_inverse=True)
        begin = np.cumsum([0, *(len(p.whole) for p in parts)])
        out.ids = np.concatenate([own[b + p.ids] for p, b in zip(parts, begin)])
        out.count = np.bincount(out.ids, minlength=len(at))
        out.whole, out.word, out.size = (np.concatenate([getattr(p, k) for p in parts])[at] for k in ("whole", "word", "size"))
        out.first = np.cumsum(out.size) - out.size
        first = np.concatenate([p.first + b for p, b in zip(parts, np.cumsum([0, *(len(p.piece) for p in parts)]))])[at]
        out.piece = np.concatenate([p.piece for p in parts])[np.repeat(first - out.first, out.size) + np.arange(out.size.sum())]
        return out

    def inputs(self, p: Params) -> np.ndarray:
        """A row per distinct word, and a last row of zeros for padding."""
        if not len(self.word):
            return np.zeros((1, WORD_DIM + PIECE_DIM), np.float32)
        pieces = np.empty((len(self.word), PIECE_DIM), p["piece"].dtype)
        # a piece of every word at a time, of those that have so many; the few long words one after another
        order = np.argsort(-self.size, kind="stable")
        long = int((self.size > LONG).sum())
        for k in order[:long]:
            pieces[k] = p["piece"][self.piece[self.first[k] : self.first[k] + self.size[k]]].sum(0)
        first, size = self.first[order[long:]], self.size[order[long:]]
        left = len(size) - np.searchsorted(size[::-1], np.arange(size[:1].sum()), "right")
        sums = np.zeros((len(size), PIECE_DIM), pieces.dtype)
        for k, m in enumerate(left.tolist()):
            sums[:m] += p["piece"].take(self.piece[first[:m] + k], axis=0)
        pieces[order[long:]] = sums
        pieces /= np.sqrt(self.size)[:, None].astype(np.float32)
        x = np.concatenate((p["word"][self.word], pieces), 1)
        return np.concatenate((x, np.zeros((1, x.shape[1]), np.float32)))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows x WINDOW) word numbers, padded by the number after the last; the text of each window. The last
        window ends with the text."""
        count = np.diff(self.word_off)
        n = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STEP)), 0)
        text = np.repeat(np.arange(self.n), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.window(np.minimum(k * STEP, np.maximum(0, count[text] - WINDOW)), text), text

    def window(self, begin: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Word numbers of the windows of texts from their words begin on."""
        at = begin[:, None] + np.arange(WINDOW)
        ok = at < np.diff(self.word_off)[text][:, None]
        ids = np.full(at.shape, len(self.word), np.int64)
        ids[ok] = self.ids[(self.word_off[text][:, None] + at)[ok]]
        return ids


def new_params(seed: int = 11) -> Params:
    r = np.random.default_rng(seed)
    d = WORD_DIM + PIECE_DIM
    g = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
    p = {"word": np.zeros((1 << WORD_BITS, WORD_DIM), np.float32), "piece": np.zeros((1 << PIECE_BITS, PIECE_DIM), np.float32)}  # what training never sees says nothing
    for k in "fb":
        p |= {f"w{k}": g(d, 3 * HIDDEN, scale=1 / np.sqrt(d)), f"u{k}": g(HIDDEN, 3 * HIDDEN, scale=1 / np.sqrt(HIDDEN)), f"c{k}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"a": g(2 * HIDDEN, ATTEND, scale=0.3), "v": g(ATTEND, scale=0.5), "o": g(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}


def _gates(g: np.ndarray, h: np.ndarray, u: np.ndarray):
    hu = h @ u
    rz = 0.5 * np.tanh(0.5 * (g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])) + 0.5
    r, z, hn = rz[:, :HIDDEN], rz[:, HIDDEN:], hu[:, 2 * HIDDEN :]
    n = np.tanh(g[:, 2 * HIDDEN :] + r * hn)
    return r, z, n, hn


def forward(p: Params, x: np.ndarray, ids: np.ndarray, keep: bool = False):
    """Logit of each window; with keep, what backward needs."""
    t, b = ids.shape[1], len(ids)
    mask = (ids != len(x) - 1).astype(np.float32)
    hs, saved = np.zeros((t, b, 2 * HIDDEN), np.float32), {}
    for k, order, lo in (("f", range(t), 0), ("b", range(t - 1, -1, -1), HIDDEN)):
        proj, u = x @ p[f"w{k}"] + p[f"c{k}"], p[f"u{k}"]
        h = np.zeros((b, HIDDEN), np.float32)
        for i in order:
            r, z, n, hn = _gates(proj[ids[:, i]], h, u)
            m = mask[:, i, None]
            if keep:
                saved[k, i] = (h, r, z, n, hn)
            h = h + m * (1 - z) * (n - h)
            hs[i, :, lo : lo + HIDDEN] = h
    e = np.tanh(hs @ p["a"])
    s = np.where(mask.T > 0, e @ p["v"], np.float32(-30))
    w = np.exp(s - s.max(0))
    w /= w.sum(0)
    pooled = (w[:, :, None] * hs).sum(0)
    logit = pooled @ p["o"] + p["bias"]
    return (logit, (mask, hs, saved, e, w, pooled)) if keep else logit


def _sum_rows(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    own, first = np.unique(rows[order], return_index=True)
    return own, np.add.reduceat(values[order], first, axis=0) if len(own) else values[:0]


def gradients(p: Params, words: Words, ids: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Gradients of the weighted log loss; those of the tables as (rows, values)."""
    x = words.inputs(p)
    logit, (mask, hs, saved, e, w, pooled) = forward(p, x, ids, keep=True)
    d = ((1 / (1 + np.exp(-logit)) - y) * weight / len(y)).astype(np.float32)
    g = {"o": pooled.T @ d, "bias": d.sum(keepdims=True)}
    dp = d[:, None] * p["o"]
    dw = (hs * dp).sum(2)
    ds = w * (dw - (w * dw).sum(0))
    de = ds[:, :, None] * p["v"] * (1 - e * e)
    g["v"] = (ds[:, :, None] * e).sum((0, 1))
    g["a"] = np.tensordot(hs, de, ((0, 1), (0, 1)))
    dh = w[:, :, None] * dp + de @ p["a"].T
    dx = np.zeros_like(x)
    t = ids.shape[1]
    for k, order, lo in (("f", range(t - 1, -1, -1), 0), ("b", range(t), HIDDEN)):
        u = p[f"u{k}"]
        du, dgs = np.zeros_like(u), np.zeros((t, len(ids), 3 * HIDDEN), np.float32)
        carry = np.zeros((len(ids), HIDDEN), np.float32)
        for i in order:
            h, r, z, n, hn = saved[k, i]
            m = mask[:, i, None]
            total = dh[i, :, lo : lo + HIDDEN] + carry
            new = m * total
            an = new * (1 - z) * (1 - n * n)
            az = new * (h - n) * z * (1 - z)
            ar = an * hn * r * (1 - r)
            dg = np.concatenate((ar, az, an), 1)
            dhu = np.concatenate((ar, az, an * r), 1)
            carry = (1 - m) * total + new * z + dhu @ u.T
            du += h.T @ dhu
            dgs[i] = dg
        dproj = np.zeros((len(x), 3 * HIDDEN), np.float32)
        rows, sums = _sum_rows(ids.T.ravel(), dgs.reshape(-1, 3 * HIDDEN))
        dproj[rows] = sums
        dproj[-1] = 0
        g[f"u{k}"], g[f"w{k}"], g[f"c{k}"] = du, x.T @ dproj, dproj.sum(0)
        dx += dproj @ p[f"w{k}"].T
    dx = dx[:-1]
    pieces = np.repeat(dx[:, WORD_DIM:] / np.sqrt(words.size)[:, None].astype(np.float32), words.size, axis=0)
    return g, (words.word, dx[:, :WORD_DIM]), (words.piece, pieces)


def _odds(w: np.ndarray) -> np.ndarray:
    """1 + e**x in place of w = (x / 2**SQUARES - MIDDLE) / WIDTH: a quotient near the exponential of a small part of x,
    squared again and again. Its inverse is within 4e-6 of the logistic function up to FAR."""
    np.multiply(w, w, w)
    w += POLE
    np.divide(ONE, w, w)
    w -= BASE
    for _ in range(SQUARES):
        np.multiply(w, w, w)
    w += ONE
    return w


def _full_windows(p: Params, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """forward's logit of the window from each of the words ids on, as far as whole windows reach.

    A row is a gate and a column a window, so that step k reads a contiguous run of inputs. Gates come from _odds, whose
    plain products and quotients cost less than half of np.tanh where that has no wide registers; its argument's scale and
    offset are in the weights. One product gives a state's part in the next gates, in the attention and in the output.
    """
    n, h1, h2, h3 = len(ids) - WINDOW + 1, HIDDEN, 2 * HIDDEN, 3 * HIDDEN
    unit, none = 1 / (WIDTH * (1 << SQUARES)), np.float32(-MIDDLE / WIDTH)
    fold = np.repeat([-unit, unit, 2 * unit], h1)  # asked for are e**-r, e**z, which tells 1 - z, and for its tanh e**(2 n)
    sides, far = [], 2 * np.abs(p["a"]).sum(0).max()
    for k, lo in (("f", 0), ("b", HIDDEN)):
        proj, u = x @ p[f"w{k}"] + p[f"c{k}"], p[f"u{k}"]
        far = max(far, 2 * (np.abs(proj).max() + np.abs(u).sum(0).max()))  # states lie in -1..1
        part = np.concatenate(((u * fold).T, 2 * unit * p["a"][lo : lo + HIDDEN].T, p["o"][None, lo : lo + HIDDEN]))
        sides.append(((none + proj * fold).astype(np.float32), np.ascontiguousarray(part, np.float32)))
    out = np.empty(max(n, 0), np.float32)
    if far > FAR:  # weights that no training here gives
        for at in range(0, n, BLOCK):
            out[at : at + BLOCK] = forward(p, x, ids[np.arange(at, min(n, at + BLOCK))[:, None] + np.arange(WINDOW)])
        return out
    v = -2 * p["v"].astype(np.float32)  # of the inverse odds; the shares don't change by a constant
    for at in range(0, n, BLOCK):
        b = min(BLOCK, n - at)
        if not at or b < BLOCK:
            h, all_, told = np.empty((h1, b), np.float32), np.empty((len(sides[0][1]), b), np.float32), np.empty((WINDOW, ATTEND + 1, b), np.float32)
            rz, r, z, new, said = all_[:h2], all_[:h1], all_[h1:h2], all_[h2:h3], all_[h3:]
        total, weight = np.zeros(b, np.float32), np.zeros(b, np.float32)
        for back, (proj, part) in enumerate(sides):
            g = np.ascontiguousarray(proj[ids[at : at + b + WINDOW - 1]].T)
            h[:], all_[:] = 0, 0  # from a state of zeros
            steps = range(WINDOW - 1, -1, -1) if back else range(WINDOW)
            for k in steps:
                gk = g[:, k : k + b]
                rz += gk[:h2]
                _odds(rz)
                new /= r
                new += gk[h2:]
                np.divide(-2 * ONE, _odds(new), new)
                new += ONE
                new -= h
                new /= z
                h += new
                if k == steps[-1]:  # no gates follow
                    np.matmul(part[h3:], h, out=said)
                else:
                    np.matmul(part, h, out=all_)
                if not back:
                    told[k] = said
                else:
                    said += told[k]
                    e = said[:ATTEND]
                    e += none
                    w = np.exp(v @ np.divide(ONE, _odds(e), e))
                    weight += w
                    w *= said[ATTEND]
                    total += w
        out[at : at + b] = total / weight + p["bias"]
    return out


def highest(p: Params, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Logit and first word of each text's highest window, of all; -inf for texts without words."""
    count, x = np.diff(words.word_off), words.inputs(p)
    best, begin = np.full(words.n, -np.inf), np.zeros(words.n, np.int64)
    short = np.flatnonzero((count > 0) & (count < WINDOW))
    for i in range(0, len(short), BLOCK):
        best[short[i : i + BLOCK]] = forward(p, x, words.window(np.zeros(len(short[i : i + BLOCK]), np.int64), short[i : i + BLOCK]))
    if (count >= WINDOW).any():
        # windows over a text's end belong to none
        logit = _full_windows(p, x, words.ids)
        for t in np.flatnonzero(count >= WINDOW):
            own = logit[words.word_off[t] : words.word_off[t + 1] - WINDOW + 1]
            begin[t] = own.argmax()
            best[t] = own[begin[t]]
    return best, begin


def train(words: Words, labels: np.ndarray, seed: int = 11, rounds: int = 5, steps: int = 450, batch: int = 128, rate: float = 0.01, table_rate: float = 0.1, least: int = 4) -> Params | None:
    if len(set(labels.tolist())) < 2:
        return None
    rng, p = np.random.default_rng(seed), new_params(seed)
    count = np.diff(words.word_off)
    last = np.maximum(0, count - WINDOW)
    text = np.repeat(np.arange(words.n), np.where(count > 0, 1 + -(-last // STEP), 0))
    known = np.bincount(words.word, words.count, minlength=1 << WORD_BITS) >= least  # rarer words are told by their pieces alone
    y = np.asarray(labels).astype(np.float32)
    dense = [k for k in p if k not in ("word", "piece")]
    m1, m2 = {k: np.zeros_like(p[k]) for k in dense}, {k: np.zeros_like(p[k]) for k in dense}
    seen = {k: np.full(len(p[k]), 1e-3, np.float32) for k in ("word", "piece")}
    # (text, first word of the window; -1: any)
    drawn = lambda t: np.stack((t, np.full(len(t), -1)), 1)
    pos, clean, step = drawn(text[y[text] == 1]), text[y[text] == 0], 0
    neg = drawn(clean)
    if not len(pos) or not len(neg):
        return None
    for turn in range(rounds):
        if turn >= 2:  # from now on a text is as toxic as its highest window
            best, begin = highest(p, words)
            top = np.stack((np.arange(words.n), begin), 1)[np.isfinite(best)]
            pos, hard = top[y[top[:, 0]] == 1], top[y[top[:, 0]] == 0]
            neg = np.concatenate((hard, hard, drawn(rng.choice(clean, len(hard)))))
        for _ in range(steps // rounds):
            pick, begin = np.concatenate((rng.choice(pos, batch // 2), rng.choice(neg, batch - batch // 2))).T
            begin = np.where(begin < 0, rng.integers(0, last[pick] + 1), begin)
            ids = words.window(begin, pick)
            used, local = np.unique(ids, return_inverse=True)
            real = used[used < len(words.word)]
            sub = Words.__new__(Words)
            sub.word, sub.size = words.word[real], words.size[real]
            sub.first = np.cumsum(sub.size) - sub.size
            sub.piece = words.piece[np.repeat(words.first[real] - sub.first, sub.size) + np.arange(sub.size.sum())]
            g, *tables = gradients(p, sub, local.reshape(ids.shape), y[pick], np.ones(len(pick), np.float32))
            step += 1
            for k in dense:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
            tables[0] = tuple(v[known[tables[0][0]]] for v in tables[0])
            for k, (rows, values) in zip(("word", "piece"), tables):
                own, total = _sum_rows(rows, values)
                seen[k][own] += (total**2).mean(1)
                p[k][own] -= table_rate * total / np.sqrt(seen[k][own])[:, None]
    return p


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held: int = 1, train_rows: int = 2400, train_chars: int = 20_000) -> Params | None:
    part = C.labelled(docs, labels, label, modulus, held, train_rows, per_class=True).select("doc_id", C.excerpt(F.col("text"), train_chars).alias("text"), "label")

    def learn(rows: pa.Table):
        # in slices, as the arrays over a text's bytes take many times its size
        parts = [Words(b.column(0)) for b in C.slices(iter(rows.select(["text"]).to_batches()), "text")]
        return train(Words.joined(parts), rows["label"].to_numpy())

    return C.fitted(part, learn)


def score(docs: DataFrame, params: Params | None, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """keep's columns and the score (under a name that keep doesn't have) of every row, from all windows of its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(params)  # a few MB whatever the input

    def fn(b):
        p = shared.value
        words = Words(b.column(b.schema.get_field_index("text")))
        out = highest(p, words)[0] if p is not None and len(words.word) else np.full(words.n, -np.inf)
        return {"score": 1 / (1 + np.exp(-np.clip(out, -700, 35))) * np.isfinite(out)}

    return C.map_texts(docs, lambda b: {name: fn(b)["score"]}, f"{name} double", keep=keep)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 3, held: int = 1, train_rows: int = 2400) -> DataFrame:
    """(doc_id, held_out, score, predicted). A null doc_id is never held out."""
    out = score(docs, fit(docs, labels, "toxic", modulus, held, train_rows))
    return out.select("doc_id", F.coalesce(C.crc_mod("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
