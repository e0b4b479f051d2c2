"""Hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Features of a text: its words, word pairs, word shapes and shape pairs (with a mark where a word repeats the one
before), hashed into 2**18 columns; a value is the share of the text's features that fall into the column, times
SCALE. Texts without words have the bias only. Fitted in one executor task on at most about ``train_rows`` labelled
rows, of each at most ``train_chars`` characters (of a longer text, stretches spread evenly over it); of several labels
of one doc_id the highest counts. Scores are of whole texts; rows that repeat and columns of other names are no trouble.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 18
SCALE = 30.0


def columns(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, int]:
    """The column and the text of every n-gram, in order of texts."""
    s = C.Scan(texts)
    h, shape, docs = s.word_hash(), s.shape_hash(), s.docs()
    again = np.zeros(len(h), np.uint64)
    if len(h):
        again[1:] = (h[1:] == h[:-1]) & (docs[1:] == docs[:-1])
    pairs, pair_docs = s.ngrams(h, 2)
    shapes, shape_docs = s.ngrams(shape * np.uint64(3) + again, 2)
    col = np.concatenate((C.mix(h ^ np.uint64(1)), C.mix(pairs ^ np.uint64(2)), C.mix(shape ^ np.uint64(3)), C.mix(shapes ^ np.uint64(4))))
    return (col >> np.uint64(64 - bits)).astype(np.int32), np.concatenate((docs, pair_docs, docs, shape_docs)), s.n


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1, seed: int = 7) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (label, columns, values): weights and bias."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    rng = np.random.default_rng(seed)

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, col, val = rows[k]
            i, x = np.append(col, 1 << bits), np.append(val, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange((1 << bits) + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held: int = 0, train_rows: int = 6000, train_chars: int = 20_000) -> tuple[np.ndarray, float]:
    def features(b):
        col, doc, n = columns(b.column(b.schema.get_field_index("text")))
        key, count = np.unique(doc.astype(np.int64) << BITS | col, return_counts=True)
        off = np.searchsorted(key, np.arange(n + 1) << BITS)
        total = np.bincount(doc, minlength=n).astype(float)
        val = (count * SCALE / total[key >> BITS]).astype(np.float32)
        col = (key & ((1 << BITS) - 1)).astype(np.int32)
        return [(y, col[i:j], val[i:j]) for y, i, j in zip(b.column(1).to_pylist(), off, off[1:])]

    def learn(rows: pa.Table):
        return train([x for b in C.slices(iter(rows.select(["text", "label"]).to_batches()), "text") for x in features(b)])

    part = C.labelled(docs, labels, label, modulus, held, train_rows).select("doc_id", C.excerpt(F.col("text"), train_chars).alias("text"), "label")
    return C.fitted(part, learn) or (np.zeros(1 << BITS, np.float32), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every row, whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats whatever the input

    def fn(b):
        w, bias = shared.value
        col, doc, n = columns(b.column(b.schema.get_field_index("text")))
        total = np.bincount(doc, minlength=n)
        at = np.bincount(doc, w[col], minlength=n) * SCALE / np.maximum(total, 1)
        return {"score": 1 / (1 + np.exp(-np.clip(at + bias, -35, 35)))}

    return C.map_texts(docs, fn, "score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 5, held: int = 0, train_rows: int = 6000) -> DataFrame:
    """(doc_id, held_out, score, predicted). A null doc_id is never held out; with no usable labels every score is 0.5."""
    out = score(docs, fit(docs, labels, "quality", modulus, held, train_rows))
    return out.select("doc_id", F.coalesce(C.crc_mod("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
