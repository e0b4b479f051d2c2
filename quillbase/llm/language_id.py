"""Multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; whatever isn't a letter counts as one break. The log-probability matrix has 2**15 rows and a
column per language, of at most ``languages``: those with the most rows (the first by code point, of equally many), so
that its size doesn't follow the input; other languages are never predicted. All languages are as likely beforehand.
Learned on about ``per_language`` rows of each language, spread by a hash. Null texts and texts without a letter are
``und`` with score 0; with nothing to learn from, all are ``und``. Ties go to the first language by code point. Whole
texts of any length count; rows that repeat and columns of other names are no trouble.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 15


def _letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


_table: list[np.ndarray] = []


def grams(texts: pa.Array, bits: int = BITS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed 1-, 2- and 3-grams at each character; offsets of each text's characters; letters of each text."""
    if not _table:
        _table.append(_letters())
    low = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    size = pc.utf8_length(low).to_numpy().astype(np.int64)
    code = np.frombuffer("".join(low.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _table[0][code]
    off = np.concatenate(([0], np.cumsum(size + 1)))  # a break before each text
    n = off[-1]
    b = np.zeros(n, np.uint32)
    at = np.ones(n, bool)
    at[off[:-1]] = False
    b[at] = np.where(letter, code, 0)
    a, d = np.append(np.uint32(0), b[:-1]), np.append(b[1:], np.uint32(0))
    mask, shift = np.uint32((1 << bits) - 1), np.uint32(32 - bits)
    two = (b * np.uint32(2654435761) + a * np.uint32(40503) + np.uint32(17)) * np.uint32(2246822519) >> shift
    three = ((b * np.uint32(2654435761) + a * np.uint32(3266489917)) ^ (d * np.uint32(668265263))) * np.uint32(2246822519) >> shift
    one = (b * np.uint32(374761393)) >> shift
    skip = b == 0  # grams are counted where their middle is a letter
    return [np.where(skip, np.uint32(0), np.maximum(x & mask, 1)) for x in (one, two, three)], off, C.by_text(~skip, off)


def fit(docs: DataFrame, modulus: int = 3, held: int = 1, per_language: int = 1500, languages: int = 256, bits: int = BITS) -> tuple[list[str], np.ndarray]:
    """Languages by code point, and log P(gram | language) with a row per hash; row 0 is for breaks and weighs nothing."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(C.crc_mod("doc_id", modulus) != held, F.lit(True)))
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    names = sorted(counts, key=lambda x: x.encode())
    if not names:
        return [], np.zeros((1 << bits, 0), np.float32)
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, per_language / counts[k])) for k in names], "lang string, __share double")
    spread = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(78)), F.lit(1 << 30)) / float(1 << 30)
    part = learn.select("lang", "text", spread.alias("__spread")).join(F.broadcast(shares), "lang").where("__spread < __share")
    place = {k: i for i, k in enumerate(names)}

    def run(batches):
        total = np.zeros((len(names), 1 << bits), np.int64)
        for b in C.slices(batches, "text"):
            hashed, off, _ = grams(b.column(b.schema.get_field_index("text")), bits)
            lang = np.repeat([place[x] for x in b.column(b.schema.get_field_index("lang")).to_pylist()], np.diff(off))
            for h in hashed:
                total += np.bincount(lang * (1 << bits) + h, minlength=total.size).reshape(total.shape)
        k, g = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(g.astype(np.int32)), pa.array(total[k, g])], ["k", "g", "n"])

    got = part.select("lang", "text").transform(C.arrow, run, "k int, g int, n long").groupBy("k", "g").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((1 << bits, len(names)))
    n[got["g"].to_numpy(), got["k"].to_numpy()] = got["n"].to_numpy()
    n[0] = 0
    logs = np.log((n + 0.5) / (n.sum(0) + 0.5 * len(n)))
    logs[0] = 0
    return names, logs.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], temperature: float = 0.1) -> DataFrame:
    """(doc_id, lang_pred, score); score is the posterior with evidence per letter sharpened by 1 / temperature."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(b):
        names, logs = shared.value
        t = b.column(b.schema.get_field_index("text"))
        if not names:
            return {"lang_pred": pa.array(["und"] * len(t)), "score": np.zeros(len(t))}
        hashed, off, letters = grams(t)
        sums = np.zeros((len(t), len(names)))
        for h in hashed:
            for k in range(len(names)):
                c = np.concatenate(([0.0], np.cumsum(np.ascontiguousarray(logs[:, k])[h], dtype=np.float64)))
                sums[:, k] += c[off[1:]] - c[off[:-1]]
        best = sums.argmax(1)
        mean = sums / np.maximum(letters, 1)[:, None] / temperature
        p = np.exp(mean - mean.max(1, keepdims=True))
        ok = letters > 0
        return {"lang_pred": pa.array([names[i] if o else "und" for i, o in zip(best, ok)]), "score": np.where(ok, p.max(1) / p.sum(1), 0.0)}

    return C.map_texts(docs, fn, "lang_pred string, score double")


def language_id(docs: DataFrame, modulus: int = 3, held: int = 1, per_language: int = 1500) -> DataFrame:
    out = predict(docs, fit(docs, modulus, held, per_language))
    return out.select("doc_id", F.coalesce(C.crc_mod("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
