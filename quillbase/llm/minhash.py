"""Near-duplicates by HyperMinHash, banding and exact verification.

A text's set is its distinct word shingles (A-Z lower-cased; fewer words than a shingle count as one whole sequence).
Its shingles fall by hash into BUCKETS; each keeps, of its least hash, the number of leading zeros (6 bits) and the
next MANTISSA bits. Empty buckets take another's register in an order fixed by hash (optimal densification), so that
a register of two sets agrees with about the probability of their similarity whatever the sets' sizes.

Equal sets are one class from the start, by a 128-bit fingerprint; copies are never paired. BANDS bands of ROWS
registers give candidates: at similarity 0.8 a pair escapes all with probability (1 - 0.8**5)**48 < 1e-8. First each
class is verified against one partner: of the least ids of its bands, the one that it shares most bands with. What then
lies in different components asks the heads of its bands by other hashes, TURNS times, which joins large groups without
pairing them. Classes of bands that then still hold several components are paired across components if their rarest
shingles, positions and sizes allow the similarity (exact filters) and their estimate does (SLACK standard deviations
under the limit, collisions of registers taken off; from SURE shingles on), and verified pair by pair. Verification is exact on the whole sets
of 64-bit shingle hashes.

Null texts and texts without words have empty sets and are linked with nothing. Rows with a null id are linked with
nothing either: their component is null, and they are kept. Rows of one doc_id are one node: it is linked with whatever
one of them is similar to, and all of them are kept or not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

BANDS, ROWS, MANTISSA = 48, 5, 10
BUCKETS = BANDS * ROWS
SLACK = 5.0
#: From so many shingles on the estimate may rule a pair out.
SURE = 64
TURNS = 2
#: Shingles are counted in 2**BINS hashed bins.
BINS = 18
_SPAN = np.uint64(BUCKETS)


def _donors() -> np.ndarray:
    """For each bucket the order in which it asks others for a register."""
    r = np.random.default_rng(4242)
    return np.stack([r.permutation(BUCKETS) for _ in range(BUCKETS)]).astype(np.int16)


_order: list[np.ndarray] = []


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles, one text after another, and offsets."""
    s = C.Scan(texts, lower=True)
    h = s.word_hash()
    grams, docs = s.ngrams(h, n)
    few = np.flatnonzero((s.counts > 0) & (s.counts < n))
    for i in few:  # the whole sequence
        v = np.uint64(1)
        with np.errstate(over="ignore"):
            for x in h[s.word_off[i] : s.word_off[i + 1]]:
                v = v * C._P + x
        grams, docs = np.append(grams, C.mix(np.array([v ^ np.uint64(0x5A5A)], np.uint64))), np.append(docs, i)
    order = C.group_order(docs, grams)
    grams, docs = grams[order], docs[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])
    grams, docs = grams[new], docs[new]
    return grams, np.searchsorted(docs, np.arange(s.n + 1))


def registers(grams: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts x BUCKETS) registers of 16 bits; rows of empty sets are 0."""
    n = len(off) - 1
    out = np.zeros((n, BUCKETS), np.uint16)
    if not len(grams):
        return out
    if not _order:
        _order.append(_donors())
    docs = np.repeat(np.arange(n), np.diff(off))
    bucket = (C.mix(grams) % _SPAN).astype(np.int64)
    rest = C.mix(grams ^ np.uint64(0xABCDEF123))
    cell = docs * BUCKETS + bucket
    order = C.group_order(cell, rest)
    first = order[np.flatnonzero(np.append(True, cell[order][1:] != cell[order][:-1]))]
    low = rest[first]
    # leading zeros from the exponent; the float's rounding can only matter at powers of two, and alike everywhere
    exponent = np.frexp(low.astype(np.float64))[1]
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint64)
    tail = (low << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
    value = ((zeros << np.uint64(MANTISSA)) | tail).astype(np.uint16)
    full = np.zeros((n, BUCKETS), bool)
    out.ravel()[cell[first]] = value
    full.ravel()[cell[first]] = True
    donors = _order[0]
    need, at = np.nonzero(~full & (np.diff(off) > 0)[:, None])
    for k in range(BUCKETS):
        if not len(need):
            break
        give = donors[at, k].astype(np.int64)
        ok = full[need, give]
        out[need[ok], at[ok]] = out[need[ok], give[ok]]
        need, at = need[~ok], at[~ok]
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of register rows, less what registers of different least hashes agree by chance."""
    agree = (a == b).mean(1)
    # two registers of unlike hashes agree with the same zeros (about 1/3) and the same mantissa
    chance = 1 / 3 / 2.0**MANTISSA
    return (agree - chance) / (1 - chance)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, key_a, key_b, registers): key is the set's fingerprint."""

    def fn(b):
        grams, off = shingle_sets(b.column(b.schema.get_field_index("text")), shingle)
        keys = [C.by_text(C.mix(grams ^ np.uint64(k)).view(np.int64), off) for k in (1, 0x77777)]
        raw = registers(grams, off)
        return {"n_shingles": np.diff(off).astype(np.int64), "key_a": keys[0], "key_b": keys[1], "registers": pa.array([r.tobytes() for r in raw], pa.binary())}

    return C.map_texts(docs, fn, "n_shingles long, key_a long, key_b long, registers binary")


def _bands(classes: DataFrame) -> DataFrame:
    """(band, rep) of each class: 64-bit values of band number and registers."""

    def run(batches):
        for b in batches:
            regs = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), regs.shape[:2]) * C._P + np.uint64(99)
            for k in range(ROWS):
                h = C.mix(h * C._P + regs[:, :, k])
            many = lambda c: c.take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), many(b.column(0)), many(b.column(1))], ["band", "rep", "n"])

    return classes.select("rep", "n", "registers").transform(C.arrow, run, "band long, rep long, n long")


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(a, b, est) of pairs whose estimate doesn't rule them out. Sets of fewer than SURE shingles fill too few registers
    for that, the rest being copies, so their pairs all go on to the whole sets."""
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("registers").alias(f"r{c}"), F.col("n").alias(f"n{c}"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                get = lambda k: np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS)
                e = estimate(get(2), get(3))
                go = (e >= least) | (np.minimum(b.column(4).to_numpy(), b.column(5).to_numpy()) < SURE)
                ok = pa.array(go)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(e[go])], ["a", "b", "est"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "na", "nb").transform(C.arrow, run, "a long, b long, est double")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    side = lambda c: texts.select(F.col("rep").alias(c), F.col("text").alias(f"t{c}"))

    def run(batches):
        for b in C.slices(C.slices(batches, "ta"), "tb"):
            (ga, oa), (gb, ob) = (shingle_sets(b.column(k), shingle) for k in (2, 3))
            # a pair's hashes side by side: what is in both follows itself
            pair = np.concatenate((np.repeat(np.arange(b.num_rows), np.diff(oa)), np.repeat(np.arange(b.num_rows), np.diff(ob))))
            both = np.concatenate((ga, gb))
            order = C.group_order(pair, both)
            p, g = pair[order], both[order]
            same = np.bincount(p[1:][(p[1:] == p[:-1]) & (g[1:] == g[:-1])], minlength=b.num_rows)
            ok = pa.array(100 * same >= percent * (np.diff(oa) + np.diff(ob) - same))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").transform(C.arrow, run, "a long, b long")


def _needed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Texts of all classes in pairs."""
    ids = C.checkpoint(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    # rebalanced, or each task of the scan would write a file of a few rows
    texts = C.checkpoint(docs.select("doc_id", "text").join(C.small_side(ids), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text").hint("rebalance"))
    if texts.count() > ids.count():  # repeated rows would meet each other
        texts = C.checkpoint(texts.withColumn("th", F.xxhash64("text")).dropDuplicates(["rep", "th"]).drop("th"))
    return texts


def _mixed(shared: DataFrame, roots: DataFrame, seed: int) -> DataFrame:
    """(band, rep, n, root, head, head_n, head_root) of bands that hold several components; the head is their least by hash."""
    named = C.checkpoint(shared.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", "n", F.coalesce("root", "rep").alias("root")))
    head = F.min(F.struct(F.xxhash64("rep", F.lit(seed)), F.col("rep").alias("head"), F.col("n").alias("head_n"), F.col("root").alias("head_root"))).alias("x")
    several = named.groupBy("band").agg(head, F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("band", "x.head", "x.head_n", "x.head_root")
    return C.checkpoint(named.join(C.small_side(C.checkpoint(several)), "band"))


def _partners(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each class, of the heads of its bands, the one that it shares most with, if sizes allow."""
    near = (F.col("head") != F.col("rep")) & (100 * F.least("head_n", "n") >= percent * F.greatest("head_n", "n"))
    best = rows.where(near).groupBy("rep", "head").agg(F.count("*").alias("c")).groupBy("rep").agg(F.max(F.struct("c", (-F.col("head")).alias("a"))).alias("x"))
    return best.select((-F.col("x.a")).alias("a"), F.col("rep").alias("b"))


def _rest(docs: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that could be similar by size and by the shingles of their prefixes.

    Shingles are ordered from rare to frequent; similar sets share one within their first n - ceil(n * percent / 100) + 1,
    after which enough of both must be left. A text that differs too much from a large group has a prefix of its own
    shingles, so that it isn't paired with the group's members.
    """
    some = C.small_side(C.checkpoint(rows.select(F.col("rep").alias("doc_id"), "n", "root").distinct()))
    texts = C.checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(some, "doc_id").select(F.col("doc_id").alias("rep"), "n", "root", "text").hint("rebalance"))
    shift = np.uint64(64 - BINS)

    def count(batches):
        total = np.zeros(1 << BINS, np.int64)
        for b in C.slices(batches, "text"):
            total += np.bincount((shingle_sets(b.column(0), shingle)[0] >> shift).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.minimum(total[at], (1 << 31) - 1))], ["bin", "n"])

    got = texts.select("text").transform(C.arrow, count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(1 << BINS, np.uint64)
    seen[got["bin"].to_numpy()] = np.minimum(got["n"].to_numpy(), (1 << 31) - 1).astype(np.uint64)
    seen = docs.sparkSession.sparkContext.broadcast(seen)

    def run(batches):
        often = seen.value
        for b in C.slices(batches, "text"):
            grams, off = shingle_sets(b.column(b.schema.get_field_index("text")), shingle)
            doc = np.repeat(np.arange(b.num_rows), np.diff(off))
            grams = grams[np.lexsort(((often[(grams >> shift).astype(np.int64)] << np.uint64(32)) | (grams & np.uint64(0xFFFFFFFF)), doc))]
            at, n = np.arange(len(grams)) - off[doc], np.diff(off)[doc]
            ok = at < n - (-(-n * percent // 100)) + 1
            rest = b.select(["rep", "n", "root"]).take(pa.array(doc[ok]))
            yield pa.RecordBatch.from_arrays([pa.array(grams[ok].view(np.int64)), *rest.columns, pa.array((n - at)[ok])], ["gram", "rep", "n", "root", "room"])

    prefixes = C.checkpoint(texts.transform(C.arrow, run, "gram long, rep long, n long, root long, room long"))
    # a shingle of one component pairs nothing
    met = prefixes.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("gram")
    prefixes = C.checkpoint(prefixes.join(met, "gram"))
    side = lambda c: prefixes.select("gram", F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("root").alias(f"q{c}"), F.col("room").alias(f"r{c}"))
    near = (F.col("a") < F.col("b")) & (F.col("qa") != F.col("qb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    near &= (100 + percent) * F.least("ra", "rb") >= percent * (F.col("na") + F.col("nb"))
    return side("a").join(side("b"), "gram").where(near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    sig = C.checkpoint(signatures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle))
    some = sig.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = C.checkpoint(some.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")))
    bands = _bands(classes)
    least = percent / 100 - SLACK * (percent / 100 * (1 - percent / 100) / BUCKETS) ** 0.5
    # most bands hold one class and go at once
    heads = C.small_side(C.checkpoint(bands.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("x"), F.count("*").alias("m")).where("m > 1").select("band", F.col("x.rep").alias("head"), F.col("x.n").alias("head_n"))))
    shared = C.checkpoint(bands.join(heads, "band"))
    # one partner each: of the least ids of its bands, the one that it shares most with
    star = _partners(shared, percent)
    shared = shared.select("band", "rep", "n")

    def verified(pairs: DataFrame) -> DataFrame:
        likely = C.checkpoint(_estimated(C.checkpoint(pairs), classes, least).select("a", "b"))
        return C.checkpoint(_verified(likely, _needed(docs, likely), shingle, percent))

    links = verified(star)
    roots = C.checkpoint(components(links))
    for turn in range(TURNS + 1):  # what is still apart asks other heads, and at last everything that it shares bands with
        rows = _mixed(shared, roots, turn)
        if not rows.head(1):
            break
        last = turn == TURNS
        found = verified(_rest(docs, rows, shingle, percent) if last else _partners(rows.where("root != head_root"), percent))
        if found.head(1):
            links = links.union(found)
            roots = C.checkpoint(components(links))
    named = classes.select("key_a", "key_b", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key_a", "key_b", F.coalesce("root", "rep").alias("component_id"))
    out = some.select("doc_id", "n_shingles", "key_a", "key_b").join(named, ["key_a", "key_b"]).select("doc_id", "n_shingles", "component_id")
    rest = sig.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, one of each component of near-duplicates (its least id), with docs' own columns."""
    gone = C.checkpoint(near_duplicates(docs, shingle, percent).where("not kept").select(F.col("doc_id").alias("__gone")))
    gone = C.small_side(gone)
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
