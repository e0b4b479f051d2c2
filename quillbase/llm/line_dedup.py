"""Line dedup by an exact set-similarity join.

A line's set is its distinct words (A-Z lower-cased). A line goes if an earlier one, by (doc_id, line number), is
similar: 100 * intersection >= percent * union. Lines with fewer than ``min_words`` words stay and make none go. Lines
of equal sets are one class, of which all but the first go, so copies are never paired. What is left to find is whether
the first line of a class has an earlier similar class.

Between classes: words are ordered from rare to frequent, by their counts over all texts in 2**BINS hashed bins (ties by
hash); two similar sets share a word within their prefixes (n - ceil(n * percent / 100) + 1 words). A word of over CHAIN
occurrences isn't met alone but with the next word that two sets share, which lies within one word more. What meets on a
word passes the length filter, the positional filter (what can still be shared after that word) and a filter on 128
parities of the sets' words (no more of them may differ than similar sets can differ in words), none of which loses a
pair. In a word's list a class first asks the ASKED earliest classes that pass; of what it asked, the class that it
shares most words with is verified on the whole sets. Only classes that this doesn't settle try the others that they
asked, and meet all earlier ones if they had more to ask; so the members of a large family of similar lines aren't all
paired with one another.

Prefixes travel as blocks of arrays for a part of the words each, and are compared there in numpy.

Null texts have no lines; empty lines stay. Rows with one doc_id and text share a place, so none makes the other go.
Documents with a null doc_id keep all lines. Doc_ids are of any type that orders.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BINS = 18
#: Occurrences from which on a word of a prefix is met together with the next shared word.
CHAIN = 20_000
#: Earlier classes that a class asks in one word's list before what it asked is verified.
ASKED = 4
#: Smaller sets have 64 parities, the folded ones.
WIDE = 48
#: Prefix words compared in one task.
PART = 400_000
#: Prefix words that a task gathers before it deals them out.
FLUSH = 300_000
_LOW = np.uint64(0xFFFFFFFF)


class _Lines:
    """Lines of some texts with their distinct words in the order of ``rank`` (of hashed bins), or of their hashes."""

    def __init__(self, texts: pa.Array, rank: np.ndarray | None = None):
        s = C.Scan(texts, lower=True)
        h = s.word_hash()
        first = np.concatenate((s.off[:-1][np.diff(s.off) > 0], np.flatnonzero(s.data == 10) + 1))
        # a break at a text's end begins an empty line there, which has no words: leaving it out moves no number
        first = np.unique(first[first < len(s.data)])
        self.doc = np.searchsorted(s.off, first, "right") - 1
        begin = np.searchsorted(first, s.off)
        self.no = np.arange(len(first)) - begin[self.doc]
        at = np.searchsorted(s.start, np.append(first, len(s.data)))
        self.words = np.diff(at)
        line = np.repeat(np.arange(len(first)), self.words)
        # the bin is the hash's first bits, so its rank in their place keeps equal words together
        key = h if rank is None else rank[(h >> np.uint64(64 - BINS)).astype(np.int64)] | (h & np.uint64((1 << 64 - BINS) - 1))
        order = C.group_order(line, key)
        line, h = line[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        self.line, self.token = line[new], h[new]
        self.off = np.searchsorted(self.line, np.arange(len(first) + 1))
        self.size = np.diff(self.off)
        self.key = [C.by_text(C.mix(self.token ^ np.uint64(k)).view(np.int64), self.off) for k in (5, 0x99999)]


def _text(b: pa.RecordBatch) -> pa.Array:
    return b.column(b.schema.get_field_index("text"))


def _blobs(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary for each run of values between offsets."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _joined(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def histogram(df: DataFrame, column: str, hashes, bits: int) -> np.ndarray:
    """How many hashes (of the batches' column) fall into each of 2**bits bins, over all rows. Tasks send blocks of
    counts that others add up; the driver gets 2**bits numbers, whatever the input."""
    width = 1 << max(0, bits - 6)

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for b in C.slices(batches, column) if column == "text" else batches:
            total += np.bincount((hashes(b) >> np.uint64(64 - bits)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        off = np.searchsorted(at, np.arange(0, len(total) + 1, width))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(off) - 1, dtype=np.int32)), _blobs((at % width).astype(np.int32), off), _blobs(total[at], off)], ["part", "at", "n"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, at, n in zip(*(c.to_pylist() for c in b.columns)):
                own = total.setdefault(part, np.zeros(width, np.int64))
                own[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "n"])

    rows = df.select(column).transform(C.arrow, count, "part int, at binary, n binary").repartitionById((1 << bits) // width, F.col("part")).transform(C.arrow, add, "part int, n binary").collect()
    out = np.zeros(1 << bits, np.int64)
    for r in rows:
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["n"], np.int64)
    return out


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc, th, text) with whole numbers that order as doc_id does; the table of numbers, unless they are the ids."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    if docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return docs.select(F.col("doc_id").cast("long").alias("doc"), "th", "text"), None
    ids = docs.select("doc_id").distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ids = C.checkpoint(ids.select("doc_id", F.monotonically_increasing_id().alias("doc")))
    return docs.join(ids, "doc_id").select("doc", "th", "text"), ids


def _rows(docs: DataFrame, shared, min_words: int, percent: int) -> DataFrame:
    """(doc, th, line, key_a, key_b, n, low, high, keys, at) of every line with enough words: the set's key, size and
    parities, and the words of its prefix with their places."""

    def run(batches):
        rank, hot = shared.value
        for b in C.slices(batches, "text"):
            x = _Lines(_text(b), rank)
            ok = np.flatnonzero((x.words >= min_words) & (x.size > 0))
            n = x.size
            # sets of few words can only equal one another
            most = np.where(100 * n >= percent * (n + 1), n - (-(-n * percent // 100)) + 1, 0) * (x.words >= min_words)
            at = np.arange(len(x.line)) - x.off[x.line]
            take = np.flatnonzero(at < most[x.line])
            line, at, key = x.line[take], at[take], x.token[take] & _LOW
            told = np.zeros(0, np.uint32)  # places, where they aren't simply 0, 1, 2 ...
            chained = hot[(x.token[take] >> np.uint64(64 - BINS)).astype(np.int64)]
            if chained.any():
                c = np.flatnonzero(chained)
                many = np.minimum(most[line[c]], n[line[c]] - 1) - at[c]
                k = np.repeat(c, many)
                then = np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many) + at[k] + 1
                pair = C.mix(x.token[take][k] * C._P + x.token[x.off[line[k]] + then]) & _LOW
                line, at, key = (np.concatenate((v[~chained], w)) for v, w in ((line, line[k]), (at, at[k]), (key, pair)))
                order = np.argsort(line, kind="stable")
                line, at, key = line[order], at[order], key[order]
                told = at.astype(np.uint32)
            off = np.append(np.searchsorted(line, ok), np.searchsorted(line, ok[-1], "right")) if len(ok) else np.zeros(1, np.int64)
            bits = np.zeros((2, len(n)), np.uint64)
            if len(x.token):
                bit = C.mix(x.token) >> np.uint64(57)
                for k in (0, 1):
                    bits[k, n > 0] = np.bitwise_xor.reduceat((bit >> np.uint64(6) == np.uint64(k)).astype(np.uint64) << (bit & np.uint64(63)), x.off[:-1][n > 0])
            bits[0, n < WIDE] ^= bits[1, n < WIDE]
            bits[1, n < WIDE] = 0
            of = pa.array(x.doc[ok])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(of), b.column(1).take(of), pa.array(x.no[ok].astype(np.int32)), *(pa.array(k[ok]) for k in x.key), pa.array(n[ok].astype(np.int32)), *(pa.array(v[ok].view(np.int64)) for v in bits), _blobs(key.astype(np.uint32), off), _blobs(told, off if len(told) else np.zeros_like(off))],
                ["doc", "th", "line", "key_a", "key_b", "n", "low", "high", "keys", "at"],
            )

    return docs.select("doc", "th", "text").transform(C.arrow, run, "doc long, th long, line int, key_a long, key_b long, n int, low long, high long, keys binary, at binary")


#: What travels of a prefix word: its hash, its class (place and a part of the key), size, place in the set, parities, and
#: whether its class asks others.
_POSTING = {"key": np.uint32, "doc": np.int64, "line": np.int32, "tag": np.int32, "n": np.int32, "at": np.uint32, "low": np.int64, "high": np.int64, "asks": np.uint8}


_DEALT = ["part", "size", *(x for k in _POSTING for x in (k, f"{k}_base"))]


def _opened(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    """The arrays of dealt blocks, one after another."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in _POSTING}
    for b in batches:
        size = b.column(1).to_pylist()
        for i, (k, kind) in enumerate(_POSTING.items()):
            for blob, base, n in zip(b.column(2 + 2 * i).to_pylist(), b.column(3 + 2 * i).to_pylist(), size):
                v = np.frombuffer(blob, np.dtype(f"u{len(blob) // n}")).astype(np.uint64) + np.uint64(base & 0xFFFFFFFFFFFFFFFF)
                out[k].append(v.view(np.int64).astype(kind))
    return {k: np.concatenate(v) for k, v in out.items()}


def _dealt(classes: DataFrame, parts: int, wanted=None) -> DataFrame:
    """Prefix words of classes (doc, line, tag, n, low, high, asks, keys, at), dealt into parts by their hash, in blocks. With
    wanted, only of bins that it marks."""

    def flush(held):
        key, *rest = (np.concatenate([h[k] for h in held]) for k in _POSTING)
        part = (C.mix(key) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")  # by digits, if narrow
        many = np.bincount(part, minlength=parts)
        own = np.flatnonzero(many).astype(np.int32)
        off = np.append(0, np.cumsum(many[own]))
        cols = []
        for v, kind in zip((key, *rest), _POSTING.values()):
            v = v[order].astype(kind)
            # whole numbers are sent as narrow as they are, less their least; the receiver tells the width by the size
            base = v.min() if np.dtype(kind).kind == "i" else kind(0)
            narrow = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if int(v.max()) - int(base) <= np.iinfo(t).max)
            cols += [_blobs((v.astype(np.uint64) - np.uint64(int(base) & 0xFFFFFFFFFFFFFFFF)).astype(narrow), off), pa.array([int(base)] * len(own), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.diff(off).astype(np.int32)), *cols], _DEALT)

    def run(batches):
        held, size = [], 0
        for b in batches:
            get = {k: b.column(b.schema.get_field_index(k)) for k in b.schema.names}
            key, size_of = _joined(get["keys"], np.uint32), pc.binary_length(get["keys"]).to_numpy() // 4
            of = np.repeat(np.arange(b.num_rows), size_of)
            at = np.arange(len(key)) - np.repeat(np.cumsum(size_of) - size_of, size_of)
            told = np.repeat(pc.binary_length(get["at"]).to_numpy() > 0, size_of)
            at[told] = _joined(get["at"], np.uint32)
            if wanted is not None:
                ok = wanted.value[key >> np.uint32(32 - WANTED)]
                key, at, of = key[ok], at[ok], of[ok]
            if not len(key):
                continue
            held.append({"key": key, "at": at} | {k: get[k].to_numpy()[of] for k in ("doc", "line", "tag", "n", "low", "high", "asks")})
            size += len(key)
            if size >= FLUSH:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    out = classes.select("doc", "line", "tag", "n", "low", "high", "asks", "keys", "at").transform(C.arrow, run, "part int, size int, " + ", ".join(f"{k} binary, {k}_base long" for k in _POSTING))
    return out.repartitionById(parts, F.col("part"))


#: Words to be met again are marked in 2**WANTED bins.
WANTED = 20


def _packed(*keys: np.ndarray) -> np.ndarray:
    """The order by several whole numbers, the first the most important; by one packed number, if they fit."""
    span = [(int(k.min()), int(k.max())) for k in keys]
    packed, bits = np.zeros(len(keys[0]), np.uint64), 0
    for k, (low, high) in zip(keys, span):
        wide = (high - low).bit_length()
        bits += wide
        if bits > 64:
            return np.lexsort(keys[::-1])
        if wide < 64:
            packed <<= np.uint64(wide)
        packed |= k.astype(np.int64).view(np.uint64) - np.uint64(low & 0xFFFFFFFFFFFFFFFF)
    return np.argsort(packed)


def meet(p: dict[str, np.ndarray], percent: int, asked: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (b, a) of prefix words of one hash, a's class earlier than b's, that pass the filters; and whether each
    word's class may have more to ask, because it stopped after ``asked``."""
    m = len(p["key"])
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    order = _packed(p["doc"], p["line"])
    change = np.zeros(m, bool)
    change[1:] = (p["doc"][order][1:] != p["doc"][order][:-1]) | (p["line"][order][1:] != p["line"][order][:-1])
    place = np.empty(m, np.int64)
    place[order] = np.cumsum(change)
    n, at = p["n"].astype(np.int64), p["at"].astype(np.int64)
    # sizes of similar sets lie in the same or in neighbouring bands
    band = np.floor(np.log(n) / np.log(100 / percent * 1.001)).astype(np.int64) + 1 if percent < 100 else n
    list_of = p["key"].astype(np.int64) << 16 | np.minimum(band, (1 << 16) - 2)
    order = _packed(p["key"], np.minimum(band, (1 << 16) - 2), place)
    place, n, at, list_of, asks = place[order], n[order], at[order], list_of[order], p["asks"][order] > 0
    bits = [p[k][order] for k in ("low", "high")]
    # the smaller of two similar sets has their first shared word within this
    early = at < n - (-(-2 * percent * n // (100 + percent))) + 1

    def lists(of: np.ndarray):
        names, first = np.unique(list_of[of], return_index=True)
        return of, names, first, np.repeat(np.arange(len(names)), np.diff(np.append(first, len(of)))) << 40 | place[of]

    every = lists(np.arange(m))
    less = lists(np.flatnonzero(early))
    found, tried, could = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
    bs, as_ = [], []
    for step, (of, names, first, ranked) in ((0, every), (-1, less), (1, every)):
        if not len(names):
            continue
        b = np.flatnonzero(asks & early) if step == 1 else np.flatnonzero(asks)
        own = np.searchsorted(names, list_of[b] + step)
        ok = own < len(names)
        ok[ok] = names[own[ok]] == list_of[b][ok] + step
        b, own = b[ok], own[ok]
        low, high = first[own], np.searchsorted(ranked, own << 40 | place[b])
        could[b] += high - low
        go = (high > low) & ((found[b] < asked) if asked else True)
        b, low, high = b[go], low[go], high[go]
        while len(b):
            a = of[low]
            na, nb = n[a], n[b]
            near = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * np.minimum(na - at[a], nb - at[b]) >= percent * (na + nb))
            ok = np.flatnonzero(near)
            low_, high_ = (v[a[ok]] ^ v[b[ok]] for v in bits)
            fold = (na[ok] < WIDE) | (nb[ok] < WIDE)
            differ = np.bitwise_count(np.where(fold, low_ ^ high_, low_).view(np.uint64)).astype(np.int64) + np.bitwise_count(np.where(fold, 0, high_).view(np.uint64))
            ok = ok[(100 + percent) * differ <= (100 - percent) * (na + nb)[ok]]
            bs.append(order[b[ok]])
            as_.append(order[a[ok]])
            tried[b] += 1
            found[b[ok]] += 1
            low = low + 1
            go = low < high
            if asked:
                go &= found[b] < asked
            b, low, high = b[go], low[go], high[go]
    more = np.zeros(m, bool)
    more[order] = could > tried
    return np.concatenate(bs or [order[:0]]), np.concatenate(as_ or [order[:0]]), more


def _pairs(dealt: DataFrame, percent: int, asked: int | None) -> DataFrame:
    """(b, a, more): classes by place and tag, a earlier than b; more, if b may have others to ask."""
    names = ("doc", "line", "tag")

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        # a task may hold several parts: their words differ, so they are compared as one
        p = _opened(rows)
        rows.clear()
        b, a, more = meet(p, percent, asked)
        yield pa.RecordBatch.from_arrays([*(pa.array(p[k][b]) for k in names), *(pa.array(p[k][a]) for k in names), pa.array(more[b])], [*(f"b_{k}" for k in names), *(f"a_{k}" for k in names), "more"])

    return dealt.transform(C.arrow, run, "b_doc long, b_line int, b_tag int, a_doc long, a_line int, a_tag int, more boolean")


_B, _A = ["b_doc", "b_line", "b_tag"], ["a_doc", "a_line", "a_tag"]


def _later(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(b) of the checkpointed pairs whose whole sets are similar."""
    side = lambda names: pairs.select(F.col(names[0]).alias("doc"), F.col(names[1]).alias("line"))
    need = C.checkpoint(side(_B).union(side(_A)).groupBy("doc").agg(F.collect_set("line").alias("lines")))

    def sets(batches):
        for b in C.slices(batches, "text"):
            x = _Lines(_text(b))
            lists = b.column(b.schema.get_field_index("lines"))
            flat = lists.flatten().to_numpy().astype(np.int64)
            want = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy())) << 32 | flat
            ok = np.flatnonzero(np.isin(x.doc << 32 | x.no, want) & (x.size > 0))
            off = np.append(0, np.cumsum(x.size[ok]))
            token = x.token[np.repeat(x.off[ok] - off[:-1], x.size[ok]) + np.arange(off[-1])]
            of = pa.array(x.doc[ok])
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), pa.array(x.no[ok].astype(np.int32)), pa.array((x.key[0][ok] & 0xFFFFFFFF).astype(np.uint32).view(np.int32)), _blobs(token, off)], ["doc", "line", "tag", "words"])

    lines = docs.join(C.small_side(need, "lines"), "doc").select("doc", "lines", "text").transform(C.arrow, sets, "doc long, line int, tag int, words binary")
    lines = C.checkpoint(lines.dropDuplicates(["doc", "line", "tag"]))
    C.release(need)

    def run(batches):
        for b in C.slices(C.slices(batches, "x", kind=pa.large_binary()), "y", kind=pa.large_binary()):
            (ga, na), (gb, nb) = ((_joined(c, np.uint64), pc.binary_length(c).to_numpy() // 8) for c in b.columns[3:])
            # a pair's hashes side by side: what is in both follows itself
            pair, both = np.concatenate((np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb))), np.concatenate((ga, gb))
            order = C.group_order(pair, both)
            p, g = pair[order], both[order]
            same = np.bincount(p[1:][(p[1:] == p[:-1]) & (g[1:] == g[:-1])], minlength=b.num_rows)
            ok = pa.array(100 * same >= percent * (na + nb - same))
            yield pa.RecordBatch.from_arrays([c.filter(ok) for c in b.columns[:3]], _B)

    of = lambda names, c: lines.select(F.col("doc").alias(names[0]), F.col("line").alias(names[1]), F.col("tag").alias(names[2]), F.col("words").alias(c))
    joined = pairs.join(of(_B, "x"), _B).join(of(_A, "y"), _A).select(*_B, "x", "y")
    out = C.checkpoint(joined.transform(C.arrow, run, "b_doc long, b_line int, b_tag int").distinct())
    C.release(lines)
    return out


def removed(docs: DataFrame, percent: int = 80, min_words: int = 1) -> DataFrame:
    """(doc_id, th, line) of every line that goes; th is a hash of the text."""
    kind = docs.schema["doc_id"].dataType
    spark = docs.sparkSession
    docs, ids = _numbered(docs)
    counts = histogram(docs, "text", lambda b: C.Scan(_text(b), lower=True).word_hash(), BINS)
    # over 50 percent, sets that can be similar without being equal share two words at least
    rank = np.empty(len(counts), np.uint64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint64) << np.uint64(64 - BINS)
    rows = C.checkpoint(_rows(docs, spark.sparkContext.broadcast((rank, (counts > CHAIN) & (percent > 50))), min_words, percent))
    first = F.min(F.struct("doc", "line")).alias("first")
    classes = C.checkpoint(rows.groupBy("key_a", "key_b").agg(first, F.count("*").alias("lines"), *(F.first(c).alias(c) for c in ("n", "low", "high", "keys", "at"))).select("key_a", "key_b", "first.doc", "first.line", F.expr("cast(((key_a & 4294967295) ^ 2147483648) - 2147483648 as int)").alias("tag"), "lines", "n", "low", "high", "keys", "at"))
    places = C.checkpoint(rows.select("doc", "th", "line", "key_a", "key_b"))
    C.release(rows)
    some = classes.where(F.length("keys") > 0)
    size = some.agg(F.sum(F.length("keys") / 4)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size / PART) + 1)
    asks = lambda df, flag: df.select("doc", "line", "tag", "n", "low", "high", "keys", "at", flag.cast("byte").alias("asks"))
    found = _pairs(_dealt(asks(some, F.lit(1)), parts), percent, ASKED)
    pairs = C.checkpoint(found.groupBy(*_B, *_A).agg(F.max("more").alias("more"), F.count("*").alias("shared")))
    # of what a class asked, the one that it shares most words with is verified first
    best = pairs.groupBy(*_B).agg(F.max(F.struct("shared", *_A)).alias("x"), F.count("*").alias("asked"), F.max("more").alias("more"))
    best = C.checkpoint(best.select(*_B, *(F.col(f"x.{k}").alias(k) for k in _A), "asked", "more"))
    later = _later(docs, best, percent)
    # whom that doesn't settle then tries all that it asked, and all that it didn't if there is more
    left = best.where("more or asked > 1").join(later, _B, "left_anti")
    left = C.checkpoint(left.select(*_B, "more"))
    if left.head(1):
        rest = pairs.select(*_B, *_A).join(C.small_side(left).select(*_B), _B, "left_semi")
        if left.where("more").head(1):
            some = asks(some.join(C.small_side(left).where("more").select(*(F.col(k).alias(v) for k, v in zip(_B, ("doc", "line", "tag"))), F.lit(1).alias("open")), ["doc", "line", "tag"], "left"), F.coalesce("open", F.lit(0)))
            bins = histogram(some.where("asks = 1"), "keys", lambda b: _joined(b.column(0), np.uint32).astype(np.uint64) << np.uint64(32), WANTED)
            rest = rest.union(_pairs(_dealt(some, parts, spark.sparkContext.broadcast(bins > 0)), percent, None).select(*_B, *_A))
        rest = C.checkpoint(rest.distinct().join(best, [*_B, *_A], "left_anti"))
        later = later.union(_later(docs, rest, percent))
        C.release(rest)
    known = classes.select("key_a", "key_b", "doc", "line", "tag", "lines").join(C.small_side(later.toDF("doc", "line", "tag").withColumn("later", F.lit(True))), ["doc", "line", "tag"], "left")
    known = C.checkpoint(known.where("lines > 1 or later").select("key_a", "key_b", F.struct("doc", "line").alias("first"), F.coalesce("later", F.lit(False)).alias("later")))
    C.release(classes, pairs, best, left)
    out = places.join(known, ["key_a", "key_b"]).where(F.col("later") | (F.struct("doc", "line") > F.col("first"))).select("doc", "th", "line")
    return out.join(ids, "doc").select("doc_id", "th", "line") if ids is not None else out.select(F.col("doc").cast(kind).alias("doc_id"), "th", "line")


def deduplicated(docs: DataFrame, percent: int = 80, min_words: int = 1) -> DataFrame:
    """docs with their own columns, the text without the lines that go, and __n_lines and __n_removed beside."""
    gone = C.checkpoint(removed(docs, percent, min_words).groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_set("line").alias("__gone")))
    # within the outer lambda the text is split once, not for each line
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone["__gone"])
    left = F.transform(F.array(F.split(docs["text"], "\n")), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n"))[0]
    text = F.when(gone["__gone"].isNull(), docs["text"]).otherwise(left)
    n_lines = F.when(docs["text"].isNull(), 0).otherwise(F.octet_length(docs["text"]) - F.octet_length(F.replace(docs["text"], F.lit("\n"), F.lit(""))) + 1).cast("long")
    out = docs.join(C.small_side(gone, "__gone"), (docs["doc_id"] == gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__th"]), "left")
    return out.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns], n_lines.alias("__n_lines"), F.coalesce(F.size(gone["__gone"]), F.lit(0)).cast("long").alias("__n_removed"))
