"""Shared pieces: Arrow slices, byte-level word scanning, hashes, checkpoints, checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than space and \t..\r.
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Text handled at once by the vectorised scanners; a longer single text is still handled whole.
SLICE_BYTES = 1 << 20
#: Most bytes of rows that Spark sends to a Python worker at once.
ARROW_BYTES = 8 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Most rows of (id, small values) that may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_WORD = np.where(SPACE, np.uint64(0), _BYTE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """P**i and P**-i modulo 2**64 for i up to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_P, _P_INV)):
            steps = np.full(max(n, SLICE_BYTES) + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def group_order(group: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order by group and then by hash, so that equal hashes of a group lie together.

    One sort of 64-bit values, group above the hash's upper bits; where two hashes agree in those, both are compared.
    """
    bits = int(group.max()).bit_length() if len(group) else 0
    if bits <= 32:
        packed = h >> np.uint64(bits)
        if bits:
            packed = packed | group.astype(np.uint64) << np.uint64(64 - bits)
        order = np.argsort(packed)
        if bits == 0:
            return order
        p, v = packed[order], h[order]
        if not ((p[1:] == p[:-1]) & (v[1:] != v[:-1])).any():
            return order
    return np.lexsort((h, group))


class Scan:
    """Words of some texts, found and hashed on their UTF-8 bytes without a Python object per word.

    ``off``: byte offsets of texts (n + 1). ``start``: byte offset of each word. ``word_off``: offsets of each
    text's words. Null texts have no bytes and no words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        a = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        if a.null_count:
            a = a.fill_null("")
        self.n = len(a)
        off = np.frombuffer(a.buffers()[1], np.int64, self.n + 1, a.offset * 8) if self.n else np.zeros(1, np.int64)
        raw = a.buffers()[2] if self.n else None
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        # by comparisons, which are many times faster than looking each byte up in SPACE and LOWER
        self.off, self.data = off - off[0], data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)) if lower else data
        self.is_word = (self.data != 32) & (self.data - np.uint8(9) > 4)
        prev = np.empty_like(self.is_word)
        prev[1:] = self.is_word[:-1]
        inner = self.off[:-1][self.off[:-1] < len(self.data)]
        prev[inner] = False
        self.start = np.flatnonzero(self.is_word & ~prev)
        self.word_off = np.searchsorted(self.start, self.off)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_off)

    def docs(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(self.n), self.counts)

    def word_hash(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        pw, inv = powers(len(self.data))
        terms = np.empty(len(self.data), np.uint64)
        for a in range(0, len(terms), 1 << 14):  # few at once, which the cache holds
            part = slice(a, a + (1 << 14))
            np.multiply(_BYTE_WORD.take(self.data[part], mode="clip"), pw[a : a + len(terms[part])], out=terms[part])
        return mix(np.add.reduceat(terms, self.start) * inv[self.start])

    def shape_hash(self) -> np.ndarray:
        """Of each word's character classes with runs collapsed: Word -> Aa, of%%% -> a%."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        kind = _KIND[self.data]
        new = np.empty(len(kind), bool)
        new[0], new[1:] = True, kind[1:] != kind[:-1]
        new[self.start] = True
        new &= self.is_word
        run = np.cumsum(new)
        pw, inv = powers(len(self.data) + 1)
        sums = np.add.reduceat(np.where(new, _BYTE[kind] * pw[run], np.uint64(0)), self.start)
        return mix(sums * inv[run[self.start]])

    def ngrams(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n successive words within a text, and the text of each."""
        docs = self.docs()
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        m = len(h) - n + 1
        out = h[:m].copy()
        for k in range(1, n):
            out = out * _P + h[k : k + m]
        same = docs[:m] == docs[n - 1 :]
        return mix(out[same]), docs[:m][same]


_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = 97
_KIND[65:91] = 65
_KIND[48:58] = 48
_KIND[128:] = 97


def by_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values between successive offsets."""
    c = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return c[off[1:]] - c[off[:-1]]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES, kind: pa.DataType = pa.large_string()) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most so many bytes of a text (or binary) column, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        c = b.column(b.schema.get_field_index(column))
        c = c.cast(kind)
        off = np.frombuffer(c.buffers()[1], np.int64, len(c) + 1, c.offset * 8)
        at = 0
        while at < len(c):
            end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield b.slice(at, end - at)
            at = end


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches bounded in bytes (a session setting, lowered to ARROW_BYTES where it is higher), so that long
    texts don't pile up; a worker, which lives on, gives its freed memory back after each task."""
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH_BYTES).rstrip("bB")) > ARROW_BYTES:
        conf.set(_BATCH_BYTES, str(ARROW_BYTES))

    def tidy(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(tidy, schema)


def map_texts(docs: DataFrame, fn: Callable[[pa.RecordBatch], dict], added: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Selects keep and text, and puts fn's columns (a dict of arrays) beside keep for every slice of rows."""
    kept = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches):
        for b in slices(batches, text):
            cols = fn(b)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(k)) for k in keep] + [pa.array(v) if not isinstance(v, (pa.Array, pa.ChunkedArray)) else v for v in cols.values()], [*keep, *cols])

    return docs.select(*dict.fromkeys([*keep, text])).transform(arrow, run, f"{kept}, {added}" if kept else added)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names its shared folder in spark.checkpoint.dir. Only a local master, which is one machine, may go
    without; elsewhere a folder made here would be on the driver's disk alone."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quillbase-checkpoint-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through a Parquet table in the shared checkpoint folder.

    Unlike Dataset.checkpoint, which carries its plan's size estimates along (they multiply from round to round of an
    iterative plan), a table has its real size, by which later joins are planned. The tables lie in the run's own
    subfolder; release() removes those that nothing reads any more.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._checkpoint_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes checkpoint tables, once all that was built on them is itself written, and lets Spark's cleaner remove the
    shuffle files of what nothing refers to any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._checkpoint_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def shrink_heaps(spark: SparkSession) -> None:
    """A full collection in a task for each core, as executors keep a heap that an earlier stage has grown, beside which
    the Python workers of the next one have little room."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))).collect()


def small_side(df: DataFrame, lists: str | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a checkpointed table of narrow rows (and of lists with few entries in all) for broadcast only if it was
    counted to be small; else joins shuffle."""
    if lists is None:
        return F.broadcast(df) if df.count() <= most else df
    n, entries = df.agg(F.count("*"), F.sum(F.size(lists))).first()
    return F.broadcast(df) if n <= most and (entries or 0) <= 5 * most else df


def fitted(sample: DataFrame, train: Callable[[pa.Table], object], order: str = "doc_id"):
    """train's result on a sample that its caller has bounded in rows and bytes, in one executor task; the driver gets
    the model alone. Rows come sorted, so that a task that runs again gives the same. None for an empty sample."""

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(pa.Table.from_batches(rows)))], pa.binary())], ["model"])

    got = sample.repartition(1).sortWithinPartitions(order).transform(arrow, run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else None


def excerpt(text, most: int, parts: int = 8):
    """A text column of at most ``most`` characters: of a longer text, ``parts`` stretches spread evenly over it."""
    size = F.length(text)
    each = most // parts
    cut = [F.substring(text, F.lit(1) + F.floor((size - each) * (i / max(1, parts - 1))).cast("int"), F.lit(each)) for i in range(parts)]
    return F.when(size <= most, text).otherwise(F.concat_ws(" ", *cut))


def crc_mod(col: str, n: int):
    return F.pmod(F.crc32(F.col(col).cast("string")), F.lit(n))


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int, per_class: bool = False) -> DataFrame:
    """(doc_id, text, label) of at most about ``most`` labelled rows outside the held-out remainder, spread by a hash.

    The bound is on the rows that a classifier is fitted on, so the chosen ids may be broadcast.
    """
    # a hash that does not follow crc32, which the hold-out uses
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", modulus) != held)).select("doc_id", F.col(label).cast("int").alias("label")).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return docs.select("doc_id", "text").where(F.lit(False)).withColumn("label", F.lit(0))
    share = F.lit(0.0)
    for k, n in counts.items():
        part = most / max(1, len(counts)) / n if per_class else most / total
        share = F.when(F.col("label") == int(k), F.lit(float(min(1.0, part)))).otherwise(share)
    spread = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(77)), F.lit(1 << 30)) / float(1 << 30)
    chosen = own.where(spread < share)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
