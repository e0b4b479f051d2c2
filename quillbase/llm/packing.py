"""Packing into sequences of at most MAX_LEN tokens by order-preserving dynamic programming.

Documents keep their order within an input partition; each is its ids and then id 0. Windows are cut at document
ends (no penalty), sentence ends (SENTENCE) or, in stretches without any, every GRID tokens (INSIDE). The cuts
minimise padding plus penalties: a window of L tokens pads MAX_LEN - L, or nothing if L is a power of two. The
best predecessor within MAX_LEN tokens comes from a monotone queue, as padding is a difference of positions; exact
powers of two are looked up beside it. Blocks of about BLOCK tokens are solved at a time and the last, unsettled
windows go over to the next block, so memory doesn't follow the partition. Null texts are packed as empty ones.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common as C

MAX_LEN = 1024
SENTENCE, INSIDE = 1.0, 4.0
GRID = 16
BLOCK = 1 << 19
#: White space of any kind beside a blank: such texts are encoded in one piece.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_UNEVEN = f"{_WHITE} | {_WHITE}"
_DARK = "[^" + _WHITE[1:] + "+"
_loaded: dict[str, tuple] = {}
#: The parts of the slice before, their ids and offsets: a few MB.
_last: dict[str, tuple] = {}
#: Bytes of text encoded at once.
SLICE = 8 << 20


def tokenizer(path: str):
    """The tokenizer of a file, and which of its ids end a sentence; kept for the life of the worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        ends = np.zeros(t.get_vocab_size(), bool)
        for token, i in t.get_vocab().items():
            ends[i] = token[-1:] in (".", "!", "?") or "Ċ" in token
        _loaded[path] = (t, ends)
    return _loaded[path]


def _spread(ids: np.ndarray, off: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered by pick, one after another, and where each begins and the last ends."""
    ends = np.zeros(len(pick) + 1, np.int64)
    np.cumsum((off[1:] - off[:-1])[pick], out=ends[1:])
    out = np.empty(ends[-1], np.uint32)
    for a in range(0, len(pick), 1 << 17):  # places of all ids at once would take eight times their size
        own, at = pick[a : a + (1 << 17)], ends[a : a + (1 << 17) + 1]
        size = np.diff(at)
        out[at[0] : at[-1]] = ids[np.repeat(off[:-1][own] - at[:-1], size) + np.arange(at[0], at[-1])]
    return out, ends


def _encode_each(t, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces encoded one by one, and their numbers."""
    ids, sizes = [np.zeros(0, np.uint32)], []
    for a in range(0, len(pieces), 20_000):  # the tokenizer's results are large objects
        lists = [e.ids for e in t.encode_batch_fast(pieces[a : a + 20_000], add_special_tokens=False)]
        sizes += map(len, lists)
        ids.append(np.fromiter(chain.from_iterable(lists), np.uint32))
    return np.concatenate(ids), np.array(sizes, np.int64)


def _encode_lines(t, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As _encode_each, for pieces without white space but for a blank at the start: many at once, as lines of a text.
    The tokenizer's own splitting always cuts beside such a line's break, and no id but the break's stands for it."""
    ids = [np.zeros(0, np.uint32)]
    for a in range(0, len(pieces), 20_000):
        block = pieces[a : a + 20_000]
        lines = ["\n".join([*block[k : k + 500], ""]) for k in range(0, len(block), 500)]
        ids += [np.array(e.ids, np.uint32) for e in t.encode_batch_fast(lines, add_special_tokens=False)]
    ids, mark = np.concatenate(ids), t.encode("\n", add_special_tokens=False).ids
    at = np.flatnonzero(ids == mark[0]) if len(mark) == 1 else []
    if len(at) != len(pieces):  # another kind of tokenizer
        return _encode_each(t, pieces)
    return np.delete(ids, at), np.diff(at, prepend=-1) - 1


def _splits_marks(t) -> bool:
    """Whether the tokenizer's own splitting is known to cut between a letter and a mark, and beside a single line break."""
    p = t.pre_tokenizer
    return type(p).__name__ == "ByteLevel" and p.use_regex and not p.add_prefix_space and t.normalizer is None


def _encode_marked(t, pieces: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """As _encode_lines, for pieces that may also hold single line breaks: cut there, and before the marks that end a
    line's words, so that a word is encoded once whatever follows it. What the call before encoded isn't encoded again."""
    cut = pc.replace_substring_regex(pieces, r"([A-Za-z])([.,!?;:]+)(\n|$)", "\\1\x1f\\2\\3")
    parts = pc.split_pattern(pc.replace_substring(cut, "\n", "\x1f\n\x1f"), "\x1f")
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy())))
    flat = parts.flatten().dictionary_encode()
    del cut, parts
    names, code = flat.dictionary, flat.indices.to_numpy()
    old, ids, off = _last.pop(path, (names[:0], np.zeros(0, np.uint32), np.zeros(1, np.int64)))
    place = pc.fill_null(pc.index_in(names, value_set=old), -1).to_numpy().astype(np.int64)
    fresh = np.flatnonzero(place < 0)
    place[fresh] = len(old) + np.arange(len(fresh))
    words = names.take(pa.array(fresh)).to_pylist()
    if "\n" in words:  # which can't be a line
        at = words.index("\n")
        place[fresh] = np.concatenate((place[fresh][:at], place[fresh][-1:], place[fresh][at:-1]))
        words.append(words.pop(at))
    lines = len(words) - (words[-1:] == ["\n"])
    new, sizes = _encode_lines(t, words[:lines])
    mark, size = _encode_each(t, words[lines:])
    ids, off = _spread(np.concatenate((ids, new, mark)), np.concatenate((off, off[-1] + np.cumsum(np.concatenate((sizes, size))))), place)
    _last[path] = (names, ids, off)
    out, off = _spread(ids, off, code)
    return out, np.diff(off[ends])


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and offsets. A text is cut before each single blank, where the tokenizer's own splitting
    always cuts, so that each distinct piece (or part of one) is encoded once; texts with other white space beside a
    blank aren't cut."""
    t, _ = tokenizer(path)
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    uneven = pc.match_substring_regex(texts, _UNEVEN)
    odd = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
    parts = pc.split_pattern(pc.if_else(uneven, pa.scalar("", pa.large_string()), texts) if len(odd) else texts, " ")
    count = pc.list_value_length(parts).to_numpy()
    flat = parts.flatten().dictionary_encode()
    names = flat.dictionary
    code = flat.indices.to_numpy().copy()  # 32 bits, twice which no slice of texts reaches
    del parts, flat
    begin = np.cumsum(count) - count
    code[begin[count > 0]] += len(names)  # a text's first piece has no blank before it
    seen = np.zeros(2 * len(names), bool)
    seen[code] = True
    used = np.flatnonzero(seen)
    number = np.zeros(2 * len(names), np.int32)
    number[used] = np.arange(len(used))
    code = number[code]
    parted = _splits_marks(t)
    plain = pc.match_substring_regex(names, f"^{_DARK}(\\n{_DARK})*$" if parted else f"^{_DARK}$").to_numpy(zero_copy_only=False)
    plain = np.tile(plain, 2)[used]
    easy, hard = np.flatnonzero(plain), np.flatnonzero(~plain)

    def pieces(k):
        own, blank = names.take(pa.array(used[k] % len(names))), pa.array(used[k] < len(names))
        return pc.if_else(blank, pc.binary_join_element_wise(pa.scalar(" ", names.type), own, pa.scalar("", names.type)), own)

    ids_a, size_a = _encode_marked(t, pieces(easy), path) if parted else _encode_lines(t, pieces(easy).to_pylist())
    ids_b, size_b = _encode_each(t, pieces(hard).to_pylist() + [texts[int(i)].as_py() for i in odd])
    del names
    place = np.empty(len(used), np.int32)
    place[easy], place[hard] = np.arange(len(easy)), len(easy) + np.arange(len(hard))
    code = place[code]
    if len(odd):  # the odd texts have one empty piece each, whose place their own lists take
        code[begin[odd]] = len(used) + np.arange(len(odd))
    out, ends = _spread(np.concatenate((ids_a, ids_b)), np.concatenate(([0], np.cumsum(np.concatenate((size_a, size_b))))).astype(np.int64), code)
    return out, ends[np.concatenate(([0], np.cumsum(count)))]


def cuts(ids: np.ndarray, doc_end: np.ndarray, sentence_ids: np.ndarray, last: bool, max_len: int = MAX_LEN) -> np.ndarray:
    """Window ends for one block of tokens. doc_end: positions after each document."""
    n = len(ids)
    penalty = np.full(n + 1, np.inf)
    penalty[1:][sentence_ids[ids]] = SENTENCE
    penalty[doc_end] = 0
    if last:  # the end of the partition can be cut anywhere
        penalty[max(1, n - max_len) :] = np.minimum(penalty[max(1, n - max_len) :], INSIDE)
    can = np.isfinite(penalty)
    can[[0, n]] = True
    known = np.flatnonzero(can)
    gap = np.diff(known)
    wide = np.flatnonzero(gap > 2 * GRID)
    if len(wide):
        more = (gap[wide] - 1) // GRID
        at = np.repeat(known[wide], more) + GRID * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
        penalty[at], can[at] = INSIDE, True
        known = np.flatnonzero(can)
    penalty[n] = 0
    place = np.full(n + 1, -1, np.int64)
    place[known] = np.arange(len(known))
    jumps: list[tuple[int, ...]] = [()] * len(known)
    for b in (128, 256, 512) if not last else (2, 4, 8, 16, 32, 64, 128, 256, 512):
        if b < max_len:
            k = np.flatnonzero(known >= b)
            if last and b < 128:
                k = k[known[k] > n - max_len]
            i = place[known[k] - b]
            for a, c in zip(k[i >= 0].tolist(), i[i >= 0].tolist()):
                jumps[a] += (c,)
    p, pen = known.tolist(), penalty[known].tolist()
    best, back = [0.0] * len(p), [0] * len(p)
    queue: deque[int] = deque([0])
    value = [0.0] * len(p)  # best + position, smallest at the queue's head
    for k, (at, more, fee) in enumerate(zip(p, jumps, pen)):
        if not k:
            continue
        while p[queue[0]] < at - max_len:
            queue.popleft()
        i = queue[0]
        cost = value[i] + max_len - at
        for j in more:
            if best[j] < cost:
                cost, i = best[j], j
        cost += fee
        best[k], back[k] = cost, i
        v = value[k] = cost + at
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(k)
    out, k = [], len(p) - 1
    while k:
        out.append(p[k])
        k = back[k]
    return np.array(out[::-1], np.int64)


class _Packer:
    """State of one partition: tokens not yet settled, with their documents."""

    def __init__(self, path: str, key: int):
        self.path, self.key, self.made = path, key, 0
        self.ids = np.zeros(0, np.uint32)
        self.docs: list[list] = []  # id, tokens before what is held, tokens held, tokens in all

    def add(self, names: list, ids: np.ndarray, off: np.ndarray) -> None:
        size = np.diff(off) + 1
        out = np.zeros(len(ids) + len(names), np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(names)), size - 1)] = ids
        self.ids = np.concatenate((self.ids, out))
        self.docs += [[d, 0, int(s), int(s)] for d, s in zip(names, size)]

    def settle(self, last: bool) -> list[tuple]:
        """Pieces of the windows that are final."""
        if not len(self.ids):
            return []
        ends = np.cumsum([d[2] for d in self.docs])
        cut = cuts(self.ids, ends, tokenizer(self.path)[1], last)
        if not last:  # what a later document might change
            cut = cut[cut <= len(self.ids) - 4 * MAX_LEN]
        rows, at, k = [], 0, 0
        raw = memoryview(self.ids.tobytes())
        for end in cut.tolist():
            offset, name = 0, (self.key << 33) + self.made
            self.made += 1
            while at < end:
                d = self.docs[k]
                take = min(d[2], end - at)
                rows.append((d[0], d[1], take, zlib.crc32(raw[4 * at : 4 * (at + take)]), d[3], name, offset))
                at, offset = at + take, offset + take
                d[1], d[2] = d[1] + take, d[2] - take
                k += not d[2]
        self.ids, self.docs = self.ids[at:].copy(), self.docs[k:]
        return rows


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        packer, id_type = _Packer(tokenizer_path, TaskContext.get().partitionId()), None

        def out(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(np.array(c, np.int64)) for c in cols[1:])], list(COLUMNS))

        for b in C.slices(batches, "text", SLICE):
            name, text = b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("text"))
            id_type, names = name.type, name.to_pylist()
            ids, off = encode(text, tokenizer_path)
            at = 0
            while at < len(names):  # as many documents as a block holds, or one
                end = max(at + 1, int(np.searchsorted(off, off[at] + BLOCK, "right")) - 1)
                packer.add(names[at:end], ids[off[at] : off[end]], off[at : end + 1] - off[at])
                at = end
                if len(packer.ids) >= BLOCK and (rows := packer.settle(False)):
                    yield out(rows)
            del ids, off
        if rows := packer.settle(True):
            yield out(rows)

    return docs.select("doc_id", "text").transform(C.arrow, run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
