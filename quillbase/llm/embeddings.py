"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per cell of near directions.

Equal vectors are one node with a count. A label (and length) of over SHARD vectors is split into cells of about SHARD
around pivots, fitted on a sample of PER rows a pivot (of MOST rows at most); every vector is indexed in the cell of its nearest pivot, and asks
the other cells whose pivots are nearly as near: how nearly is fitted so that RECALL of pairs just at the limit meet. So a vector meets a few graphs,
however many its label has. A cell of over 2 * SHARD vectors (or of very many guests) is dealt by hash into parts that all meet, in blocks of up to CELL parts by CELL.

Links within a graph are what its nodes find when they are inserted, those of guests what they find when they ask. A beam full
of links is widened, then scanned. Each graph is audited: AUDIT nodes or guests against brute force, and queries planted just at the limit. Where
fewer than RECALL of their links are found, beams are widened, and a graph that never gets there is scanned. Links are verified by cosine in double
precision. A task gives sums and a spanning forest, never its pairs.

Null, zero, or not finite vectors (or with null components) and vectors with a null label link with nothing. Equal rows
of one vec_id are one vector: each row comes back with the same result, and none counts as another's link. Unequal
vectors of one vec_id are several vectors in one component. A null vec_id links with nothing, and is kept. An empty
table gives no rows; columns of other names are no trouble.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

LIMIT = 0.93
SHARD, AUDIT, RECALL, CELL = 32768, 64, 0.99, 4
#: Vectors of a label that pivots are fitted on: for each pivot, and about at most.
PER, MOST = 64, 1 << 17
#: What single precision may take from a similarity; links are verified in double precision.
SLACK = 2e-6
M, EF_BUILD, EF, LEAN = 12, 48, 64, 16
#: Nodes inserted at once; a beam's marks of seen nodes held at once.
BATCH, SEEN = 1024, 1 << 24
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Graph:
    """Hierarchical graph over unit vectors; levels are drawn from a geometric distribution."""

    def __init__(self, x: np.ndarray, near: list[np.ndarray] | None = None, seed: int = 5, least: float | None = None):
        """With least, ``found`` are the pairs of at least that similarity, of each node with those inserted before it."""
        self.x = x = x.astype(np.float32, copy=False)
        self.least, self.found = least, []
        if near is not None:
            self.near = near
            return
        n = len(x)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(M)).astype(int), 5)
        order = np.argsort(-level, kind="stable")  # the first is the entry, upper levels come first
        self.x, self.order, level = x[order], order, level[order]
        self.near = [np.full((int((level >= k).sum()), 2 * M if not k else M), -1, np.int32) for k in range(level[0] + 1)] if n else []
        at = 1
        while at < n:
            size = min(n - at, max(1, min(BATCH, at // 2)))
            self._insert(np.arange(at, at + size), level)
            at += size

    def _spread(self, centre: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates (best first, -1 for none) those nearer to the centre than to a chosen one, then the rest."""
        v = self.x[np.maximum(ids, 0)]
        among = v @ v.transpose(0, 2, 1)
        taken = np.zeros(ids.shape, bool)
        for k in range(ids.shape[1]):
            taken[:, k] = (ids[:, k] >= 0) & ~(taken & (among[:, k] > sims[:, k, None])).any(1)
        rank = np.argsort(np.where(ids < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(ids, rank, 1)

    def _insert(self, new: np.ndarray, level: np.ndarray) -> None:
        q = self.x[new]
        start = np.zeros((len(new), 1), np.int64)
        mates = q @ q.T
        if self.least is not None:
            self.found += [new[x] for x in np.nonzero(np.triu(mates >= self.least, 1))]
        np.fill_diagonal(mates, -2)
        for k in range(len(self.near) - 1, -1, -1):
            ids, sims = self.search(q, start, EF_BUILD if k <= level[new].max() else 1, k, int(new[0]))
            if self.least is not None and not k:
                r, c = self._links(q, start, self.least, EF_BUILD, int(new[0]), (ids, sims))
                self.found += [new[r], c]
            start = ids[:, :1] if k else ids
            own = np.flatnonzero(level[new] >= k)
            if not len(own):
                continue
            fellow = mates[own][:, own]
            most = min(M, len(own) - 1)
            best = np.argpartition(-fellow, most, 1)[:, :most] if most else np.zeros((len(own), 0), np.int64)
            ids_k = np.concatenate((ids[own], new[own][best]), 1)
            sims_k = np.concatenate((sims[own], np.take_along_axis(fellow, best, 1)), 1)
            rank = np.argsort(-sims_k, 1)[:, : EF_BUILD]
            ids_k, sims_k = np.take_along_axis(ids_k, rank, 1), np.take_along_axis(sims_k, rank, 1)
            chosen = self._spread(q[own], ids_k, sims_k, M)
            table = self.near[k]
            table[new[own], : chosen.shape[1]] = chosen
            a, b = np.repeat(new[own], chosen.shape[1]), chosen.ravel()
            a, b = a[b >= 0], b[b >= 0]
            order = np.argsort(b, kind="stable")
            a, b = a[order], b[order]
            to, first, count = np.unique(b, return_index=True, return_counts=True)
            wide = np.full((len(to), count.max() if len(to) else 0), -1, np.int64)
            wide[np.repeat(np.arange(len(to)), count), np.arange(len(b)) - np.repeat(first, count)] = a
            every = np.concatenate((table[to], wide), 1)
            every = np.sort(every, 1)
            every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
            s = np.where(every >= 0, np.einsum("nd,nkd->nk", self.x[to], self.x[np.maximum(every, 0)]), -3)
            rank = np.argsort(-s, 1)[:, : 3 * table.shape[1]]
            every, s = np.take_along_axis(every, rank, 1), np.take_along_axis(s, rank, 1)
            kept = self._spread(self.x[to], np.where(s > -3, every, -1), s, table.shape[1])
            table[to] = -1
            table[to, : kept.shape[1]] = kept

    def search(self, q: np.ndarray, start: np.ndarray, ef: int, level: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """Beams (ids, similarities), best first, -1 and -2 where a beam isn't full. known: nodes inserted so far."""
        size = max(64, min(512, SEEN // (known + 1)))
        parts = [self._beams(q[a : a + size], start[a : a + size], ef, level, known) for a in range(0, len(q), size)]
        if not parts:
            return np.zeros((0, ef), np.int64), np.zeros((0, ef))
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])

    def _beams(self, q: np.ndarray, start: np.ndarray, ef: int, level: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        # an entry is one number: similarity (the highest first), node, and whether it was expanded
        table, q = self.near[level], q.astype(np.float32, copy=False)
        known = min(known, len(table))
        seen = np.zeros((len(q), known + 1), bool)
        seen[:, known] = True
        start = np.where((start >= 0) & (start < known), start, known)
        cand = np.where(np.all(start == known, 1, keepdims=True), 0, start)
        beam = np.full((len(q), ef), _NONE)
        live = np.arange(len(q))
        while len(live):
            cand = np.sort(cand, 1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = known
            r, c = np.nonzero(~seen[live[:, None], cand])
            ids = cand[r, c]
            seen[live[r], ids] = True
            s = np.einsum("nd,nd->n", q[live[r]], self.x[ids])
            fresh = np.full(cand.shape, _NONE)
            fresh[r, c] = ((2.0 - s.astype(np.float64)) * 2.0**29).astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64) << np.uint64(1)
            top = np.sort(np.concatenate((beam[live], fresh), 1), 1)[:, :ef]
            todo = top & np.uint64(1) == 0
            rank = np.cumsum(todo, 1, dtype=np.int32)
            r, c = np.nonzero(todo & (rank <= 4))  # the best that weren't expanded
            node = np.full((len(live), 4), -1, np.int64)
            node[r, rank[r, c] - 1] = top[r, c] >> np.uint64(1) & np.uint64(0x7FFFFFFF)
            top[r, c] |= np.uint64(1)
            beam[live] = top
            go = node[:, 0] >= 0
            live, node = live[go], node[go]
            cand = np.where(node[:, :, None] >= 0, table[node], -1).reshape(len(live), 4 * table.shape[1])
            cand = np.where((cand >= 0) & (cand < known), cand, known)
        sims = 2.0 - (beam >> np.uint64(32)) / 2.0**29
        return np.where(beam == _NONE, -1, (beam >> np.uint64(1) & np.uint64(0x7FFFFFFF)).astype(np.int64)), np.where(beam == _NONE, -2.0, sims)

    def _down(self, q: np.ndarray) -> np.ndarray:
        start = np.zeros((len(q), 1), np.int64)
        for k in range(len(self.near) - 1, 0, -1):
            start = self.search(q, start, 4, k, len(self.x))[0]
        return start

    def best(self, q: np.ndarray, ef: int) -> np.ndarray:
        """Similarity of the nearest node that a beam finds."""
        return self.search(q, self._down(q), ef, 0, len(self.x))[1][:, 0]

    def near_to(self, q: np.ndarray, least: float, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of at least that similarity."""
        return self._links(q, self._down(q), least, ef, len(self.x))

    def _links(self, q, start, least, ef, known, beams=None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs with the nodes known; a full beam of links is widened, and a query of more links than that is scanned."""
        out, todo, wide = [], np.arange(len(q)), min(ef, known)
        while len(todo):
            ids, sims = beams or self.search(q[todo], start, wide, 0, known)
            beams = None
            full = (sims[:, -1] >= least) & (ids.shape[1] < known)
            r, c = np.nonzero((sims >= least) & ~full[:, None])
            out.append((todo[r], ids[r, c]))
            todo, start = todo[full], ids[full]
            if len(todo) and wide > ef:
                r, c = _scan(q[todo], self.x[:known], least)
                out.append((todo[r], c))
                break
            wide = min(4 * ef, known)
        return tuple(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in out)]) for i in (0, 1))


def _scan(q: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    q = q.astype(x.dtype, copy=False)
    out = [np.nonzero(q[a : a + 128] @ x.T >= least) for a in range(0, len(q), 128)]
    return np.concatenate([np.zeros(0, np.int64), *(r + 128 * i for i, (r, _) in enumerate(out))]), np.concatenate([np.zeros(0, np.int64), *(c for _, c in out)])


def _planted(x: np.ndarray, least: float, seed: int = 9) -> np.ndarray:
    """A vector for each of x, at just that similarity in a random direction."""
    u = np.random.default_rng(seed).standard_normal(x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    return least * x + (1 - least * least) ** 0.5 * u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-30)


def _picks(n: int) -> np.ndarray:
    return np.unique(np.linspace(0, n - 1, min(AUDIT, n)).astype(int))


def linked(q: np.ndarray, graph: Graph, least: float, ef: int = EF) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, node) pairs, and the beam that passed the audit (0: scanned)."""
    pick = _picks(len(q))
    r, c = _scan(q[pick], graph.x, least)
    truth, ef = set(zip(r.tolist(), c.tolist())), min(ef, len(graph.x))
    # an audit of nothing would pass: for queries without links, some that have a link just at the limit are asked
    bare = 4 * (len(pick) - len(np.unique(r)))
    known = _planted(graph.x[np.linspace(0, len(graph.x) - 1, bare).astype(int)].astype(np.float64), least + 1e-6)
    while True:
        found = set(zip(*map(np.ndarray.tolist, graph.near_to(q[pick], least, ef))))
        hit = int((graph.best(known, ef) >= least).sum()) if bare else 0
        if len(found & truth) >= RECALL * len(truth) and hit >= RECALL * bare:
            return *graph.near_to(q, least, ef), ef
        if ef == len(graph.x):
            break
        ef = min(2 * ef, len(graph.x))
    return *_scan(q, graph.x, least), 0


def joined(graph: Graph) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within a graph, as found when its nodes were inserted; if the audit finds too few, all nodes ask again."""
    a, b = (np.concatenate([np.zeros(0, np.int64), *graph.found[i::2]]) for i in (0, 1))
    pick = _picks(len(graph.x))
    r, c = _scan(graph.x[pick], graph.x, graph.least)
    other = pick[r] != c
    truth = set(zip(pick[r][other].tolist(), c[other].tolist()))
    mine = np.isin(a, pick) | np.isin(b, pick)
    found = set(zip(a[mine].tolist(), b[mine].tolist())) | set(zip(b[mine].tolist(), a[mine].tolist()))
    known = _planted(graph.x[np.linspace(0, len(graph.x) - 1, 4 * AUDIT).astype(int)].astype(np.float64), graph.least + 1e-6)
    if len(found & truth) >= RECALL * len(truth) and (graph.best(known, min(EF_BUILD, len(graph.x))) >= graph.least).sum() >= RECALL * len(known):
        return a, b
    a, b, _ = linked(graph.x, graph, graph.least)  # found from either end
    keep = a != b
    return tuple(np.unique(np.stack((np.minimum(a, b)[keep], np.maximum(a, b)[keep])), axis=1))


def _pack(**arrays: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.savez(f, **arrays)
    return f.getvalue()


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least reachable id of each id in pairs (a, b)."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        root = root[root]
        if (root == before).all():
            return names, names[root]


FOUND = "rep long, links long, root long"
_PARTS = "lid long, cell int, parts int, part int, blob binary"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _true(a: dict, q: np.ndarray, b: dict, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a's rows q and b's rows c that are links in double precision."""
    keep = np.zeros(len(q), bool)
    for i in range(0, len(q), 1 << 14):
        x, y = a["x"][q[i : i + (1 << 14)]].astype(np.float64), b["x"][c[i : i + (1 << 14)]].astype(np.float64)
        keep[i : i + (1 << 14)] = np.einsum("nd,nd->n", x, y) / (np.sqrt((x**2).sum(1)) * np.sqrt((y**2).sum(1))) >= LIMIT
    return q[keep], c[keep]


def _sums(a: dict, q: np.ndarray, b: dict, c: np.ndarray) -> list[np.ndarray]:
    ids, other = a["ids"][q], b["ids"][c]
    names, roots = _forest(ids, other)
    n = np.bincount(np.searchsorted(names, ids), b["m"][c], len(names)) + np.bincount(np.searchsorted(names, other), a["m"][q], len(names))
    return [names, n.astype(np.int64), roots]


def _ask(guests: dict, homes: dict, graph: Graph) -> list[np.ndarray]:
    """Links of vectors that ask another cell's graph, or another part's of their own cell. Where two vectors ask each
    other's cell, the link counts in the lower."""
    q, c, _ = linked(_unit(guests["x"]), graph, LIMIT - SLACK, LEAN)
    own, here = guests["home"][q], homes["home"][c]
    off, asks = homes["off"], homes["asks"]
    wide = int(max(own.max(initial=0), asks.max(initial=0))) + 1
    both = np.isin(c * wide + own, np.repeat(np.arange(len(off) - 1), np.diff(off)) * wide + asks)
    keep = ~both | (here < own)
    q, c = _true(guests, q[keep], homes, c[keep])
    return _sums(guests, q, homes, c)


def _rows_of(t: pa.Table, order: np.ndarray) -> dict:
    t = t.take(pa.array(order))
    asks = t["asks"].combine_chunks()
    return {"ids": t["rep"].to_numpy(), "m": t["m"].to_numpy(), "x": _matrix(t["embedding"]), "home": t["home"].to_numpy(), "asks": asks.flatten().to_numpy(), "off": asks.offsets.to_numpy() - asks.offsets[0].as_py()}


def _part(t: pa.Table) -> pa.Table:
    """One part of a cell: the links within it, and those of the guests that ask it. Of a cell of several parts, the
    part itself, which the others are to meet."""
    guest, rep = t["guest"].to_numpy(), t["rep"].to_numpy()
    order = np.lexsort((rep, guest))
    home, away = order[~guest[order]], order[guest[order]]
    lid, cell, parts, part = (t[k][0].as_py() for k in ("lid", "cell", "parts", "part"))
    found, arrays = [], {}
    if len(home):
        rows = _rows_of(t, home)
        g = Graph(_unit(rows["x"]), least=LIMIT - SLACK)
        rows = _rows_of(t, home[g.order])
        a, b = joined(g)
        a, b = _true(rows, a, rows, b)
        found.append(_sums(rows, a, rows, b))
        arrays = rows | {f"near{k}": v for k, v in enumerate(g.near)}
    if parts > 1:
        blob = _pack(**(arrays or _rows_of(t, away)))
        found.append([np.zeros(1, np.int64)] * 3)
    elif len(home) and len(away):
        found.append(_ask(_rows_of(t, away), rows, g))
    names, links, roots = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)]) for i in range(3))
    n = len(names)
    blobs = pa.array([None] * (n - 1) + [blob], pa.binary()) if parts > 1 else pa.nulls(n, pa.binary())
    fixed = [pa.array(np.full(n, v, k)) for v, k in ((lid, np.int64), (cell, np.int32), (parts, np.int32), (part, np.int32))]
    return pa.Table.from_arrays([*fixed, blobs, pa.array(names), pa.array(links), pa.array(roots)], ["lid", "cell", "parts", "part", "blob", "rep", "links", "root"])


def _block(t: pa.Table) -> pa.Table:
    """The pairs of parts of one block: of its two groups of parts, or within its one group."""
    low, high = t["low"][0].as_py(), t["high"][0].as_py()
    parts = {}
    for i, blob in sorted(zip(t["part"].to_pylist(), t["blob"].to_pylist()), key=lambda x: x[0]):
        f = np.load(io.BytesIO(blob))
        parts[i] = {k: f[k] for k in f.files}
    found = [np.zeros((3, 0), np.int64)]
    for i in parts:
        for j in parts:
            # homes come first; the later part asks, and guests ask homes alone
            if i < j and (i // CELL, j // CELL) == (low, high) and "near0" in parts[i]:
                one, two = parts[i], parts[j]
                graph = Graph(_unit(one["x"]), [one[f"near{k}"] for k in range(sum(n.startswith("near") for n in one))])
                if "near0" in two:
                    q, c, _ = linked(_unit(two["x"]), graph, LIMIT - SLACK, LEAN)
                    q, c = _true(two, q, one, c)
                    found.append(np.stack(_sums(two, q, one, c)))
                else:
                    found.append(np.stack(_ask(two, one, graph)))
    names, links, roots = np.concatenate(found, 1)
    return pa.Table.from_arrays([pa.array(names), pa.array(links), pa.array(roots)], ["rep", "links", "root"])


def _pivots(t: pa.Table) -> pa.Table:
    """Directions that cells lie around, by spherical k-means over a sample, and how far below a vector's highest
    similarity to one of them another cell is still asked: so far that RECALL of the sample's vectors and of their
    neighbours just at the limit meet in a cell."""
    t = t.sort_by("rep")
    x, k = _unit(_matrix(t["embedding"])), t["cells"][0].as_py()
    p = x[np.random.default_rng(3).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(8):
        own = np.concatenate([(x[a : a + 4096] @ p.T).argmax(1) for a in range(0, len(x), 4096)])
        s = np.zeros(p.shape)
        np.add.at(s, own, x)
        length = np.linalg.norm(s, axis=1)
        p = np.where(length[:, None] > 0, s / np.maximum(length, 1e-30)[:, None], p)
    y = _planted(x.astype(np.float64), LIMIT)
    gap = []
    for a in range(0, len(x), 4096):
        sx, sy = x[a : a + 4096] @ p.T, y[a : a + 4096] @ p.T
        n = np.arange(len(sx))
        gap.append(np.minimum(sx.max(1) - sx[n, sy.argmax(1)], sy.max(1) - sy[n, sx.argmax(1)]))
    gap = float(np.quantile(np.concatenate(gap), RECALL, method="higher")) + 1e-6
    return pa.Table.from_arrays([t["lid"][:1], pa.array([_pack(p=p.astype(np.float32), gap=np.array(gap))], pa.binary())], ["lid", "blob"])


def _routed(rows: DataFrame, pivots: dict, whole: bool) -> DataFrame:
    """(lid, cell, guest, rep, m, embedding, home, asks): each vector at its home cell, and as a guest in those that it
    asks; without whole, only lid, cell and guest."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    kind = rows.schema["embedding"].dataType.simpleString()
    names = ["rep", "m", "embedding"] if whole else []

    def run(batches):
        for b in batches:
            lid = b.column(0).to_numpy()
            for label in np.unique(lid):
                at = np.flatnonzero(lid == label)
                part = b.take(pa.array(at))
                n = len(at)
                row, cell, home = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
                if label in shared.value:
                    p, gap = shared.value[label]
                    s = _unit(_matrix(part.column(3)).astype(np.float32)) @ p.T
                    home = s.argmax(1)
                    row, cell = np.nonzero(s >= s.max(1, keepdims=True) - gap)
                guest = cell != home[row]
                asks = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row[guest], minlength=n))).astype(np.int32)), pa.array(cell[guest].astype(np.int32)))
                out = part.take(pa.array(row))
                more = [pa.array(home[row].astype(np.int32)), asks.take(pa.array(row))] if whole else []
                yield pa.RecordBatch.from_arrays([out.column(0), pa.array(cell.astype(np.int32)), pa.array(guest), *([out.column(i) for i in (1, 2, 3)] if whole else []), *more], ["lid", "cell", "guest", *names, *(["home", "asks"] if whole else [])])

    schema = "lid long, cell int, guest boolean" + (f", rep long, m long, embedding {kind}, home int, asks array<int>" if whole else "")
    return rows.select("lid", "rep", "m", "embedding").transform(C.arrow, run, schema)


def _fitted(reps: DataFrame) -> dict:
    """Pivots and gap of each lid of more than SHARD vectors."""
    sizes = reps.groupBy("lid").agg(F.count("*").alias("n")).where(F.col("n") > SHARD)
    cells = F.least(F.ceil(F.col("n") / SHARD), F.lit(MOST // PER))
    big = C.checkpoint(sizes.select("lid", cells.cast("int").alias("cells"), (PER * cells / F.col("n")).alias("share")))
    spread = F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    sample = reps.join(C.small_side(big), "lid").where(spread < F.col("share")).select("lid", "cells", "rep", "embedding")
    out = {}
    for r in sample.groupBy("lid").applyInArrow(_pivots, "lid long, blob binary").collect():  # a pivot stands for SHARD rows
        f = np.load(io.BytesIO(r["blob"]))
        out[r["lid"]] = (f["p"], np.float32(f["gap"]))
    return out


def _met(reps: DataFrame) -> DataFrame:
    """(rep, links, root) of links between different vectors (lid, rep, m, embedding) of one lid."""
    pivots = _fitted(reps)
    count = C.checkpoint(_routed(reps, pivots, False).groupBy("lid", "cell").agg(F.sum((~F.col("guest")).cast("long")).alias("homes"), F.sum(F.col("guest").cast("long")).alias("guests")))
    several = (F.col("homes") > 2 * SHARD) | (F.col("guests") > 4 * SHARD)
    dealt = count.where(several & (F.col("homes") > 0)).select("lid", "cell", F.ceil(F.col("homes") / SHARD).cast("int").alias("h"), F.ceil(F.col("guests") / SHARD).cast("int").alias("g"))
    h, g = F.coalesce("h", F.lit(1)), F.coalesce("g", F.lit(0))
    block = F.xxhash64("rep", F.lit(4))
    rows = _routed(reps, pivots, True).join(C.small_side(C.checkpoint(dealt)), ["lid", "cell"], "left")
    rows = rows.withColumns({"parts": (h + g).cast("int"), "part": F.when(~F.col("guest"), F.pmod(block, h)).when(g > 0, h + F.pmod(block, g)).otherwise(0).cast("int")}).drop("h", "g")
    built = C.checkpoint(rows.groupBy("lid", "cell", "part").applyInArrow(_part, f"{_PARTS}, {FOUND}"))
    found = built.where("blob is null").select("rep", "links", "root")
    parts = built.where("blob is not null").select("lid", "cell", "parts", "part", "blob")
    if not parts.head(1):
        return found
    # a part goes to the blocks of its group of parts with every group; a block holds at most 2 * CELL parts
    own, other = F.floor(F.col("part") / CELL), F.explode(F.sequence(F.lit(0), F.floor((F.col("parts") - 1) / CELL).cast("int")))
    blocks = parts.select("lid", "cell", "part", "blob", own.cast("int").alias("own"), other.alias("other")).select("lid", "cell", "part", "blob", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    return C.checkpoint(found.union(blocks.groupBy("lid", "cell", "low", "high").applyInArrow(_block, FOUND)))


def near_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    v = F.col("embedding")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), "embedding").withColumns({"ok": F.coalesce(finite & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)), "h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), F.reverse("embedding")), "dim": F.size("embedding")})
    usable = rows.where("ok")
    one = usable
    if usable.count() != usable.select("vec_id").distinct().count():
        one = usable.dropDuplicates(["vec_id", "label", "dim", "h1", "h2"])
    # labels (with a length) by number
    lids = C.checkpoint(one.select("label", "dim").distinct().withColumn("lid", F.monotonically_increasing_id()))
    reps = one.groupBy("label", "dim", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("embedding").alias("embedding"))
    reps = C.checkpoint(reps.join(C.small_side(lids), ["label", "dim"]).select("label", "h1", "h2", "lid", "rep", "m", "embedding"))
    found = _met(reps)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = reps.select("label", "h1", "h2", "rep", "m").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("label", "h1", "h2", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = usable.select("vec_id", "label", "h1", "h2").join(named, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
