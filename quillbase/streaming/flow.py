"""Live results: a changelog is read as a stream, and each batch's page is compared with the one before.

Comparing pages is the whole of live membership, ordering, eviction beyond the limit and back-filling: a record that
enters gives an Addition, one that moves or changes a Change, one that leaves a Removal with its reason. State is one
page (a request's limit bounds it), never the table. The first batch gives the initial values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import history, requests
from ..sources.store import Store

Sink = Callable[[int, list[dict]], None]


def page_updates(before: list[dict] | None, after: list[dict], key: list[str], deleted: dict[tuple, str]) -> list[dict]:
    """Updates that turn one page into the next. Removals go first, as a full page back-fills."""
    if before is None:
        return [{"kind": "InitialValues", "values": after}]
    name = lambda r: tuple(r[k] for k in key)
    old, new = {name(r): (i, r) for i, r in enumerate(before)}, {name(r): (i, r) for i, r in enumerate(after)}
    out = [{"kind": "Removal", "key": k, "reason": deleted.get(k, "NotInRange")} for k in old if k not in new]
    for i, r in enumerate(after):
        k = name(r)
        if k not in old:
            out.append({"kind": "Addition", "key": k, "values": r, "index": i})
        elif old[k][1] != r:
            out.append({"kind": "Change", "key": k, "values": r, "index": i, "changed": sorted(c for c in r if r[c] != old[k][1].get(c))})
    return out


def fold(page: list[dict], updates: list[dict], key: list[str]) -> list[dict]:
    """A client's page after updates: the same as a fresh scan's."""
    name = lambda r: tuple(r[k] for k in key)
    page = list(page)
    for u in updates:
        if u["kind"] in ("InitialValues", "InitialChanges", "OrderedKeys"):
            page = list(u["values"])
            continue
        if u["kind"] == "Past":  # what led to the page
            continue
        page = [r for r in page if name(r) != u["key"]]
        if u["kind"] != "Removal":
            page.insert(u["index"], u["values"])
    return page


#: What a flow follows, and its first element.
FIRST = {"get": "InitialValues", "scan": "InitialValues", "get_changes": "InitialChanges", "scan_changes": "InitialChanges", "get_updates": "OrderedKeys", "scan_updates": "OrderedKeys"}


def execute_flow(store: Store, request: requests.Scan | requests.Get, sink: Sink, checkpoint: str, once: bool = False, kind: str | None = None, max_versions: int = 1) -> StreamingQuery:
    """Streams a request's updates to sink(batch, updates). toVersion isn't allowed.

    kind is one of FIRST, by default get or scan after the request. Flows of changes begin with the versioned changes of
    the page's keys, those of updates with its ordered keys and the updates so far; changes of pages follow in all alike.
    A batch is pinned to the newest version it brought, so what is written meanwhile waits for its own batch. After a
    restart the first batch gives the first element again: delivery is at least once, and fold() is idempotent.
    """
    kind = kind or ("scan" if isinstance(request, requests.Scan) else "get")
    if kind not in FIRST or kind.startswith("scan") != isinstance(request, requests.Scan):
        raise requests.RequestError(f"no flow of {kind} for this request")
    if request.to_version is not None:
        raise requests.RequestError("a flow has no end version")
    if kind in ("scan_changes", "scan_updates"):
        requests.immutable_only(store.model, request.where if kind == "scan_changes" else None, request.order)
    spark: SparkSession = store.spark
    state: dict[str, list[dict] | None] = {"page": None}

    def rows_at(top: int) -> list[dict]:
        """One page, or the asked keys."""
        if kind.startswith("scan"):
            page = requests.fetch_scan(store.model, store.snapshot(top), request).rows
        else:
            page = requests.fetch_get(store.model, store.snapshot(top, store._keys(list(request.keys)).distinct()), request).rows.drop("__ordinal")
        return [r.asDict(True) for r in page.collect()]

    def first(rows: list[dict], top: int) -> list[dict]:
        keys = [tuple(r[k] for k in store.key) for r in rows]
        if FIRST[kind] == "InitialValues" or not keys:
            return [{"kind": FIRST[kind], "values": rows, "keys": keys}]
        if FIRST[kind] == "InitialChanges":
            return [{"kind": "InitialChanges", "changes": [r.asDict(True) for r in store.get_changes(keys, 0, top, max_versions).collect()], "values": rows}]
        return [{"kind": "OrderedKeys", "keys": keys, "values": rows}, *({"kind": "Past", "update": r.asDict(True)} for r in store.get_updates(keys, 0, top, max_versions).collect())]

    def batch(changed: DataFrame, n: int) -> None:
        top = changed.agg(F.max("_version")).first()[0]
        if top is None:
            return
        rows = rows_at(top)
        gone = {tuple(r[k] for k in store.key): ("SoftDelete" if r["_op"] == history.SOFT else "HardDelete") for r in _removed(changed, store.key, state["page"])}
        updates = first(rows, top) if state["page"] is None else page_updates(state["page"], rows, store.key, gone)
        state["page"] = rows
        if updates:
            sink(n, updates)

    stream = spark.readStream.schema(store.schema()).parquet(store.path)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def _removed(changed: DataFrame, key: list[str], page: list[dict] | None) -> list:
    """Deletions of records that were on the page."""
    if not page:
        return []
    last = changed.groupBy(*key).agg(F.max_by("_op", "_version").alias("_op")).where(F.col("_op").isin(history.SOFT, history.HARD))
    here = changed.sparkSession.createDataFrame([tuple(r[k] for k in key) for r in page], last.select(*key).schema)
    return last.join(F.broadcast(here), key).collect()
