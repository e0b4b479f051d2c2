"""Requests, checked when they are made, and their compilation to DataFrames."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.refs import Ref, ref
from ..model import NUMBERS, Index, Model, ModelError, Part, Prop
from ..operators import filters as fl
from ..operators.aggregations import aggregate
from ..operators.projection import Pick, project

#: Limits of requests.
MAX_KEYS = MAX_LIMIT = 100_000
DEFAULT_LIMIT = 100
MAX_VERSIONS = 1_000
HIDDEN = "_is_deleted"


class RequestError(ValueError):
    """A request that can't be planned."""


@dataclass(frozen=True)
class Order:
    """One property, or the key if none."""

    name: str | None = None
    descending: bool = False


@dataclass(frozen=True)
class Get:
    """Records in the order of the asked keys; missing keys are skipped."""

    keys: tuple
    select: list[Pick | str] | None = None
    where: fl.Filter | None = None
    to_version: int | None = None
    filter_soft_deleted: bool = True
    aggregations: dict | None = None

    def __post_init__(self):
        if len(self.keys) > MAX_KEYS:
            raise RequestError(f"at most {MAX_KEYS} keys")


@dataclass(frozen=True)
class Scan:
    start_key: tuple | None = None
    select: list[Pick | str] | None = None
    where: fl.Filter | None = None
    order: tuple[Order, ...] = ()
    limit: int = DEFAULT_LIMIT
    include_start: bool = True
    to_version: int | None = None
    filter_soft_deleted: bool = True
    aggregations: dict | None = None
    allow_table_scan: bool = False
    cursor: str | None = None
    #: False also allows orders that no key or index has.
    strict: bool = True

    def __post_init__(self):
        if not 1 <= self.limit <= MAX_LIMIT:
            raise RequestError(f"limit is 1 to {MAX_LIMIT}")
        if self.cursor and self.start_key:
            raise RequestError("a cursor or a start key")


@dataclass(frozen=True)
class PlanInfo:
    """Which way a request takes: FetchByKey, TableScan, IndexScan, FetchByUniqueKey or UpdateHistoryIndex."""

    path: str
    index: str | None = None
    descending: bool = False


@dataclass
class Response:
    rows: DataFrame
    info: PlanInfo
    aggregations: DataFrame | None = None
    _next: Callable[[], str | None] = field(default=lambda: None)

    def next_cursor(self) -> str | None:
        """A token for the page after this one; only a full page has one. Reads the page's last row."""
        return self._next()


def _equal_names(f: fl.Filter | None) -> dict[str, Any]:
    """Plain properties that the filter fixes."""
    if isinstance(f, fl.And):
        return {k: v for x in f.filters for k, v in _equal_names(x).items()}
    if isinstance(f, fl.Equals):
        return {r.steps[0][1]: v for r, v in f.pairs if len(r.steps) == 1}
    return {}


def _ranged_names(f: fl.Filter | None) -> set[str]:
    if isinstance(f, fl.And):
        return {k for x in f.filters for k in _ranged_names(x)}
    if isinstance(f, (fl.LessThan, fl.LessThanEquals, fl.GreaterThan, fl.GreaterThanEquals, fl.Range, fl.Prefix, fl.ValueIn)):
        return {r.steps[0][1] for r, _ in f.pairs if len(r.steps) == 1}
    return set()


def choose(model: Model, request: Scan) -> PlanInfo:
    """The access path: whole key, unique value, the index that the order names, or the table."""
    fixed = _equal_names(request.where)
    if model.key and all(p.ref in fixed for p in model.key):
        return PlanInfo("FetchByKey")
    if any(p.unique and p.name in fixed for p in model.props):
        return PlanInfo("FetchByUniqueKey")
    orders = [o for o in request.order if o.name is not None]
    if not orders:
        down = bool(request.order and request.order[0].descending)
        for i in model.indexes:  # an index whose first parts the filter fixes beats the table
            if not i.search and i.parts[0].ref in fixed:
                return PlanInfo("IndexScan", i.name, down)
        return PlanInfo("TableScan", None, down)
    candidates: list[tuple[str | None, tuple]] = [(None, model.key), *((i.name, i.parts) for i in model.indexes if not i.search)]
    for name, parts in candidates:
        rest = list(parts)
        at, turned = 0, None
        for o in orders:
            while at < len(rest) and rest[at].ref != o.name and rest[at].ref in fixed:
                at += 1
            if at == len(rest) or rest[at].ref != o.name:
                at = -1
                break
            down = o.descending != (rest[at].transform == "reversed")
            if turned is not None and down != turned:
                at = -1
                break
            turned, at = down, at + 1
        if at >= 0:
            return PlanInfo("TableScan" if name is None else "IndexScan", name, bool(turned))
    if request.strict:
        raise RequestError(f"no key or index of {model.name} has the order {[(o.name, o.descending) for o in orders]}")
    return PlanInfo("TableScan")


def _guard(model: Model, request: Scan, info: PlanInfo) -> None:
    """A filtered scan of the whole table needs leave, unless the filter bounds the key's first part."""
    if info.path == "TableScan" and request.where is not None and not request.allow_table_scan and request.strict and model.key:
        first = model.key[0].ref
        if first not in _equal_names(request.where) and first not in _ranged_names(request.where):
            raise RequestError("the filter reads the whole table: allow_table_scan")


#: The largest dates that an absent one stands for.
MAX_DATE, MAX_DATETIME, MAX_TIME = "9999-12-31", "9999-12-31 23:59:59.999999", 24 * 3600 * 10**9 - 1
#: Parts with several entries a record: list items and set values, map keys, map values, words.
ENTRIES = ("any", "any_key", "any_value", "split")


def max_of(p: Prop) -> Column:
    """What an absent value counts as under to_max: the property's maximum, or its type's."""
    if p.max_value is not None:
        return F.lit(p.max_value).cast(p.type())
    if p.kind in NUMBERS:
        bits, signed, carrier = NUMBERS[p.kind]
        if not bits:
            return F.lit(3.4028234663852886e38 if p.kind == "float32" else 1.7976931348623157e308).cast(carrier)
        return F.lit(str((1 << (bits - signed)) - 1)).cast(carrier)
    if p.kind == "decimal":
        return F.lit("9" * (p.precision - p.scale) + "." + "9" * p.scale).cast(p.type())
    known = {"date": MAX_DATE, "datetime": MAX_DATETIME, "time": MAX_TIME}
    if p.kind not in known:
        raise ModelError(f"{p.name}: no maximum")
    return F.lit(known[p.kind]).cast(p.type())


def _tests(f: fl.Filter | None, name: str) -> list[Callable[[Column], Column]]:
    """What the filter's conjuncts ask of any entry of a property."""
    if isinstance(f, fl.And):
        return [t for x in f.filters for t in _tests(x, name)]
    if isinstance(f, fl._Pairs):
        test = lambda v: lambda c: F.coalesce(f.leaf(c, v, fl.Context()), F.lit(False))
        return [test(v) for r, v in f.pairs if r.steps[0][1] == name and len(r.steps) == 2 and r.steps[1][0] in ("any", "any_key", "any_value")]
    return []


def part_value(model: Model, part: Part, descending: bool = False, where: fl.Filter | None = None) -> Column:
    """What orders a record at a part of an index; null if the record isn't in the index. A part with several entries
    stands for the first of those that the filter takes, in the scan's direction; as several such parts make every
    combination, the first combination has the first entry of each."""
    c = ref(part.ref).value()
    if part.transform == "to_max":
        return F.coalesce(c, max_of(model.prop(part.ref)))
    if part.transform == "normalize":
        return text.normalize(c)
    if part.transform == "geohash":
        return geo.geohash(c.getField("lat"), c.getField("lon"), part.option or 32)
    if part.transform in ENTRIES:
        entries = {"any": c, "any_key": F.map_keys(c), "any_value": F.map_values(c)}[part.transform] if part.transform != "split" else text.split(c, part.option or text.WORD_BOUNDARY)
        for test in _tests(where, part.ref):
            entries = F.filter(entries, test)
        return F.array_max(entries) if descending else F.array_min(entries)
    return c


def order_columns(model: Model, request: Scan, info: PlanInfo) -> list[tuple[Column, bool]]:
    """(value, descending) that order a page: an index by its parts' values; ties by key in the scan's direction."""
    turned = lambda p: (p.transform == "reversed") != info.descending
    key = [(p.ref, ref(p.ref).value(), turned(p)) for p in model.key]
    if info.index:
        own = [(p.ref if p.transform in ("ref", "reversed") else None, part_value(model, p, turned(p), request.where), turned(p)) for p in _index(model, info.index).parts]
    else:
        own = [(o.name, F.col(f"`{o.name}`"), o.descending) for o in request.order if o.name is not None]
    done = {n for n, _, _ in own if n}
    return [(c, d) for _, c, d in own] + [(c, d) for n, c, d in key if n not in done]


def _index(model: Model, name: str) -> Index:
    return next(i for i in model.indexes if i.name == name)


def context(model: Model, info: PlanInfo | None = None) -> fl.Context:
    """Named searches, and the transforms of the references that the scanned index holds."""
    searches = {i.name: fl.Search(tuple(p.ref for p in i.parts), *([i.parts[0].option] if i.parts[0].option else [])) for i in model.indexes if i.search}
    parts = _index(model, info.index).parts if info and info.index else ()
    return fl.Context(searches, {p.ref: (text.normalize, text.normalize_term) for p in parts if p.transform == "normalize"})


def _literal(v: Any, kind: str) -> Column:
    """A value of a Spark type; dates travel as text, as a literal's time zone must not shift them."""
    return F.lit(str(v) if isinstance(v, (dt.date, dt.datetime, Decimal)) else bytes(v) if isinstance(v, bytearray) else v).cast(kind)


def _after(cols: list[tuple[Column, bool]], values: list, kinds: list[str], inclusive: bool) -> Column:
    """Rows at or after a place in the order, in which nulls come first, or last if it descends."""
    out = F.lit(inclusive)
    for (c, down), v, kind in reversed(list(zip(cols, values, kinds))):
        if v is None:
            beyond, same = (F.lit(False) if down else c.isNotNull()), c.isNull()
        else:
            at = _literal(v, kind)
            beyond, same = ((c < at) | c.isNull() if down else c > at), c == at
        out = F.coalesce(beyond, F.lit(False)) | (F.coalesce(same, F.lit(False)) & out)
    return out


def fingerprint(model: Model, request: Scan) -> str:
    plain = [model.name, model.version, model.schema().json(), [(o.name, o.descending) for o in request.order], _describe(request.where), request.filter_soft_deleted, request.to_version]
    return hashlib.sha256(json.dumps(plain, default=str).encode()).hexdigest()[:24]


def _describe(f: Any) -> Any:
    """The same in every process: sets and dictionaries in order, tables by their columns."""
    if isinstance(f, fl.Filter):
        return [type(f).__name__, {k: _describe(v) for k, v in sorted(vars(f).items())}]
    if isinstance(f, Ref):
        return [[k, _describe(v)] for k, v in f.steps]
    if isinstance(f, (set, frozenset)):
        return sorted((_describe(x) for x in f), key=str)
    if isinstance(f, dict):
        return sorted(([_describe(k), _describe(v)] for k, v in f.items()), key=str)
    if isinstance(f, (list, tuple)):
        return [_describe(x) for x in f]
    if hasattr(f, "table"):
        return [f.name, f.key, f.table.columns]
    return repr(f)


#: How a place's values are written, and read.
_WRITE: dict[type, tuple[str, Callable[[Any], str]]] = {bool: ("bool", str), int: ("int", str), float: ("float", repr), str: ("str", str), bytes: ("bytes", bytes.hex), bytearray: ("bytes", lambda v: bytes(v).hex()), Decimal: ("decimal", str), dt.datetime: ("datetime", dt.datetime.isoformat), dt.date: ("date", dt.date.isoformat)}
_READ: dict[str, Callable[[str], Any]] = {"bool": lambda s: s == "True", "int": int, "float": float, "str": str, "bytes": bytes.fromhex, "decimal": Decimal, "datetime": dt.datetime.fromisoformat, "date": dt.date.fromisoformat}


def encode_cursor(model: Model, request: Scan, values: list) -> str:
    at = [None if v is None else [(kind := _WRITE[type(v)])[0], kind[1](v)] for v in values]
    return base64.urlsafe_b64encode(json.dumps({"for": fingerprint(model, request), "at": at}).encode()).decode()


def decode_cursor(model: Model, request: Scan, token: str) -> list:
    try:
        got = json.loads(base64.urlsafe_b64decode(token))
        if got.get("for") != fingerprint(model, request):
            raise RequestError("the cursor is of another query or model")
        return [None if x is None else _READ[x[0]](x[1]) for x in got["at"]]
    except RequestError:
        raise
    except (ValueError, KeyError, TypeError, IndexError, AttributeError) as e:
        raise RequestError("not a cursor") from e


def fetch_get(model: Model, table: DataFrame, request: Get) -> Response:
    """The keys ride along with their place, so the result is ordered as asked."""
    names = model.key_columns()
    rows = [(*(k if isinstance(k, tuple) else (k,)), i) for i, k in enumerate(request.keys)]
    kinds = ", ".join(f"`__key_{n}` {table.schema[n].dataType.simpleString()}" for n in names)
    keys = table.sparkSession.createDataFrame(rows, f"{kinds}, __ordinal int")
    cond = [table[n] == F.col(f"__key_{n}") for n in names]
    page = F.broadcast(keys) if len(rows) <= 10_000 else keys
    out = table.join(page, cond).drop(*[f"__key_{n}" for n in names])
    out = _visible(out, request.filter_soft_deleted)
    out = fl.where(out, request.where, context(model))
    return _finish(model, out.orderBy("__ordinal"), request, PlanInfo("FetchByKey"), keep=("__ordinal",))


def _visible(df: DataFrame, hide: bool) -> DataFrame:
    return df.where(~F.col(HIDDEN)) if hide and HIDDEN in df.columns else df


def _scanned(model: Model, table: DataFrame, request: Scan) -> tuple[DataFrame, PlanInfo, list[tuple[Column, bool]]]:
    """Every record that a scan's pages hold from its place on, in no order; its access path; what orders it."""
    info = choose(model, request)
    _guard(model, request, info)
    cols = order_columns(model, request, info)
    seen = _visible(table, request.filter_soft_deleted)
    out = fl.where(seen, request.where, context(model, info))
    for c, _ in cols[: len(_index(model, info.index).parts)] if info.index else []:  # a record without all parts isn't in the index
        out = out.where(c.isNotNull())
    if request.cursor or request.start_key is not None:
        kinds = [f.dataType.simpleString() for f in table.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cols)]).schema]
        if request.cursor:
            out = out.where(_after(cols, decode_cursor(model, request, request.cursor), kinds, False))
        elif (place := _place(model, table, request, info, cols)) is not None:
            out = out.where(_after(cols, place, kinds, request.include_start))
    return out, info, cols


def aggregate_scan(model: Model, table: DataFrame, request: Scan) -> DataFrame:
    """A scan's aggregations over every record from its place on, as of all its pages together: the limit cuts nothing."""
    if not request.aggregations:
        raise RequestError("no aggregations")
    return aggregate(_scanned(model, table, request)[0], request.aggregations, model)


def fetch_scan(model: Model, table: DataFrame, request: Scan) -> Response:
    """A page of at most the request's limit; its aggregations see that page (aggregate_scan: all pages)."""
    out, info, cols = _scanned(model, table, request)
    page = out.orderBy(*[c.desc() if d else c.asc() for c, d in cols]).limit(request.limit)
    response = _finish(model, page, request, info)

    def after() -> str | None:
        got = page.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cols)]).collect()  # a page: at most MAX_LIMIT keys
        return encode_cursor(model, request, list(got[-1])) if len(got) == request.limit else None

    response._next = after
    return response


def _place(model: Model, table: DataFrame, request: Scan, info: PlanInfo, cols: list[tuple[Column, bool]]) -> list | None:
    """Where the start key's record lies in the order. In key order that is the key itself; in another it is looked up,
    and a record that isn't there bounds nothing."""
    if not info.index and not any(o.name for o in request.order):
        return list(request.start_key)
    own = reduce(lambda a, b: a & b, (F.col(f"`{p.ref}`") == _literal(v, table.schema[p.ref].dataType.simpleString()) for p, v in zip(model.key, request.start_key)))
    got = table.where(own).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cols)]).head(1)
    return list(got[0]) if got else None


def _finish(model: Model, page: DataFrame, request: Get | Scan, info: PlanInfo, keep: tuple[str, ...] = ()) -> Response:
    """Aggregations see the page before projection."""
    aggs = aggregate(page, request.aggregations, model) if request.aggregations else None
    meta = tuple(c for c in page.columns if c.startswith("_") and c not in keep)
    keys = tuple(k for k in model.key_columns() if request.select is not None and k not in {p if isinstance(p, str) else p.name for p in request.select})
    rows = page if request.select is None else project(page, request.select, (*keep, *keys, *meta))
    return Response(rows, info, aggs)


def scan_index_any(table: DataFrame, key: list[str], entries: Column, prefix: str | None = None, descending: bool = False, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """A scan of an index with several entries a record (list items, set values, map keys, tokens): each record once, at
    the first of its entries in the scan's direction, in that order."""
    if prefix is not None:
        entries = F.filter(entries, lambda x: x.startswith(prefix))
    out = table.withColumn("__entry", F.array_max(entries) if descending else F.array_min(entries)).where(F.col("__entry").isNotNull())
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    return out.orderBy(turn("__entry"), *[turn(k) for k in key]).limit(limit)


def collect(requests: list[tuple[str, Callable[[dict[str, Response]], Response]]]) -> dict[str, Response]:
    """A batch of named requests; each is made from the responses before it, whose rows it may inject (collect_inject).
    Responses are DataFrames, so nothing runs until one is read."""
    done: dict[str, Response] = {}
    for name, make in requests:
        if name in done:
            raise RequestError(f"{name} is collected twice")
        done[name] = make(done)
    return done


def collect_inject(first: DataFrame, value: Column, second: DataFrame, key: str) -> DataFrame:
    """A fetch from second by values (single or arrays) collected from a first result, each record once."""
    kind = first.select(value.alias("v")).schema["v"].dataType.typeName()
    wanted = first.select((F.explode(value) if kind == "array" else value).alias(key)).where(F.col(key).isNotNull()).distinct()
    return second.join(wanted, key, "left_semi")


def top_versions(changes: DataFrame, by: list[str], most: int) -> DataFrame:
    """The newest versions of each."""
    if not 1 <= most <= MAX_VERSIONS:
        raise RequestError(f"versions are 1 to {MAX_VERSIONS}")
    w = Window.partitionBy(*by).orderBy(F.col("_version").desc())
    return changes.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= most).drop("__rank")


def immutable_only(model: Model, f: fl.Filter | None, order: tuple[Order, ...] = ()) -> None:
    """Scans of changes can't filter or order by what may change."""
    names = {r.steps[0][1] for r in (f.refs() if f else [])} | {o.name for o in order if o.name}
    keys = set(model.key_columns())
    for n in sorted(names - keys):
        p = model.prop(n)
        if not (p.required and p.final):
            raise RequestError(f"{n} may change")


