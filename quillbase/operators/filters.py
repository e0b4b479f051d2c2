"""The nineteen filters. Each compiles to one two-valued column: a null value fails its leaf, so Not keeps it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.refs import Ref, join_hops, ref
from ..model import ModelError

MAX_NESTING = 64


@dataclass(frozen=True)
class Search:
    """A named search surface over text fields."""

    fields: tuple[str, ...]
    on: str = text.WORD_BOUNDARY
    normalized: bool = True

    def any(self, test: Callable[[Column], Column]) -> Column:
        """A test of the surface, which is made once for a row."""
        return F.exists(F.array(text.surface(*(F.col(f) for f in self.fields), on=self.on, normalized=self.normalized)), test)


@dataclass(frozen=True)
class Context:
    """What a filter is compiled against. transforms: of the references that the scanned index holds, put on what is
    compared with them; transform and literal: those of one reference."""

    searches: dict[str, Search] = field(default_factory=dict)
    transforms: dict[str, tuple[Callable[[Column], Column], Callable[[str], str]]] = field(default_factory=dict)
    transform: Callable[[Column], Column] | None = None
    literal: Callable[[str], str] | None = None

    def of(self, r: Ref) -> Context:
        """The context of one reference."""
        own = self.transforms.get(r.steps[0][1]) if len(r.steps) == 1 else None
        return replace(self, transform=own[0], literal=own[1]) if own else self

    def left(self, c: Column, value: Any) -> Column:
        return self.transform(c) if self.transform and isinstance(value, str) else c

    def right(self, value: Any) -> Column:
        return F.lit(self.literal(value) if self.literal and isinstance(value, str) else value)


def _ref(r: str | Ref) -> Ref:
    return r if isinstance(r, Ref) else ref(r)


def _begins(prefix: str) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(x.startswith(prefix), F.lit(False))


class Filter:
    def compile(self, ctx: Context) -> Column:
        raise NotImplementedError

    def children(self) -> tuple[Filter, ...]:
        return ()

    def refs(self) -> list[Ref]:
        return [r for c in self.children() for r in c.refs()]

    def depth(self) -> int:
        return 1 + max((c.depth() for c in self.children()), default=-1) if self.children() else 0


class _Many(Filter):
    def __init__(self, *filters: Filter):
        self.filters = filters

    def children(self):
        return self.filters


class And(_Many):
    """All; true if empty."""

    def compile(self, ctx):
        return reduce(lambda a, b: a & b, (f.compile(ctx) for f in self.filters), F.lit(True))


class Or(_Many):
    """Any; false if empty."""

    def compile(self, ctx):
        return reduce(lambda a, b: a | b, (f.compile(ctx) for f in self.filters), F.lit(False))


class Not(_Many):
    """None of them."""

    def compile(self, ctx):
        return ~Or(*self.filters).compile(ctx)


class Exists(Filter):
    def __init__(self, *refs: str | Ref):
        self._refs = [_ref(r) for r in refs]

    def refs(self):
        return self._refs

    def compile(self, ctx):
        return reduce(lambda a, b: a & b, (r.test(lambda c: c.isNotNull()) for r in self._refs), F.lit(True))


class _Pairs(Filter):
    """All (reference, operand) pairs must pass."""

    def __init__(self, *pairs: tuple[str | Ref, Any], **named: Any):
        self.pairs = [(_ref(r), v) for r, v in (*pairs, *named.items())]

    def refs(self):
        return [r for r, _ in self.pairs]

    def leaf(self, c: Column, v: Any, ctx: Context) -> Column:
        raise NotImplementedError

    def compile(self, ctx):
        return reduce(lambda a, b: a & b, (r.test(lambda c, r=r, v=v: self.leaf(c, v, ctx.of(r))) for r, v in self.pairs), F.lit(True))


class Equals(_Pairs):
    """Lists, sets and maps: all that is expected is there."""

    def leaf(self, c, v, ctx):
        if isinstance(v, dict):
            return reduce(lambda a, b: a & b, (F.coalesce(F.try_element_at(c, F.lit(k)) == F.lit(x), F.lit(False)) for k, x in v.items()), c.isNotNull())
        if isinstance(v, (list, tuple, set, frozenset)):
            return reduce(lambda a, b: a & b, (F.array_contains(c, F.lit(x)) for x in v), c.isNotNull())
        return ctx.left(c, v) == ctx.right(v)


class LessThan(_Pairs):
    def leaf(self, c, v, ctx):
        return ctx.left(c, v) < ctx.right(v)


class LessThanEquals(_Pairs):
    def leaf(self, c, v, ctx):
        return ctx.left(c, v) <= ctx.right(v)


class GreaterThan(_Pairs):
    def leaf(self, c, v, ctx):
        return ctx.left(c, v) > ctx.right(v)


class GreaterThanEquals(_Pairs):
    def leaf(self, c, v, ctx):
        return ctx.left(c, v) >= ctx.right(v)


class Prefix(_Pairs):
    """Collections given: every prefix begins some element."""

    def leaf(self, c, v, ctx):
        if isinstance(v, (list, tuple, set)):
            return reduce(lambda a, b: a & b, (F.exists(c, _begins(p)) for p in v), c.isNotNull())
        return ctx.left(c, v).startswith(ctx.right(v))


@dataclass(frozen=True)
class Between:
    low: Any = None
    high: Any = None
    include_low: bool = True
    include_high: bool = True


class Range(_Pairs):
    def leaf(self, c, v, ctx):
        r = v if isinstance(v, Between) else Between(*v)
        out = c.isNotNull()
        if r.low is not None:
            out &= (ctx.left(c, r.low) >= ctx.right(r.low)) if r.include_low else (ctx.left(c, r.low) > ctx.right(r.low))
        if r.high is not None:
            out &= (ctx.left(c, r.high) <= ctx.right(r.high)) if r.include_high else (ctx.left(c, r.high) < ctx.right(r.high))
        return out


class RegEx(_Pairs):
    """The whole value matches."""

    def leaf(self, c, v, ctx):
        return ctx.left(c, v).rlike(rf"\A(?:{v})\z")


class ValueIn(_Pairs):
    def leaf(self, c, v, ctx):
        values = list(v)
        if not values:
            return F.lit(False)
        return ctx.left(c, values[0]).isin([ctx.literal(x) if ctx.literal and isinstance(x, str) else x for x in values])


class _Named(Filter):
    """Over a named search; an unknown name or a query without terms matches nothing."""

    def __init__(self, **named: str):
        self.named = named

    def refs(self):
        return []

    def one(self, s: Search, q: str) -> Column:
        raise NotImplementedError

    def compile(self, ctx):
        return reduce(lambda a, b: a & b, (F.coalesce(self.one(ctx.searches[n], q), F.lit(False)) if n in ctx.searches else F.lit(False) for n, q in self.named.items()), F.lit(True))


class Matches(_Named):
    """Every term is a token."""

    def one(self, s, q):
        terms = text.query_terms(q, s.on, s.normalized)
        return s.any(lambda x: reduce(lambda a, b: a & b, (x.contains(text.SEPARATOR + t + text.SEPARATOR) for t in terms))) if terms else F.lit(False)


class MatchesPrefix(_Named):
    """Every term begins a token."""

    def one(self, s, q):
        terms = text.query_terms(q, s.on, s.normalized)
        return s.any(lambda x: reduce(lambda a, b: a & b, (x.contains(text.SEPARATOR + t) for t in terms))) if terms else F.lit(False)


class MatchesRegEx(_Named):
    """Some whole token matches."""

    def one(self, s, q):
        return s.any(lambda x: F.exists(F.split(x, text.SEPARATOR), lambda t: (t != "") & t.rlike(rf"\A(?:{q})\z")))


class _Geo(Filter):
    def __init__(self, point: str | Ref, *args: Any):
        self.point, self.args = _ref(point), args

    def refs(self):
        return [self.point]

    def compile(self, ctx):
        return self.point.test(lambda c: self.shape(c.getField("lat"), c.getField("lon"), *self.args))


class GeoWithinBox(_Geo):
    """(south, west, north, east)."""

    shape = staticmethod(geo.within_box)


class GeoWithinRadius(_Geo):
    """(lat, lon, metres)."""

    shape = staticmethod(geo.within_radius)


class GeoWithinPolygon(_Geo):
    """A list of (lat, lon) corners."""

    shape = staticmethod(geo.within_polygon)


#: The closed list of filters.
KINDS = (And, Or, Not, Exists, Equals, LessThan, LessThanEquals, GreaterThan, GreaterThanEquals, Prefix, Range, RegEx, ValueIn, Matches, MatchesPrefix, MatchesRegEx, GeoWithinBox, GeoWithinRadius, GeoWithinPolygon)


def _sargable(f: Filter, ctx: Context) -> Column | None:
    """Comparisons of columns and struct fields, with And and Or over them, without the null guard, so that scans can
    push them down: where no Not stands above, what is null fails as false does."""
    if isinstance(f, (And, Or)):
        parts = [_sargable(x, ctx) for x in f.filters]
        if not parts or any(p is None for p in parts):
            return None
        return reduce(lambda a, b: a & b if isinstance(f, And) else a | b, parts)
    if isinstance(f, _Pairs) and f.pairs and all(k == "field" for r in f.refs() for k, _ in r.steps) and not any(r.steps[0][1] in ctx.transforms for r in f.refs()):
        return reduce(lambda a, b: a & b, (f.leaf(F.col(".".join(f"`{v}`" for _, v in r.steps)), v, ctx) for r, v in f.pairs))
    return None


def where(df: DataFrame, f: Filter | None, ctx: Context | None = None) -> DataFrame:
    """The rows that match, with df's columns."""
    if f is None:
        return df
    if f.depth() > MAX_NESTING:
        raise ModelError(f"filters nest deeper than {MAX_NESTING}")
    ctx = ctx or Context()
    names = df.columns
    conjuncts = list(f.filters) if isinstance(f, And) else [f]
    flat = []
    while conjuncts:
        c = conjuncts.pop(0)
        conjuncts = [*c.filters, *conjuncts] if isinstance(c, And) else conjuncts
        if not isinstance(c, And):
            flat.append(c)
    joined = join_hops(df, f.refs())
    for c in flat:
        plain = _sargable(c, ctx)
        joined = joined.where(plain if plain is not None else c.compile(ctx))
    return joined.select(*[F.col(f"`{n}`") for n in names])


