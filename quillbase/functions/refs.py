"""Property references: paths into structs, lists, sets, maps and unions, and hops over foreign keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Predicate = Callable[[Column], Column]


@dataclass(frozen=True)
class Hop:
    """A foreign key into another table: its frame and that frame's key column."""

    name: str
    table: DataFrame
    key: str


@dataclass(frozen=True)
class Ref:
    """A path. Steps: field, item, any, set_item, key, has_key, any_key, any_value, type, typed, hop."""

    steps: tuple[tuple[str, Any], ...]

    def _add(self, kind: str, value: Any = None) -> Ref:
        return Ref((*self.steps, (kind, value)))

    def field(self, name: str) -> Ref:
        return self._add("field", name)

    def item(self, i: int) -> Ref:
        return self._add("item", i)

    def any(self) -> Ref:
        return self._add("any")

    def set_item(self, value: Any) -> Ref:
        return self._add("set_item", value)

    def key(self, k: Any) -> Ref:
        return self._add("key", k)

    def has_key(self, k: Any) -> Ref:
        return self._add("has_key", k)

    def any_key(self) -> Ref:
        return self._add("any_key")

    def any_value(self) -> Ref:
        return self._add("any_value")

    def type(self) -> Ref:
        return self._add("type")

    def typed(self, tag: int, case: str) -> Ref:
        return self._add("typed", (tag, case))

    def hop(self, name: str, table: DataFrame, key: str) -> Ref:
        """Follows this (single) value as a foreign key."""
        return self._add("hop", Hop(name, table, key))

    def hops(self) -> list[tuple[Ref, Hop]]:
        return [(Ref(self.steps[:i]), v) for i, (k, v) in enumerate(self.steps) if k == "hop"]

    def test(self, predicate: Predicate) -> Column:
        """Two-valued: whether the value (or any of those that "any" steps reach) passes. Nulls never do."""
        at = max([i + 1 for i, (k, _) in enumerate(self.steps) if k == "hop"], default=0)
        if at:
            base = F.col(f"`__{self.steps[at - 1][1].name}`")
        else:
            base, at = F.col(f"`{self.steps[0][1]}`"), 1
        return F.coalesce(_walk(base, self.steps[at:], predicate), F.lit(False))

    def value(self) -> Column:
        """The single value; not for paths with "any"."""
        out: list[Column] = []
        self.test(lambda c: out.append(c) or c.isNotNull())
        return out[0]


def ref(path: str) -> Ref:
    """A path of struct fields."""
    return Ref(tuple(("field", p) for p in path.split(".")))


def _walk(c: Column, steps: tuple, predicate: Predicate) -> Column:
    if not steps:
        return predicate(c)
    (kind, v), rest = steps[0], steps[1:]
    inner = lambda x: F.coalesce(_walk(x, rest, predicate), F.lit(False))
    if kind == "field":
        return _walk(c.getField(v), rest, predicate)
    if kind == "item":
        return _walk(F.get(c, F.lit(v)), rest, predicate)
    if kind == "set_item":
        return _walk(F.when(F.array_contains(c, v), F.lit(v)), rest, predicate)
    if kind == "key":
        return _walk(F.try_element_at(c, F.lit(v)), rest, predicate)
    if kind == "has_key":
        return _walk(F.when(F.map_contains_key(c, v), F.lit(v)), rest, predicate)
    if kind == "any":
        return F.exists(c, inner)
    if kind == "any_key":
        return F.exists(F.map_keys(c), inner)
    if kind == "any_value":
        return F.exists(F.map_values(c), inner)
    if kind == "type":
        return _walk(c.getField("type"), rest, predicate)
    if kind == "typed":
        return _walk(F.when(c.getField("type") == v[0], c.getField(f"v_{v[1]}")), rest, predicate)
    raise ValueError(kind)


def join_hops(df: DataFrame, refs: list[Ref]) -> DataFrame:
    """df with each hop's record as a struct column; a null or dangling key gives null. The target's key is unique.

    A left join, as the test may stand under Or or Not; Catalyst broadcasts a small target and prunes its columns.
    """
    done: set[str] = set()
    for r in refs:
        for before, hop in r.hops():
            if hop.name in done:
                continue
            done.add(hop.name)
            target = hop.table.select(F.struct(*[F.col(c) for c in hop.table.columns]).alias(f"__{hop.name}"))
            df = df.join(target, before.value() == F.col(f"`__{hop.name}`").getField(hop.key), "left")
    return df


def comparable(c: Column, kind: T.DataType) -> Column:
    """A value that = can compare, as maps can't be: a map by its entries, what holds maps by its JSON."""
    if "map<" not in kind.simpleString():
        return c
    if isinstance(kind, T.MapType) and "map<" not in kind.valueType.simpleString():
        return F.sort_array(F.map_entries(c))
    return F.to_json(c)
