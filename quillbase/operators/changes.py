"""Change operators: each turns a record's columns into changed ones, as expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Columns = dict[str, Column]


def _set(c: Column, path: list[str], value: Column) -> Column:
    return value if not path else c.withField(path[0], _set(c.getField(path[0]), path[1:], value))


@dataclass(frozen=True)
class Change:
    """Sets properties; None unsets."""

    values: tuple[tuple[str, Any], ...]

    def apply(self, cols: Columns, schema: T.StructType) -> Columns:
        out = dict(cols)
        for name, v in self.values:
            top, *path = name.split(".")
            kind = schema[top].dataType
            for p in path:
                kind = kind[p].dataType
            out[top] = _set(out[top], path, F.lit(v).cast(kind))
        return out


@dataclass(frozen=True)
class Check:
    """The record's values must be these, or none of its changes is applied."""

    values: tuple[tuple[str, Any], ...]

    def passes(self, cols: Columns) -> Column:
        return reduce(lambda a, b: a & b, [cols[n].eqNullSafe(F.lit(v)) for n, v in self.values], F.lit(True))

    def apply(self, cols: Columns, schema: T.StructType) -> Columns:
        return cols


@dataclass(frozen=True)
class ListChange:
    """Deletes the first occurrence of each value, then inserts at 0-based places, then appends."""

    name: str
    delete: tuple = ()
    insert: tuple[tuple[int, Any], ...] = ()
    append: tuple = ()

    def apply(self, cols: Columns, schema: T.StructType) -> Columns:
        kind = schema[self.name].dataType
        c = F.coalesce(cols[self.name], F.array().cast(kind))
        for v in self.delete:
            at = F.array_position(c, F.lit(v).cast(kind.elementType))
            c = F.when(at > 0, F.concat(F.slice(c, F.lit(1), (at - 1).cast("int")), F.slice(c, (at + 1).cast("int"), F.size(c)))).otherwise(c)
        for i, v in self.insert:
            c = F.concat(F.slice(c, 1, i), F.array(F.lit(v).cast(kind.elementType)), F.slice(c, F.lit(i + 1), F.size(c))) if i else F.concat(F.array(F.lit(v).cast(kind.elementType)), c)
        if self.append:
            c = F.concat(c, F.array(*[F.lit(v).cast(kind.elementType) for v in self.append]))
        return cols | {self.name: c}


@dataclass(frozen=True)
class SetChange:
    """Adds values."""

    name: str
    add: tuple = ()

    def apply(self, cols: Columns, schema: T.StructType) -> Columns:
        kind = schema[self.name].dataType
        more = F.array(*[F.lit(v) for v in self.add]).cast(kind)
        return cols | {self.name: F.array_union(F.coalesce(cols[self.name], F.array().cast(kind)), more)}


@dataclass(frozen=True)
class IncMapChange:
    """Appends values under the next keys."""

    name: str
    add: tuple = ()

    def apply(self, cols: Columns, schema: T.StructType) -> Columns:
        kind = schema[self.name].dataType
        c = F.coalesce(cols[self.name], F.create_map().cast(kind))
        top = F.coalesce(F.array_max(F.map_keys(c)), F.lit(0).cast(kind.keyType))
        pairs = [x for i, v in enumerate(self.add) for x in ((top + F.lit(i + 1)).cast(kind.keyType), F.lit(v).cast(kind.valueType))]
        return cols | {self.name: F.map_concat(c, F.create_map(*pairs)) if pairs else c}

    def keys(self, cols: Columns, schema: T.StructType) -> Column:
        """The keys that the added values got."""
        top = F.coalesce(F.array_max(F.map_keys(cols[self.name])), F.lit(0))
        return F.sequence(top + 1, top + len(self.add))


def apply_all(changes: tuple, cols: Columns, schema: T.StructType) -> tuple[Columns, Column]:
    """The changed columns, and whether all checks pass (against the values before)."""
    ok = reduce(lambda a, b: a & b, [c.passes(cols) for c in changes if isinstance(c, Check)], F.lit(True))
    out = cols
    for c in changes:
        out = c.apply(out, schema)
    return out, ok


