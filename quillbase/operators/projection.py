"""Projection by a graph of properties."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Pick:
    """A property, with what to keep of it: fields of an embedded value, one map key, or one case of a union."""

    name: str
    fields: tuple[Pick | str, ...] = ()
    map_key: object = None
    case: tuple[int, str] | None = None


def _build(c: Column, kind: T.DataType, p: Pick) -> Column:
    if p.map_key is not None:
        kept = F.map_filter(c, lambda k, v: k == F.lit(p.map_key))
        if p.fields and isinstance(kind, T.MapType):
            kept = F.transform_values(kept, lambda k, v: _struct(v, kind.valueType, p.fields))
        return F.when(F.size(kept) > 0, kept)
    if p.case is not None:
        tag, case = p.case
        field = f"v_{case}"
        inner = c.getField(field)
        if p.fields:
            inner = _struct(inner, kind[field].dataType, p.fields)
        return F.when(c.getField("type") == tag, F.struct(c.getField("type").alias("type"), inner.alias(field)))
    return _struct(c, kind, p.fields) if p.fields else c


def _struct(c: Column, kind: T.DataType, fields: tuple) -> Column:
    picks = [f if isinstance(f, Pick) else Pick(f) for f in fields]
    built = [_build(c.getField(p.name), kind[p.name].dataType, p).alias(p.name) for p in picks]
    return F.when(reduce(lambda a, b: a | b, [b.isNotNull() for b in built]), F.struct(*built))


def project(df: DataFrame, select: list[Pick | str] | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """select None: all. Empty: rows stay without values. Otherwise a row goes if nothing of what was picked is there.
    keep: columns beside (keys, versions) that don't count."""
    if select is None:
        values = [c for c in df.columns if c not in keep]
        return df.where(reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in values])) if values else df
    picks = [p if isinstance(p, Pick) else Pick(p) for p in select]
    out = df.select(*keep, *[_build(F.col(f"`{p.name}`"), df.schema[p.name].dataType, p).alias(p.name) for p in picks])
    return out.where(reduce(lambda a, b: a | b, [F.col(f"`{p.name}`").isNotNull() for p in picks])) if picks else out
