"""Metrics and buckets over a page of rows, nested at will. No rows give no result row."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.refs import Ref, join_hops, ref
from ..functions.values import arithmetic, average_of, round_to, sum_of
from ..model import Model

Aggregations = dict[str, Any]
#: The number kind of a Spark type, where no model tells.
_KINDS = {"tinyint": "sint8", "smallint": "sint16", "int": "sint32", "bigint": "sint64", "float": "float32", "double": "float64"}


@dataclass(frozen=True)
class Kind:
    """A value's number kind (or what else it is), and a decimal's digits."""

    name: str
    precision: int = 38
    scale: int = 0


@dataclass(frozen=True)
class _On:
    """kind: the model's, unless given; without a model, that of the column's type."""

    ref: str | Ref
    kind: str | None = None

    def path(self) -> Ref:
        return self.ref if isinstance(self.ref, Ref) else ref(self.ref)

    def value(self) -> Column:
        return self.path().value()

    def known(self, df: DataFrame, model: Model | None) -> Kind:
        kind = df.select(self.value().alias("v")).schema["v"].dataType
        digits = (kind.precision, kind.scale) if isinstance(kind, T.DecimalType) else ()
        if self.kind:
            return Kind(self.kind, *digits)
        prop = _prop(model, self.path())
        if prop is not None:
            return Kind(prop.kind, *((prop.precision, prop.scale) if prop.kind == "decimal" else digits))
        return Kind("decimal", *digits) if digits else Kind(_KINDS.get(kind.simpleString(), kind.simpleString()))


def _prop(model: Model | None, path: Ref):
    """The property at the end of a path of fields, through embedded models."""
    prop = None
    for kind, name in path.steps:
        if model is None or kind != "field" or not any(name in (p.name, *p.names) for p in model.props):
            return None
        prop = model.prop(name)
        model = prop.model
    return prop


@dataclass(frozen=True)
class ValueCount(_On):
    """Non-null values."""

    def metric(self, kind: Kind):
        return F.count(self.value())


@dataclass(frozen=True)
class Sum(_On):
    def metric(self, kind: Kind):
        arithmetic(kind.name)
        return sum_of(self.value(), kind.name, kind.precision, kind.scale)


@dataclass(frozen=True)
class Average(_On):
    def metric(self, kind: Kind):
        arithmetic(kind.name)
        return average_of(self.value(), kind.name, kind.precision, kind.scale)


@dataclass(frozen=True)
class Min(_On):
    def metric(self, kind: Kind):
        return F.min(self.value())


@dataclass(frozen=True)
class Max(_On):
    def metric(self, kind: Kind):
        return F.max(self.value())


@dataclass(frozen=True)
class Stats(_On):
    def metric(self, kind: Kind):
        arithmetic(kind.name)
        v, k = self.value(), (kind.name, kind.precision, kind.scale)
        return F.struct(sum_of(v, *k).alias("sum"), average_of(v, *k).alias("average"), F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"))


@dataclass(frozen=True)
class _Bucket(_On):
    aggs: Aggregations = field(default_factory=dict)

    def key(self) -> Column:
        return self.value()


@dataclass(frozen=True)
class EnumValues(_Bucket):
    """By enum index (the column's order); nulls are skipped."""


@dataclass(frozen=True)
class Types(_Bucket):
    """By a union's tag."""

    def key(self):
        return self.path().type().value()


@dataclass(frozen=True)
class DateHistogram(_Bucket):
    unit: str = "days"

    def key(self):
        return round_to(self.value(), self.unit, self.kind if self.kind in ("date", "time") else "datetime")


def _refs(aggs: Aggregations) -> list[Ref]:
    return [r for a in aggs.values() for r in [a.path(), *(_refs(a.aggs) if isinstance(a, _Bucket) else [])]]


def aggregate(df: DataFrame, aggs: Aggregations, model: Model | None = None) -> DataFrame:
    """One row with a column per name (none for an empty page). Buckets are arrays of (key, count, nested...), by key."""
    df = join_hops(df, _refs(aggs))
    return _level(df, aggs, [], model).where("__n > 0").drop("__n")


def _level(df: DataFrame, aggs: Aggregations, groups: list[str], model: Model | None = None) -> DataFrame:
    metrics = [a.metric(a.known(df, model)).alias(n) for n, a in aggs.items() if not isinstance(a, _Bucket)]
    out = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"), *metrics)
    for n, a in aggs.items():
        if not isinstance(a, _Bucket):
            continue
        k = f"__k{len(groups)}"
        inner = _level(df.withColumn(k, a.key()).where(F.col(k).isNotNull()), a.aggs, [*groups, k], model)
        one = F.struct(F.col(k).alias("key"), F.col("__n").alias("count"), *[F.col(m) for m in a.aggs])
        lists = inner.groupBy(*groups).agg(F.sort_array(F.collect_list(one)).alias(n))
        if groups:
            renamed = lists.select(*[F.col(g).alias(f"{g}_r") for g in groups], n)
            cond = [F.col(g).eqNullSafe(F.col(f"{g}_r")) for g in groups]
            out = out.join(renamed, cond, "left").drop(*[f"{g}_r" for g in groups])
        else:
            out = out.withColumn("__one", F.lit(1)).join(lists.withColumn("__one", F.lit(1)), "__one", "left").drop("__one")
    return out


def bucket_rows(df: DataFrame, path: list[tuple[str, _Bucket]], model: Model | None = None) -> DataFrame:
    """The same buckets as flat rows: a column per key of a nesting path, count, and the innermost metrics."""
    df = join_hops(df, [a.path() for _, a in path] + _refs(path[-1][1].aggs))
    for name, a in path:
        df = df.withColumn(name, a.key())
    for name, _ in path:
        df = df.where(F.col(name).isNotNull())
    return df.groupBy(*[n for n, _ in path]).agg(F.count(F.lit(1)).alias("count"), *[m.metric(m.known(df, model)).alias(n) for n, m in path[-1][1].aggs.items()])
