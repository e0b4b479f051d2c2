"""Data models: typed properties with stable indexes, keys, secondary indexes, and their Spark schemas."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Number kinds with their width in bits (0: no integer), whether signed, and their Spark carriers.
NUMBERS: dict[str, tuple[int, bool, T.DataType]] = {
    "sint8": (8, True, T.ByteType()), "sint16": (16, True, T.ShortType()), "sint32": (32, True, T.IntegerType()), "sint64": (64, True, T.LongType()),
    "uint8": (8, False, T.ShortType()), "uint16": (16, False, T.IntegerType()), "uint32": (32, False, T.LongType()), "uint64": (64, False, T.DecimalType(20, 0)),
    "float32": (0, True, T.FloatType()), "float64": (0, True, T.DoubleType()),
}
SIMPLE: dict[str, T.DataType] = {
    "boolean": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampNTZType(), "enum": T.IntegerType(), "fixedbytes": T.BinaryType(),
    "flexbytes": T.BinaryType(), "reference": T.BinaryType(), "string": T.StringType(), "time": T.LongType(),
    "geopoint": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]),
}


class ModelError(ValueError):
    """A model, request or value that isn't valid."""


@dataclass(frozen=True)
class Prop:
    """One property. kind is a number kind, a simple kind, or decimal, embed, value, list, set, map, incmap, multi.

    A time and a nanosecond datetime are kept as a long of nanoseconds. A recursive embed stops at the depth that its
    nested model declares, as Spark has no recursive structs.
    """

    index: int
    name: str
    kind: str
    required: bool = True
    final: bool = False
    unique: bool = False
    default: Any = None
    min_value: Any = None
    max_value: Any = None
    min_size: int | None = None
    max_size: int | None = None
    regex: str | None = None
    names: tuple[str, ...] = ()
    item: Prop | None = None
    key: Prop | None = None
    model: Model | None = None
    cases: tuple[tuple[int, str, Prop], ...] = ()
    values: tuple[tuple[int, str], ...] = ()
    precision: int = 18
    scale: int = 2
    spark: T.DataType | None = None

    def type(self) -> T.DataType:
        if self.spark is not None:
            return self.spark
        if self.kind in NUMBERS:
            return NUMBERS[self.kind][2]
        if self.kind in SIMPLE:
            return SIMPLE[self.kind]
        if self.kind == "decimal":
            if self.precision > 38:
                raise ModelError(f"{self.name}: decimals hold at most 38 digits")
            return T.DecimalType(self.precision, self.scale)
        if self.kind in ("embed", "value"):
            return self.model.schema()
        if self.kind in ("list", "set"):
            return T.ArrayType(self.item.type())
        if self.kind in ("map", "incmap"):
            return T.MapType(self.key.type() if self.key else T.LongType(), self.item.type())
        if self.kind == "multi":
            return T.StructType([T.StructField("type", T.IntegerType())] + [T.StructField(f"v_{n}", p.type()) for _, n, p in self.cases])
        raise ModelError(f"{self.name}: no type {self.kind}")

    def problem(self, c: Column) -> Column:
        """Null, or what is wrong with a value."""
        bad: list[tuple[Column, str]] = []
        if self.required:
            bad.append((c.isNull(), "required"))
        if self.min_value is not None:
            bad.append((c < F.lit(self.min_value), "too small"))
        if self.max_value is not None:
            bad.append((c > F.lit(self.max_value), "too large"))
        size = F.size(c) if self.kind in ("list", "set", "map", "incmap") else F.length(c) if self.kind in ("string", "flexbytes", "fixedbytes") else None
        if size is not None and self.min_size is not None:
            bad.append((c.isNotNull() & (size < self.min_size), "too short"))
        if size is not None and self.max_size is not None:
            bad.append((c.isNotNull() & (size > self.max_size), "too long"))
        if self.regex:
            bad.append((~c.rlike(rf"\A(?:{self.regex})\z"), "pattern"))
        if self.values:
            bad.append((~c.isin([i for i, _ in self.values]), "unknown value"))
        if self.kind == "set":
            bad.append((F.size(F.array_distinct(c)) < F.size(c), "repeated"))
        return reduce(lambda acc, x: F.when(F.coalesce(x[0], F.lit(False)), F.lit(f"{self.name}: {x[1]}")).otherwise(acc), reversed(bad), F.lit(None).cast("string"))


@dataclass(frozen=True)
class Part:
    """A key or index part. transform: ref, reversed, to_max, normalize, geohash (option: bits), the several entries any,
    any_key, any_value and split (option: what it splits on), and for keys uuid4 and uuid7, which are made when absent."""

    ref: str
    transform: str = "ref"
    option: Any = None


@dataclass(frozen=True)
class Index:
    name: str
    parts: tuple[Part, ...]
    #: For named search: several text fields, split and normalised.
    search: bool = False


@dataclass(frozen=True)
class Model:
    name: str
    props: tuple[Prop, ...]
    key: tuple[Part, ...] = ()
    indexes: tuple[Index, ...] = ()
    version: str = "1.0"
    reserved_indexes: tuple[int, ...] = ()
    reserved_names: tuple[str, ...] = ()

    def __post_init__(self):
        seen, names = set(), set()
        for p in self.props:
            if p.index in seen or p.index in self.reserved_indexes:
                raise ModelError(f"{self.name}: index {p.index} is used or reserved")
            for n in (p.name, *p.names):
                if n in names or n in self.reserved_names:
                    raise ModelError(f"{self.name}: name {n} is used or reserved")
                names.add(n)
            seen.add(p.index)

    def prop(self, name: str) -> Prop:
        for p in self.props:
            if name == p.name or name in p.names:
                return p
        raise ModelError(f"{self.name} has no property {name}")

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(p.name, p.type(), True, {"index": p.index}) for p in self.props])

    def key_columns(self) -> list[str]:
        return [p.ref for p in self.key]

    def with_defaults(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        have = set(df.columns)
        cols = []
        for p in self.props:
            c = F.col(p.name) if p.name in have else F.lit(None)
            c = c.cast(p.type())
            cols.append((F.coalesce(c, F.lit(p.default).cast(p.type())) if p.default is not None else c).alias(p.name))
        return df.select(*cols, *keep)

    def problems(self) -> Column:
        """Null, or the first problem of a row."""
        return F.coalesce(*(p.problem(F.col(p.name)) for p in self.props))


#: Kinds of migration.
UP_TO_DATE, ONLY_SAFE_ADDS, NEW_INDEXES, NEEDS_MIGRATION = "UpToDate", "OnlySafeAdds", "NewIndexesOnExistingProperties", "NeedsMigration"


def compatibility(new: Model, old: Model) -> tuple[str, list[str]]:
    """How a stored model's data can be read by a new one, and the reasons against."""
    reasons = [] if new.name == old.name else ["other name"]
    if new.key != old.key:
        reasons.append("key changed")
    was, now = {p.index: p for p in old.props}, {p.index: p for p in new.props}
    for i, p in was.items():
        q = now.get(i)
        if q is None:
            if i not in new.reserved_indexes or p.name not in new.reserved_names:
                reasons.append(f"{p.name} is gone and not reserved")
            continue
        if q.type() != p.type():
            reasons.append(f"{p.name}: other type")
        if p.name not in (q.name, *q.names):
            reasons.append(f"{p.name}: renamed without keeping the old name")
        if q.required and not p.required or q.final and not p.final or q.unique and not p.unique:
            reasons.append(f"{p.name}: stricter")
        tighter = (q.min_value is not None and (p.min_value is None or q.min_value > p.min_value), q.max_value is not None and (p.max_value is None or q.max_value < p.max_value))
        sizes = ((q.min_size or 0) > (p.min_size or 0), q.max_size is not None and (p.max_size is None or q.max_size < p.max_size), q.regex not in (None, p.regex))
        if any(tighter) or any(sizes):
            reasons.append(f"{p.name}: narrower values")
    added = [p for i, p in now.items() if i not in was]
    reasons += [f"{p.name}: required without default" for p in added if p.required and p.default is None]
    if reasons:
        return NEEDS_MIGRATION, reasons
    fresh = [x for x in new.indexes if x not in old.indexes]
    if any(part.ref in {p.name for p in old.props} for x in fresh for part in x.parts):
        return NEW_INDEXES, []
    return (ONLY_SAFE_ADDS if added or fresh else UP_TO_DATE), []
