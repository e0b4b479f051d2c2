"""Reads over a changelog: (key columns, _version, _op, value columns), a row per write with the whole record.

_op is add, change, soft_delete or hard_delete. Versions of a key are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.refs import comparable
from .requests import top_versions

ADD, CHANGE, SOFT, HARD = "add", "change", "soft_delete", "hard_delete"


def as_of(log: DataFrame, key: list[str], to_version: int | None = None) -> DataFrame:
    """The current (or an earlier) state: value columns, _first_version, _last_version, _is_deleted. One aggregation
    with map-side combining; a record that was erased or not yet there has no row."""
    if to_version is not None:
        log = log.where(F.col("_version") <= to_version)
    values = [c for c in log.columns if c not in (*key, "_version", "_op")]
    latest = log.groupBy(*key).agg(
        F.max_by(F.struct("_op", "_version", *values), "_version").alias("x"),
        F.max(F.when(F.col("_op") == ADD, F.col("_version"))).alias("_first_version"),
    )
    return latest.where(F.col("x._op") != HARD).select(*key, *[F.col("x").getField(v).alias(v) for v in values], "_first_version", F.col("x._version").alias("_last_version"), (F.col("x._op") == SOFT).alias("_is_deleted"))


def _with_previous(log: DataFrame, key: list[str]) -> tuple[DataFrame, list[str]]:
    values = [c for c in log.columns if c not in (*key, "_version", "_op")]
    w = Window.partitionBy(*key).orderBy("_version")
    return log.withColumn("__before", F.lag(F.struct("_op", *values)).over(w)), values


def _same(d: DataFrame, name: str) -> Column:
    kind = d.schema[name].dataType
    return comparable(F.col(f"`{name}`"), kind).eqNullSafe(comparable(F.col("__before").getField(name), kind))


def cell_changes(log: DataFrame, key: list[str], from_version: int = 0, to_version: int | None = None, max_versions: int = 1) -> DataFrame:
    """(key, path, _version, value): each property's newest versions, by comparing successive records; values as JSON."""
    if to_version is not None:
        log = log.where(F.col("_version") <= to_version)
    d, values = _with_previous(log, key)
    alive = F.col("_op").isin(ADD, CHANGE)
    fresh = (F.col("_op") == ADD) | F.col("__before").isNull()
    cells = [F.when(alive & F.when(fresh, F.col(f"`{v}`").isNotNull()).otherwise(~_same(d, v)), F.struct(F.lit(v).alias("path"), F.to_json(F.struct(F.col(f"`{v}`").alias("v"))).alias("value"))) for v in values]
    out = d.select(*key, "_version", F.explode(F.array_compact(F.array(*cells))).alias("c")).select(*key, "_version", "c.path", "c.value")
    return top_versions(out.where(F.col("_version") >= from_version), [*key, "path"], max_versions)


def versioned_changes(log: DataFrame, key: list[str], from_version: int = 0, to_version: int | None = None, max_versions: int = 1) -> DataFrame:
    """(key, changes): per key its versions with what changed in each, oldest first."""
    cells = cell_changes(log, key, from_version, to_version, max_versions)
    per = cells.groupBy(*key, "_version").agg(F.sort_array(F.collect_list(F.struct("path", "value"))).alias("changes"))
    return per.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_version", "changes"))).alias("versions"))


def updates(log: DataFrame, key: list[str], from_version: int = 0, to_version: int | None = None, max_versions: int = 1) -> DataFrame:
    """(key, _version, kind, reason, changed): Addition, Change or Removal, in version order. The creation of a key is
    kept and its other newest versions are limited."""
    if to_version is not None:
        log = log.where(F.col("_version") <= to_version)
    d, values = _with_previous(log, key)
    diff = [F.when(~_same(d, v), F.lit(v)) for v in values]
    kind = F.when(F.col("_op") == ADD, "Addition").when(F.col("_op") == CHANGE, "Change").otherwise("Removal")
    reason = F.when(F.col("_op") == SOFT, "SoftDelete").when(F.col("_op") == HARD, "HardDelete")
    d = d.where(F.col("_version") >= from_version).select(*key, "_version", kind.alias("kind"), reason.alias("reason"), F.when(F.col("_op") == CHANGE, F.array_compact(F.array(*diff))).alias("changed"))
    w = Window.partitionBy(*key, F.col("kind") == "Addition").orderBy(F.col("_version").desc())
    ranked = d.withColumn("__rank", F.row_number().over(w))
    return ranked.where((F.col("kind") == "Addition") | (F.col("__rank") <= max_versions)).drop("__rank").orderBy("_version", *key)


def update_history(log: DataFrame, limit: int = 100, from_version: int = 0, to_version: int | None = None, key: list[str] | None = None) -> DataFrame:
    """Every write, newest first."""
    out = log.where(F.col("_version") >= from_version)
    if to_version is not None:
        out = out.where(F.col("_version") <= to_version)
    keys = key or [c for c in log.columns if not c.startswith("_")][:1]
    return out.orderBy(F.col("_version").desc(), *keys).limit(limit)


def ordered_keys_diff(now: DataFrame, log: DataFrame, known: DataFrame, key: str | list[str]) -> DataFrame:
    """(key columns, kind, reason): what a client that knows these keys must remove (SoftDelete, HardDelete, NotInRange) or
    add. Two anti joins and a lookup of the removed keys' last writes."""
    key = [key] if isinstance(key, str) else key
    gone = known.select(*key).join(now.select(*key), key, "left_anti")
    state = log.join(gone, key, "left_semi").groupBy(*key).agg(F.max_by("_op", "_version").alias("op"))
    reason = F.when(F.col("op") == SOFT, "SoftDelete").when((F.col("op") == HARD) | F.col("op").isNull(), "HardDelete").otherwise("NotInRange")
    new = now.select(*key).join(known.select(*key), key, "left_anti")
    removed = gone.join(state, key, "left").select(*key, F.lit("Removal").alias("kind"), reason.alias("reason"))
    return removed.union(new.select(*key, F.lit("Addition"), F.lit(None).cast("string")))


def type_changes(log: DataFrame, key: list[str], union: str) -> DataFrame:
    """(key, _version, type): writes by which a union got another tag."""
    d, _ = _with_previous(log, key)
    tag = F.col(f"`{union}`").getField("type")
    before = F.col("__before").getField(union).getField("type")
    return d.where(F.col("_op").isin(ADD, CHANGE) & tag.isNotNull() & ~tag.eqNullSafe(before)).select(*key, "_version", tag.alias("type"))


def index_changes(log: DataFrame, key: list[str], parts: list[Column]) -> DataFrame:
    """(key, _version, kind, entry, previous): writes by which a record's entry in an index came, moved or went (New,
    Update, Delete); parts give the entry of a row, and a record with an absent part has none."""
    alive = F.col("_op").isin(ADD, CHANGE)
    whole = parts[0].isNotNull()
    for p in parts[1:]:
        whole = whole & p.isNotNull()
    entry = F.when(alive & whole, F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])))
    d = log.select(*key, "_version", entry.alias("entry"))
    d = d.withColumn("previous", F.lag("entry").over(Window.partitionBy(*key).orderBy("_version"))).where(~F.col("entry").eqNullSafe(F.col("previous")))
    kind = F.when(F.col("previous").isNull(), "New").when(F.col("entry").isNull(), "Delete").otherwise("Update")
    return d.select(*key, "_version", kind.alias("kind"), "entry", "previous")
