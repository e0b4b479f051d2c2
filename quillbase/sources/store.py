"""A versioned store of one model: an append-only changelog as Parquet, written by batches with one version each."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.refs import comparable
from ..functions.values import Clock, uuid_v4, uuid_v7
from ..model import Model
from ..operators import filters
from ..operators.changes import IncMapChange, apply_all
from ..operators.projection import project
from ..plans import history, requests

#: Statuses of writes.
ADDED, CHANGED, DELETED, EXISTS, MISSING, INVALID, STALE = "AddSuccess", "ChangeSuccess", "DeleteSuccess", "AlreadyExists", "DoesNotExist", "ValidationFail", "VersionMismatch"


class Store:
    """keep_all_versions is what time travel and histories need.

    Rows are independent: a batch may succeed in part, and each row gets a status, in the batch's order. Writes append
    files; a version is written at once, so a rerun of a failed write appends nothing twice (the Parquet committer moves
    files at the end). What a write decided is a table beside the log, which its statuses read; clean() removes those.
    """

    def __init__(self, spark: SparkSession, path: str, model: Model, keep_all_versions: bool = True):
        self.spark, self.path, self.model, self.keep = spark, path.rstrip("/"), model, keep_all_versions
        self.key = model.key_columns()
        self.clock = Clock()

    def schema(self) -> T.StructType:
        return T.StructType([*self.model.schema().fields, T.StructField("_version", T.LongType()), T.StructField("_op", T.StringType())])

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema()).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], self.schema())
            raise

    def _write(self, rows: DataFrame) -> None:
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema().fields]).write.mode("append").parquet(self.path)

    def _staged(self, rows: DataFrame) -> DataFrame:
        path = f"{self.path}_staging/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def clean(self) -> None:
        """Removes the tables of decided writes; their statuses can't be read afterwards."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}_staging")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def snapshot(self, to_version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The records, or those of some keys: only these keys' rows of the log are aggregated then. A filter on key columns
        goes below the aggregation by itself."""
        if to_version is not None and not self.keep:
            raise requests.RequestError("earlier versions need keep_all_versions")
        log = self.log() if keys is None else self.log().join(keys, self.key, "left_semi")
        return history.as_of(log, self.key, to_version)

    # reads

    def get(self, request: requests.Get) -> requests.Response:
        keys = self._keys(list(request.keys)).distinct()
        return requests.fetch_get(self.model, self.snapshot(request.to_version, F.broadcast(keys) if len(request.keys) <= 10_000 else keys), request)

    def scan(self, request: requests.Scan) -> requests.Response:
        return requests.fetch_scan(self.model, self.snapshot(request.to_version), request)

    def _keys(self, keys: list) -> DataFrame:
        rows = [k if isinstance(k, tuple) else (k,) for k in keys]
        return self.spark.createDataFrame(rows, T.StructType([T.StructField(n, self.model.prop(n).type()) for n in self.key]))

    def get_changes(self, keys: list, from_version: int = 0, to_version: int | None = None, max_versions: int = 1) -> DataFrame:
        self._history()
        return history.versioned_changes(self.log().join(self._keys(keys), self.key, "left_semi"), self.key, from_version, to_version, max_versions)

    def scan_changes(self, request: requests.Scan, from_version: int = 0, max_versions: int = 1) -> DataFrame:
        """As versioned changes of the page's keys, in the page's order (_place)."""
        self._history()
        requests.immutable_only(self.model, request.where, request.order)
        page = self._placed(self.scan(request).rows)
        out = history.versioned_changes(self.log().join(F.broadcast(page), self.key, "left_semi"), self.key, from_version, request.to_version, max_versions)
        return out.join(F.broadcast(page), self.key).orderBy("_place")

    def _placed(self, page: DataFrame) -> DataFrame:
        """The keys of a page, which a request's limit bounds, with their places."""
        keys = [tuple(r) for r in page.select(*self.key).collect()]
        return self.spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], T.StructType([*[T.StructField(n, self.model.prop(n).type()) for n in self.key], T.StructField("_place", T.IntegerType())]))

    def get_updates(self, keys: list, from_version: int = 0, to_version: int | None = None, max_versions: int = 1) -> DataFrame:
        self._history()
        return history.updates(self.log().join(self._keys(keys), self.key, "left_semi"), self.key, from_version, to_version, max_versions)

    def scan_updates(self, request: requests.Scan, from_version: int = 0, max_versions: int = 1, ordered_keys: list | None = None, recent_first: bool = False) -> tuple[DataFrame, DataFrame]:
        """The page's ordered keys, and its updates (with what a client that knows ordered_keys must add or remove). With
        recent_first, a request without order and start takes the keys that changed last."""
        self._history()
        requests.immutable_only(self.model, None, request.order)
        if recent_first:
            if request.order or request.start_key is not None or request.cursor:
                raise requests.RequestError("most recent keys come in that order from the start")
            table = requests._visible(self.snapshot(request.to_version), request.filter_soft_deleted)
            page = filters.where(table, request.where, requests.context(self.model)).orderBy(F.col("_last_version").desc(), *self.key).limit(request.limit)
        else:
            page = self.scan(replace(request, select=None)).rows
        keys = self._placed(page)
        log = self.log()
        out = history.updates(log.join(F.broadcast(keys), self.key, "left_semi"), self.key, from_version, request.to_version, max_versions)
        if ordered_keys is not None:
            diff = history.ordered_keys_diff(keys, log, self._keys(ordered_keys), self.key)
            out = out.unionByName(diff.select(*self.key, F.lit(None).cast("long").alias("_version"), "kind", "reason", F.lit(None).cast("array<string>").alias("changed")))
        return keys.orderBy("_place").select(*self.key), out

    def scan_update_history(self, limit: int = 100, from_version: int = 0, to_version: int | None = None, where: filters.Filter | None = None, select: list | None = None, filter_soft_deleted: bool = True) -> DataFrame:
        """Every write, newest first. The filter is asked of the record as the write left it (erased it, for hard
        deletes); writes that left it soft-deleted are hidden unless asked for."""
        self._history()
        log = self.log()
        if filter_soft_deleted:
            log = log.where(F.col("_op") != history.SOFT)
        log = filters.where(log, where, requests.context(self.model))
        out = history.update_history(log, limit, from_version, to_version, self.key)
        return out if select is None else project(out, select, (*self.key, "_version", "_op"))

    def _history(self) -> None:
        if not self.keep:
            raise requests.RequestError("histories need keep_all_versions")

    # writes

    def add(self, rows: DataFrame) -> DataFrame:
        """(key, status, problem), in the rows' order. Existing keys and taken unique values fail, and invalid rows; of
        equal keys or unique values in a batch the first row that may be added takes them, as if rows came one by one.
        Absent parts of generated keys are made."""
        version = self.clock.next()
        uniques = [p.name for p in self.model.props if p.unique]
        rows = rows.withColumn("__row", F.monotonically_increasing_id())
        new = self.model.with_defaults(rows, ("__row",))
        seed = F.concat(F.lit(uuid.uuid4().hex), F.col("__row"))
        for p in self.model.key:
            if p.transform in ("uuid4", "uuid7"):
                made = uuid_v4(seed) if p.transform == "uuid4" else uuid_v7(version, seed)
                new = new.withColumn(p.ref, F.coalesce(F.col(p.ref), made))
        now = self.snapshot()
        new = new.withColumn("__why", self.model.problems()).join(now.select(*self.key, F.lit(True).alias("__have")), self.key, "left")
        taken = F.lit(None).cast("string")
        for u in uniques:
            used = now.where(~F.col("_is_deleted") & F.col(u).isNotNull()).select(F.col(u).alias(f"__u_{u}"), F.lit(True).alias(f"__t_{u}"))
            new = new.join(used, F.col(u) == F.col(f"__u_{u}"), "left")
            taken = F.coalesce(taken, F.when(F.col(f"__t_{u}"), F.lit(f"{u}: already exists")))
        why = F.coalesce(F.col("__why"), taken)
        status = F.when(F.col("__have"), EXISTS).when(why.isNotNull(), INVALID)
        names = [p.name for p in self.model.props]
        new = self._staged(new.select("__row", *names, why.alias("__why"), status.alias("__status")))
        new = self._first_wins(new, uniques, names)
        self._write(new.where(F.col("__status") == ADDED).withColumns({"_version": F.lit(version), "_op": F.lit(history.ADD)}))
        return new.orderBy("__row").select(*self.key, F.col("__status").alias("status"), F.col("__why").alias("problem"))

    def _first_wins(self, new: DataFrame, uniques: list[str], names: list[str]) -> DataFrame:
        """Settles undecided rows: who is the first undecided of all its values is added, and who shares a value with an
        added row fails, until all are decided. One round, where no value repeats."""
        groups = [[k] for k in uniques]
        while True:
            open_ = F.col("__status").isNull()
            own = lambda g: Window.partitionBy(*g, reduce(lambda a, b: a | b, [F.col(k).isNull() for k in g]))
            first = F.lit(True)
            for g in [self.key, *groups]:
                absent = F.lit(False) if g is self.key else F.col(g[0]).isNull()
                first &= absent | (F.min(F.when(open_, F.col("__row"))).over(own(g)) == F.col("__row"))
            new = new.withColumn("__wins", open_ & first)
            has = F.max(F.col("__wins") | F.coalesce(F.col("__status") == ADDED, F.lit(False)))
            key_taken = has.over(own(self.key))
            other = F.lit(None).cast("string")
            for (u,) in groups:
                other = F.coalesce(other, F.when(F.col(u).isNotNull() & has.over(own([u])), F.lit(f"{u}: already exists")))
            new = new.withColumns({"__key_taken": key_taken, "__other": other})
            status = F.when(~open_, F.col("__status")).when(F.col("__wins"), ADDED).when(F.col("__key_taken"), EXISTS).when(F.col("__other").isNotNull(), INVALID)
            new = self._staged(new.select("__row", *names, F.when(open_ & ~F.col("__wins") & ~F.col("__key_taken"), F.col("__other")).otherwise(F.col("__why")).alias("__why"), status.alias("__status")))
            if not new.where("__status IS NULL").head(1):
                return new

    def change(self, items: list[tuple[Any, tuple, int | None]]) -> DataFrame:
        """(key, status, _version, added_keys) for (key, changes, expected version or None), in their order.

        All changes of a record hold together or not at all. What alters nothing succeeds with the old version and
        writes nothing. Records with the same changes are changed by one expression. added_keys has the keys that values
        got, by the incrementing map.
        """
        result = T.StructType([*[T.StructField(n, self.model.prop(n).type()) for n in self.key], T.StructField("status", T.StringType()), T.StructField("_version", T.LongType()), T.StructField("added_keys", T.MapType(T.StringType(), T.ArrayType(T.LongType())))])
        if not items:
            return self.spark.createDataFrame([], result)
        version = self.clock.next()
        groups: dict[tuple, list[tuple]] = {}
        for i, (k, changes, expected) in enumerate(items):
            groups.setdefault(tuple(changes), []).append((*(k if isinstance(k, tuple) else (k,)), expected, i))
        now, schema, parts = self.snapshot(keys=self._keys([k for k, _, _ in items]).distinct()).where(~F.col("_is_deleted")), self.model.schema(), []
        names = [p.name for p in self.model.props]
        for changes, keys in groups.items():
            asked = self.spark.createDataFrame(keys, T.StructType([*[T.StructField(n, self.model.prop(n).type()) for n in self.key], T.StructField("__expected", T.LongType()), T.StructField("__row", T.IntegerType())]))
            d = asked.join(now, self.key, "left")
            before = {n: F.col(f"`{n}`") for n in names}
            after, ok = apply_all(changes, before, schema)
            more = [c for c in changes if isinstance(c, IncMapChange) and c.add]
            added = F.create_map(*[x for c in more for x in (F.lit(c.name), c.keys(before, schema).cast("array<bigint>"))]) if more else F.lit(None)
            d = d.select(*self.key, "__row", "__expected", "_last_version", added.cast("map<string,array<bigint>>").alias("added_keys"), F.coalesce(ok, F.lit(False)).alias("__ok"), F.struct(*[before[n].alias(n) for n in names]).alias("b"), F.struct(*[after[n].cast(schema[n].dataType).alias(n) for n in names]).alias("a"))
            final = [n for n in names if self.model.prop(n).final]
            differs = {n: ~comparable(F.col("a").getField(n), schema[n].dataType).eqNullSafe(comparable(F.col("b").getField(n), schema[n].dataType)) for n in names}
            touched = [differs[n] & F.col("b").getField(n).isNotNull() for n in final]
            bad_final, moved = (reduce(lambda x, y: x | y, cs, F.lit(False)) for cs in (touched, differs.values()))
            problem = F.coalesce(*[self.model.prop(n).problem(F.col("a").getField(n)) for n in names])
            status = (
                F.when(F.col("_last_version").isNull(), MISSING).when(F.col("__expected").isNotNull() & (F.col("__expected") != F.col("_last_version")), STALE)
                .when(~F.col("__ok") | bad_final | problem.isNotNull(), INVALID).otherwise(CHANGED)
            )
            parts.append(d.withColumn("status", status).withColumn("__moved", moved))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        out = self._staged(out)
        moved = (F.col("status") == CHANGED) & F.col("__moved")
        self._write(out.where(moved).select("a.*", F.lit(version).alias("_version"), F.lit(history.CHANGE).alias("_op")))
        good = F.when(F.col("status") == CHANGED, F.col("added_keys"))
        return out.orderBy("__row").select(*self.key, "status", F.when(moved, F.lit(version)).otherwise(F.col("_last_version")).alias("_version"), good.alias("added_keys"))

    def delete(self, keys: list, hard: bool = False) -> DataFrame:
        version = self.clock.next()
        asked = self._keys(keys).distinct()
        now = self.snapshot(keys=asked)
        d = self._staged(asked.join(now if hard else now.where(~F.col("_is_deleted")), self.key, "left"))
        found = F.col("_last_version").isNotNull()
        self._write(d.where(found).withColumns({"_version": F.lit(version), "_op": F.lit(history.HARD if hard else history.SOFT)}))
        return d.select(*self.key, F.when(found, DELETED).otherwise(MISSING).alias("status"))

    def process_update(self, rows: DataFrame) -> None:
        """Applies another store's changelog rows; (key, version) pairs that are here already are left out."""
        have = self.log().select(*self.key, "_version")
        self._write(rows.join(have, [*self.key, "_version"], "left_anti").dropDuplicates([*self.key, "_version"]))

    # backup

    def backup(self, path: str, to_version: int | None = None) -> int:
        """The changelog up to one version, which is returned."""
        version = to_version or self.log().agg(F.max("_version")).first()[0] or 0
        self.log().where(F.col("_version") <= version).write.parquet(path)
        return version

    def restore(self, path: str) -> None:
        self.process_update(self.spark.read.schema(self.schema()).parquet(path))


def read_json(spark: SparkSession, model: Model, path: str) -> DataFrame:
    """Records from JSON lines, by the model's schema; alternative names are read too."""
    fields = [*model.schema().fields, *[T.StructField(a, p.type()) for p in model.props for a in p.names]]
    raw = spark.read.schema(T.StructType(fields)).json(path)
    return raw.select(*[F.coalesce(F.col(p.name), *[F.col(a) for a in p.names]).alias(p.name) for p in model.props])


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)
