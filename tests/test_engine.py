"""Semantics that the SQL comparison can't show, on small literal tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillbase.functions import geo, text
from quillbase.functions.refs import ref
from quillbase.functions.values import Clock, average_of, key_bytes, round_to, sum_of
from quillbase.model import NEEDS_MIGRATION, NEW_INDEXES, ONLY_SAFE_ADDS, UP_TO_DATE, Index, Model, ModelError, Part, Prop, compatibility
from quillbase.operators import aggregations as ag
from quillbase.operators import filters as fl
from quillbase.operators.changes import Change, Check, IncMapChange, ListChange, SetChange
from quillbase.operators.projection import Pick, project
from quillbase.plans import requests as rq
from quillbase.sources.store import Store
from quillbase.streaming.flow import execute_flow, fold, page_updates

LOG = Model(
    "Log",
    (Prop(1, "message", "string"), Prop(2, "severity", "enum", final=True, values=((1, "INFO"), (2, "DEBUG"), (3, "ERROR"))), Prop(3, "timestamp", "datetime", final=True)),
    key=(Part("timestamp", "reversed"), Part("severity")),
    indexes=(Index("severity", (Part("severity"),)),),
)
ITEM = Model(
    "Item",
    (
        Prop(1, "id", "sint64", final=True), Prop(2, "name", "string", regex="ha.*", default="haha"), Prop(3, "n", "sint32", required=False, max_value=6), Prop(4, "email", "string", required=False, unique=True),
        Prop(5, "tags", "list", required=False, item=Prop(0, "t", "sint32")), Prop(6, "days", "set", required=False, item=Prop(0, "d", "string")), Prop(7, "inc", "incmap", required=False, key=Prop(0, "k", "sint64"), item=Prop(0, "v", "string")),
    ),
    key=(Part("id"),), indexes=(Index("n", (Part("n"),)),),
)


@pytest.fixture(scope="module")
def two(spark):
    schema = "string string, int int, uint long, d double, at timestamp_ntz, bool boolean, map map<string,string>, list array<int>, days array<string>, nothing int"
    return spark.createDataFrame(
        [
            ("haha1", 5, 6, 0.43, dt.datetime(2018, 3, 2), True, {"12:13:14": "haha10"}, [4, 6, 7], ["2019-03-30", "2018-09-09"], None),
            ("haha2", 3, 5, 0.23, dt.datetime(2016, 2, 20), False, {"17:16:15": "haha1"}, [3, 4, 6], ["2020-02-20", "2013-04-19"], None),
        ],
        schema,
    )


CASES = [
    (fl.And(), {5, 3}), (fl.Or(), set()), (fl.Not(), {5, 3}), (fl.Exists("nothing"), set()), (fl.Not(fl.Equals(nothing=1)), {5, 3}), (fl.Not(fl.LessThan(nothing=1), fl.Equals(int=5)), {3}),
    (fl.Equals(string="haha1", int=5), {5}), (fl.Equals(list=[4, 6]), {5, 3}), (fl.Equals(list=[4, 7]), {5}), (fl.Equals(map={"12:13:14": "haha10"}), {5}), (fl.Equals((ref("list").any(), 3)), {3}),
    (fl.Equals((ref("list").item(0), 4)), {5}), (fl.Equals((ref("list").item(9), 4)), set()), (fl.Prefix((ref("map").any_value(), "haha10")), {5}), (fl.Exists(ref("days").set_item("2020-02-20")), {3}),
    (fl.Range(int=fl.Between(3, 5, include_high=False)), {3}), (fl.Range(int=fl.Between(3, 5, include_low=False)), {5}), (fl.RegEx(string="haha"), set()), (fl.RegEx(string="h.*[1-5]"), {5, 3}), (fl.ValueIn(int=[]), set()),
    (fl.ValueIn(int=[5, 9]), {5}), (fl.Prefix(days=["2019", "2018"]), {5}), (fl.GreaterThanEquals(at=dt.datetime(2018, 3, 2)), {5}), (fl.LessThanEquals(d=0.23), {3}), (fl.Matches(none="x"), set()),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_filters(two, i):
    f, want = CASES[i]
    assert {r["int"] for r in fl.where(two, f).collect()} == want
    # pushed conjuncts and guarded leaves agree
    assert {r["int"] for r in fl.where(two, fl.Or(f)).collect()} == want


def test_nesting_limit(two):
    f = fl.Exists("int")
    for _ in range(65):
        f = fl.Not(f)
    with pytest.raises(ModelError):
        fl.where(two, f)


def test_hops(spark, two):
    names = spark.createDataFrame([(5, "five")], "k int, name string")
    name = ref("int").hop("target", names, "k").field("name")
    assert [r["int"] for r in fl.where(two, fl.Equals((name, "five"))).collect()] == [5]
    assert [r["int"] for r in fl.where(two, fl.Not(fl.Equals((name, "five")))).collect()] == [3]


def test_pushdown(spark, tmp_path, two):
    two.write.parquet(str(tmp_path / "t"))
    t = fl.where(spark.read.parquet(str(tmp_path / "t")), fl.And(fl.Equals(int=5), fl.GreaterThan(d=0.1))).select("string")
    plan = t._jdf.queryExecution().toString()
    assert "EqualTo(int,5)" in plan and "GreaterThan(d,0.1)" in plan


def test_search(spark):
    d = spark.createDataFrame([(1, "Jean-Luc van der–Waals", "Strauß"), (2, None, "MÜLLER_x"), (3, "", "")], "id int, a string, b string")
    assert d.select(text.tokens(F.col("a"), F.col("b")).alias("t")).collect()[0]["t"] == ["jean", "luc", "van", "der", "waals", "strauss"]
    ctx = fl.Context({"name": fl.Search(("a", "b"))})
    ids = lambda f: sorted(r["id"] for r in fl.where(d, f, ctx).collect())
    assert ids(fl.Matches(name="STRAUSS luc")) == [1] and ids(fl.Matches(name="mullerx")) == [2] and ids(fl.Matches(name=" - ")) == []
    assert ids(fl.MatchesPrefix(name="wa ja")) == [] and ids(fl.MatchesPrefix(name="wa je")) == [1] and ids(fl.MatchesRegEx(name="mull.*")) == [2]


def test_geo(spark):
    d = spark.createDataFrame([(1, 0.0, 179.5), (2, 0.0, -179.5), (3, 10.0, 0.0), (4, 0.0, 0.0)], "id int, lat double, lon double")
    ids = lambda c: sorted(r["id"] for r in d.where(c).collect())
    lat, lon = F.col("lat"), F.col("lon")
    assert ids(geo.within_box(lat, lon, -1, 179, 1, -179)) == [1, 2]
    assert ids(geo.within_radius(lat, lon, 0, 180, 60_000)) == [1, 2]
    assert ids(geo.within_polygon(lat, lon, [(-1, 179), (-1, -179), (1, -179), (1, 179)])) == [1, 2]
    assert ids(geo.within_polygon(lat, lon, [(0, 0), (0, 10), (10, 10), (10, 0)])) == [3, 4]  # corners and edges are in
    cells = set(geo.cover(-1, 179, 1, -179, 16))
    got = {r["id"]: r["c"] for r in d.select("id", geo.geohash(lat, lon, 16).alias("c")).collect()}
    assert got[1] in cells and got[2] in cells and got[3] not in cells and geo.cover(-90, -180, 90, 180, 32) is None


ROUND = dt.datetime(2019, 6, 8, 13, 45, 23, 999000)


@pytest.mark.parametrize("unit,want", [("seconds", ROUND.replace(microsecond=0)), ("minutes", ROUND.replace(second=0, microsecond=0)), ("hours", dt.datetime(2019, 6, 8, 13)), ("days", dt.datetime(2019, 6, 8)), ("months", dt.datetime(2019, 6, 1)), ("quarters", dt.datetime(2019, 4, 1)), ("years", dt.datetime(2019, 1, 1)), ("decades", dt.datetime(2010, 1, 1)), ("centuries", dt.datetime(2000, 1, 1)), ("millennia", dt.datetime(2000, 1, 1))])
def test_round(spark, unit, want):
    d = spark.createDataFrame([(ROUND,)], "t timestamp_ntz")
    assert d.select(round_to(F.col("t"), unit).alias("t")).first()["t"] == want


def test_arithmetic(spark):
    d = spark.createDataFrame([(200, 100, -7), (100, 100, 0)], "u short, s byte, i int")
    r = d.agg(sum_of(F.col("u"), "uint8").alias("u"), sum_of(F.col("s"), "sint8").alias("s"), average_of(F.col("i"), "sint32").alias("i"), sum_of(F.lit(None).cast("int"), "sint32").alias("none")).first()
    assert (r["u"], r["s"], r["i"], r["none"]) == (44, -56, -3, None)
    m = spark.createDataFrame([(12936,), (452,), (789,)], "v int")
    assert ag.aggregate(m, {"sum": ag.Sum("v", "sint32"), "count": ag.ValueCount("v")}).collect() == [(14177, 3)]
    assert ag.aggregate(m.where("v < 0"), {"sum": ag.Sum("v", "sint32")}).collect() == []
    dec = spark.createDataFrame([(1,), (2,)], "v int").select((F.col("v") / 100).cast("decimal(10,2)").alias("v"))
    assert str(ag.aggregate(dec, {"a": ag.Average("v", "decimal")}).first()["a"]) == "0.02"
    with pytest.raises(ModelError):
        ag.aggregate(m, {"x": ag.Sum("v", "string")})


def test_nested_buckets(spark):
    d = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (2, "a", 5), (None, "a", 7)], "e int, s string, v int")
    r = ag.aggregate(d, {"n": ag.ValueCount("e"), "e": ag.EnumValues("e", aggs={"t": ag.Sum("v", "sint32"), "s": ag.EnumValues("s")})}).first()
    assert r["n"] == 3 and [(b["key"], b["count"], b["t"], [(x["key"], x["count"]) for x in b["s"]]) for b in r["e"]] == [(1, 2, 5, [("a", 1), ("b", 1)]), (2, 1, 5, [("a", 1)])]


def test_key_bytes_keep_order(spark):
    d = spark.createDataFrame([(v,) for v in (-(2**63), -5, 0, 7, 2**63 - 1)], "v long")
    for down in (False, True):
        got = [r["v"] for r in d.orderBy(key_bytes(F.col("v"), "sint64", down)).collect()]
        assert got == sorted(got, reverse=down)


@pytest.fixture(scope="module")
def logs(spark):
    t = lambda h, m, s, us=0: dt.datetime(2018, 11, 14, h, m, s, us)
    rows = [("Something happened", 1, t(11, 22, 33, 40000)), ("Something else happened", 2, t(12, 0, 0)), ("Something REALLY happened", 1, t(12, 33, 22, 111000)), ("WRONG", 3, t(13, 0, 2))]
    return spark.createDataFrame(rows, "message string, severity int, timestamp timestamp_ntz")


def test_scan(logs):
    run = lambda **k: rq.fetch_scan(LOG, logs, rq.Scan(**k))
    names = lambda r: [x["message"].split()[-2:] for x in r.rows.collect()]
    assert [x["severity"] for x in run().rows.collect()] == [3, 1, 2, 1]
    third = (dt.datetime(2018, 11, 14, 12, 33, 22, 111000), 1)
    assert [x["severity"] for x in run(start_key=third).rows.collect()] == [1, 2, 1]
    assert [x["severity"] for x in run(start_key=third, include_start=False).rows.collect()] == [2, 1]
    r = run(order=(rq.Order("severity", True),))
    assert [x["severity"] for x in r.rows.collect()] == [3, 2, 1, 1] and r.info.path == "IndexScan"
    assert [x["timestamp"].hour for x in r.rows.collect()] == [13, 12, 11, 12]  # ties by key, backwards too
    assert names(run(limit=1)) == [["WRONG"]]
    with pytest.raises(rq.RequestError):
        run(order=(rq.Order("message"),))
    with pytest.raises(rq.RequestError):
        run(where=fl.Equals(message="WRONG"))
    assert run(where=fl.Equals(message="WRONG"), allow_table_scan=True).rows.count() == 1
    with pytest.raises(rq.RequestError):
        rq.Scan(limit=0)


def test_cursor(spark):
    from dataclasses import replace

    d = spark.createDataFrame([(i, f"ha{i}", i % 3) for i in range(10)], "id long, name string, n int")
    d = d.withColumns({"email": F.lit(None).cast("string"), "tags": F.lit(None).cast("array<int>"), "days": F.lit(None).cast("array<string>"), "inc": F.lit(None).cast("map<bigint,string>")})
    r = rq.Scan(order=(rq.Order("n"),), limit=4, select=["id"])
    seen, token = [], None
    while True:
        page = rq.fetch_scan(ITEM, d, replace(r, cursor=token))
        seen += [x["id"] for x in page.rows.collect()]
        token = page.next_cursor()
        if token is None:
            break
    assert seen == sorted(range(10), key=lambda i: (i % 3, i))
    with pytest.raises(rq.RequestError):
        rq.fetch_scan(ITEM, d, replace(r, cursor=rq.encode_cursor(ITEM, replace(r, where=fl.Equals(n=1)), [1, 1])))


def test_projection(spark):
    d = spark.createDataFrame([(1, (5, None), {"a": 1, "b": 2}, None), (2, None, None, None)], "id int, s struct<x:int,y:int>, m map<string,int>, z int")
    assert project(d, [Pick("s", ("y",))], ("id",)).count() == 0
    assert project(d, [Pick("s", ("x",)), Pick("m", map_key="b")], ("id",)).collect() == [(1, (5,), {"b": 2})]
    assert project(d, [], ("id",)).count() == 2


def test_compatibility():
    v1 = Model("M", (Prop(1, "value", "string"),), key=(Part("value"),))
    assert compatibility(v1, v1)[0] == UP_TO_DATE
    assert compatibility(Model("M", (*v1.props, Prop(2, "n", "sint32", required=False)), key=v1.key), v1)[0] == ONLY_SAFE_ADDS
    assert compatibility(Model("M", v1.props, key=v1.key, indexes=(Index("v", (Part("value"),)),)), v1)[0] == NEW_INDEXES
    assert compatibility(Model("M", (Prop(1, "value", "sint32"),), key=v1.key), v1)[0] == NEEDS_MIGRATION
    with pytest.raises(ModelError):
        Model("M", (Prop(1, "a", "string"), Prop(1, "b", "string")))
    with pytest.raises(ModelError):
        Prop(1, "d", "decimal", precision=40).type()


def test_clock():
    c = Clock()
    a = [c.next() for _ in range(1000)]
    assert a == sorted(set(a)) and c.next(a[-1] + 10**9) > a[-1] + 10**9


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "log"), ITEM)
    rows = spark.createDataFrame([(1, "haha1", 5, "a@x", [4, 6, 4], ["x"], {1: "one"}), (2, None, 3, None, None, None, None)], "id long, name string, n int, email string, tags array<int>, days array<string>, inc map<long,string>")
    assert {r["id"]: r["status"] for r in s.add(rows).collect()} is not None
    return s


def test_store(spark, store, tmp_path):
    s = store
    assert {r["id"]: r["name"] for r in s.snapshot().collect()} == {1: "haha1", 2: "haha"}
    first = s.log().agg(F.max("_version")).first()[0]
    more = spark.createDataFrame([(1, "haha", 1, None), (3, "nope", 1, None), (4, "ha", 9, None), (5, "ha", 1, "a@x"), (6, "ha", 1, "b@x")], "id long, name string, n int, email string")
    assert {r["id"]: r["status"] for r in s.add(more).collect()}.keys() == {1, 3, 4, 5, 6}
    assert {r["id"] for r in s.snapshot().collect()} == {1, 2, 6}
    out = s.change([(1, (ListChange("tags", delete=(4,), insert=((0, 9),), append=(8,)), SetChange("days", ("x", "y")), IncMapChange("inc", ("two",))), None), (2, (Check((("n", 4),)), Change((("n", 6),))), None), (6, (Change((("n", 2),)),), 1), (9, (Change((("n", 2),)),), None)])
    assert {r["id"]: r["status"] for r in out.collect()}.keys() == {1, 2, 6, 9}
    now = {r["id"]: r for r in s.snapshot().collect()}
    assert now[1]["tags"] == [9, 6, 4, 8] and now[1]["days"] == ["x", "y"] and now[1]["inc"] == {1: "one", 2: "two"} and now[2]["n"] == 3 and now[6]["n"] == 1
    n = s.log().count()
    s.change([(1, (Change((("n", 5),)),), None)])
    assert s.log().count() == n  # nothing altered, nothing written
    s.delete([2, 77])
    assert {r["id"] for r in s.scan(rq.Scan()).rows.collect()} == {1, 6}
    assert {r["id"] for r in s.scan(rq.Scan(filter_soft_deleted=False)).rows.collect()} == {1, 2, 6}
    assert {r["id"] for r in s.snapshot(first).collect()} == {1, 2} and s.snapshot(first - 1).count() == 0
    assert [r["id"] for r in s.get(rq.Get((6, 3, 1))).rows.collect()] == [6, 1]
    kinds = [(r["id"], r["kind"], r["reason"]) for r in s.get_updates([1, 2]).collect()]
    assert kinds == [(1, "Addition", None), (2, "Addition", None), (1, "Change", None), (2, "Removal", "SoftDelete")]
    changes = {r["id"]: [[c["path"] for c in v["changes"]] for v in r["versions"]] for r in s.get_changes([1], max_versions=5).collect()}
    assert changes == {1: [["days", "email", "inc", "n", "name", "tags"], ["days", "inc", "tags"]]}
    assert s.scan_update_history(1, filter_soft_deleted=False).first()["_op"] == "soft_delete" and s.scan_update_history(1).first()["_op"] == "change"
    keys, ups = s.scan_updates(rq.Scan(), ordered_keys=[1, 2, 50])
    assert sorted((r["id"], r["kind"], r["reason"]) for r in ups.where("_version is null").collect()) == [(2, "Removal", "SoftDelete"), (6, "Addition", None), (50, "Removal", "HardDelete")]
    with pytest.raises(rq.RequestError):
        s.scan_changes(rq.Scan(where=fl.Equals(n=1), allow_table_scan=True))
    s.backup(str(tmp_path / "copy"))
    other = Store(spark, str(tmp_path / "log2"), ITEM)
    other.restore(str(tmp_path / "copy"))
    other.restore(str(tmp_path / "copy"))
    assert other.log().count() == s.log().count()
    s.delete([1], hard=True)
    assert {r["id"] for r in s.snapshot().collect()} == {2, 6}
    with pytest.raises(rq.RequestError):
        Store(spark, str(tmp_path / "log"), ITEM, keep_all_versions=False).snapshot(1)


def test_flow(spark, store, tmp_path):
    got = []
    request = rq.Scan(limit=2, select=["id", "n"])
    run = lambda: execute_flow(store, request, lambda n, u: got.extend(u), str(tmp_path / "cp"), once=True).awaitTermination()
    run()
    assert got[0]["kind"] == "InitialValues" and [r["id"] for r in got[0]["values"]] == [1, 2]
    store.delete([1])
    run()  # after a restart the page comes whole again
    assert [r["id"] for r in fold([], got, ["id"])] == [2]
    with pytest.raises(rq.RequestError):
        execute_flow(store, rq.Scan(to_version=1), print, str(tmp_path / "cp2"))


def test_page_updates():
    a, b = [{"id": 1, "v": 1}, {"id": 2, "v": 1}], [{"id": 3, "v": 0}, {"id": 2, "v": 5}]
    u = page_updates(a, b, ["id"], {(1,): "SoftDelete"})
    assert [(x["kind"], x["key"]) for x in u] == [("Removal", (1,)), ("Addition", (3,)), ("Change", (2,))] and u[0]["reason"] == "SoftDelete"
    assert fold(a, u, ["id"]) == b


def test_schema_metadata():
    assert LOG.schema()["severity"].metadata == {"index": 2} and isinstance(LOG.schema()["timestamp"].dataType, T.TimestampNTZType)


PAIR = Model("Pair", (Prop(1, "a", "sint32"), Prop(2, "b", "sint32"), Prop(3, "n", "sint32", required=False)), key=(Part("a"), Part("b")), indexes=(Index("ba", (Part("b"), Part("a"))), Index("n", (Part("n"),)), Index("top", (Part("n", "to_max"),))))


def test_start_key_in_index_order(spark):
    rows = [(a, b, 10 * a + b if (a + b) % 2 else None) for a in (1, 2, 3) for b in (10, 20, 30)]
    d = spark.createDataFrame(rows, "a int, b int, n int")
    run = lambda **k: [(r["a"], r["b"]) for r in rq.fetch_scan(PAIR, d, rq.Scan(**k)).rows.collect()]
    order = (rq.Order("b"), rq.Order("a"))
    want = sorted(((a, b) for a, b, _ in rows), key=lambda x: (x[1], x[0]))
    assert run(order=order, start_key=(2, 20)) == [x for x in want if (x[1], x[0]) >= (20, 2)]
    assert run(order=order, start_key=(2, 20), include_start=False) == [x for x in want if (x[1], x[0]) > (20, 2)]
    assert run(order=order, start_key=(9, 9)) == want  # a record that isn't there bounds nothing
    assert run(order=(rq.Order("b", True), rq.Order("a", True)), start_key=(2, 20)) == [x for x in want[::-1] if (x[1], x[0]) <= (20, 2)]
    assert run(start_key=(2, 20)) == [(2, 20), (2, 30), (3, 10), (3, 20), (3, 30)]


def test_absent_counts_as_the_maximum(spark):
    d = spark.createDataFrame([(1, 1, None), (2, 1, 5), (3, 1, 2**31 - 1), (4, 1, -7)], "a int, b int, n int")
    model = Model("M", PAIR.props, key=PAIR.key, indexes=(PAIR.indexes[2],))
    r = rq.Scan(order=(rq.Order("n"),), limit=2)
    assert [x["a"] for x in rq.fetch_scan(model, d, rq.Scan(order=(rq.Order("n"),))).rows.collect()] == [4, 2, 1, 3]
    token = rq.fetch_scan(model, d, r).next_cursor()
    from dataclasses import replace

    assert [x["a"] for x in rq.fetch_scan(model, d, replace(r, cursor=token)).rows.collect()] == [1, 3]


def test_normalized_index_leaves_other_columns(spark):
    model = Model("N", (Prop(1, "id", "sint32"), Prop(2, "s", "string"), Prop(3, "c", "string")), key=(Part("id"),), indexes=(Index("s", (Part("s", "normalize"),)),))
    d = spark.createDataFrame([(1, "b", "X"), (2, "A", "x"), (3, "C", "X")], "id int, s string, c string")
    run = lambda **k: [r["id"] for r in rq.fetch_scan(model, d, rq.Scan(order=(rq.Order("s"),), allow_table_scan=True, **k)).rows.collect()]
    assert run() == [2, 1, 3] and run(where=fl.Equals(c="X")) == [1, 3] and run(where=fl.Equals(s="á")) == [2]


def test_cursor_is_the_same_in_other_processes():
    import subprocess
    import sys

    code = "from quillbase.plans import requests as rq; from quillbase.operators import filters as fl; from tests.test_engine import PAIR; print(rq.fingerprint(PAIR, rq.Scan(where=fl.ValueIn(n=set('abcdefgh')))))"
    got = {subprocess.run([sys.executable, "-c", code], env={**__import__("os").environ, "PYTHONHASHSEED": s}, capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).parents[1])).stdout.strip() for s in ("1", "2")}
    assert len(got) == 1 and got != {""}
    values = [None, b"\x00\xff", 1.5, dt.datetime(2020, 1, 2, 3, 4, 5, 6), dt.date(2020, 1, 2), True, "ü", 7]
    r = rq.Scan()
    assert rq.decode_cursor(PAIR, r, rq.encode_cursor(PAIR, r, values)) == values
    with pytest.raises(rq.RequestError):
        rq.decode_cursor(PAIR, r, "bm90")


def test_aggregation_kinds(spark):
    from decimal import Decimal

    d = spark.createDataFrame([(2**31 - 1, Decimal("0E-10")), (2**31 - 1, Decimal("1E-10")), (1, None)], "v int, m decimal(20,10)")
    assert ag.aggregate(d, {"s": ag.Sum("v")}).first()["s"] == -1  # in its own width
    assert ag.aggregate(d.where("v = 1 or v = 2147483647").limit(3), {"a": ag.Average("v")}).schema["a"].dataType.simpleString() == "int"
    assert ag.aggregate(d, {"a": ag.Average("m")}).first()["a"] == Decimal("0E-10")  # half to even
    up = spark.createDataFrame([(Decimal("0.01"),), (Decimal("0.02"),), (Decimal("-0.03"),), (Decimal("-0.02"),)], "m decimal(10,2)")
    assert ag.aggregate(up.limit(2), {"a": ag.Average("m")}).first()["a"] == Decimal("0.02")
    assert ag.aggregate(up.where("m < 0"), {"a": ag.Average("m")}).first()["a"] == Decimal("-0.02")
    with pytest.raises(ModelError):
        ag.aggregate(d.select(F.lit("1").alias("v")), {"s": ag.Sum("v")})
    with pytest.raises(Exception, match="too many digits"):
        ag.aggregate(spark.createDataFrame([(Decimal("9.9"),), (Decimal("9.9"),)], "m decimal(2,1)"), {"s": ag.Sum("m")}).collect()


def test_aggregations_over_all_pages(spark, tmp_path):
    from quillbase.catalog_store import QUERIES

    n = rq.MAX_LIMIT + 5
    spark.range(n).selectExpr("id AS p_partkey", "CAST(1 + id % 50 AS int) AS p_size", "1.5D AS p_retailprice").write.parquet(str(tmp_path / "part.parquet"))
    want = sum(1 + i % 50 for i in range(n))
    got = QUERIES["agg_model_types"](spark, str(tmp_path)).collect()
    assert got == [(want % 256, (want * 40_000_000 + 2**31) % 2**32 - 2**31, n)]

    rows = [(a, b, 10 * a + b if (a + b) % 20 else None, b == 30) for a in range(1, 9) for b in (10, 20, 30)]
    d = spark.createDataFrame(rows, "a int, b int, n int, _is_deleted boolean")
    request = lambda **k: rq.Scan(limit=2, aggregations={"n": ag.ValueCount("a"), "s": ag.Sum("n")}, **k)
    run = lambda **k: [tuple(r) for r in rq.aggregate_scan(PAIR, d, request(**k)).collect()]
    of = lambda test: [(len(x := [r for r in rows if test(*r)]), sum(r[2] for r in x if r[2] is not None))]
    assert run() == of(lambda a, b, n, gone: not gone)
    assert run(filter_soft_deleted=False) == of(lambda a, b, n, gone: True)
    assert run(start_key=(3, 20), include_start=False) == of(lambda a, b, n, gone: not gone and (a, b) > (3, 20))
    assert run(where=fl.Equals(b=20), order=(rq.Order("b"), rq.Order("a", True)), strict=False) == of(lambda a, b, n, gone: b == 20)
    assert run(order=(rq.Order("n"),)) == of(lambda a, b, n, gone: not gone and n is not None)  # the others aren't in the index
    assert run(where=fl.Equals(a=99)) == []
    assert rq.fetch_scan(PAIR, d, request()).aggregations.collect() == [(2, 50)]  # of the page: (1, 10), (1, 20)
    with pytest.raises(rq.RequestError):
        rq.aggregate_scan(PAIR, d, rq.Scan())


@pytest.mark.parametrize("rows", [[(1, 7), (2, None), (None, 50)], [(1, None)], [], [(i, 1 + i * 9973) for i in range(40)], [(1, 107), (2, 53), (3, 54)]])
def test_model_types_as_in_sql(spark, tmp_path, rows):
    import duckdb

    from quillbase.catalog_store import ORACLE_SQL, QUERIES

    spark.createDataFrame([(*r, 1.5) for r in rows], "p_partkey long, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    want = duckdb.sql(ORACLE_SQL["agg_model_types"].replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet'")).fetchall()
    assert [tuple(r) for r in QUERIES["agg_model_types"](spark, str(tmp_path)).collect()] == want


def test_decimals(spark):
    from decimal import Decimal

    from quillbase.functions import decimals as de

    d = spark.createDataFrame([(Decimal("7.50"), Decimal("2.5"))], "a decimal(10,2), b decimal(10,1)")
    a, b = F.col("a"), F.col("b")
    r = d.select(de.divide_exact(a, b, 1).alias("q"), de.rescale_exact(a, 1).alias("r"), de.times(a, b, 2, 1).alias("t"), de.compare(a, b).alias("c"), de.minus(a, b).alias("m")).first()
    assert (r["q"], r["r"], r["t"], r["c"], r["m"]) == (Decimal("3.0"), Decimal("7.5"), Decimal("18.750"), 1, Decimal("5.00"))
    for bad in (de.divide_exact(a, F.lit(7).cast("decimal(2,0)"), 2), de.divide_exact(a, F.lit(0).cast("decimal(2,0)"), 2), de.rescale_exact(a + F.lit(Decimal("0.01")), 1)):
        with pytest.raises(Exception, match="decimal|zero"):
            d.select(bad).collect()


def test_or_is_pushed_down(spark, tmp_path, two):
    two.withColumn("s", F.struct("int")).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = fl.where(t, fl.Or(fl.Equals(int=5), fl.GreaterThan((ref("s.int"), 9))))._jdf.queryExecution().toString()
    assert "Or(EqualTo(int,5),GreaterThan(s.int,9))" in plan


def test_get_reads_its_keys_only(store):
    plan = store.get(rq.Get((1,))).rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")  # the keys' join stands below the aggregation


def test_generated_keys(spark, tmp_path):
    for kind, mark in (("uuid4", "4"), ("uuid7", "7")):
        model = Model("G", (Prop(1, "id", "fixedbytes"), Prop(2, "v", "sint32")), key=(Part("id", kind),))
        s = Store(spark, str(tmp_path / kind), model)
        out = s.add(spark.createDataFrame([(i,) for i in range(20)], "v int")).collect()
        ids = {bytes(r["id"]) for r in out}
        assert len(ids) == 20 and {r["status"] for r in out} == {"AddSuccess"} and {i.hex()[12] for i in ids} == {mark} and {len(i) for i in ids} == {16}
        assert {bytes(r["id"]) for r in s.snapshot().collect()} == ids


def test_batches_in_order(spark, store):
    rows = [(10, "ha", "p@x"), (10, "ha", None), (11, "no", "q@x"), (11, "ha", "p@x"), (11, "ha", "q@x"), (12, "ha", "q@x"), (1, "ha", None)]
    got = [(r["id"], r["status"]) for r in store.add(spark.createDataFrame(rows, "id long, name string, email string").coalesce(1)).collect()]
    assert got == [(10, "AddSuccess"), (10, "AlreadyExists"), (11, "ValidationFail"), (11, "ValidationFail"), (11, "AddSuccess"), (12, "ValidationFail"), (1, "AlreadyExists")]
    assert store.change([]).count() == 0
    out = store.change([(1, (IncMapChange("inc", ("two", "three")),), None)]).first()
    assert out["added_keys"] == {"inc": [2, 3]}
    store.clean()


def test_scan_updates_recent(store):
    store.change([(1, (Change((("n", 4),)),), None)])
    keys, _ = store.scan_updates(rq.Scan(limit=1), recent_first=True)
    assert [r["id"] for r in keys.collect()] == [1]
    assert store.scan_update_history(where=fl.Equals(n=4)).count() == 1


@pytest.mark.parametrize("kind,first", [("scan_changes", "InitialChanges"), ("scan_updates", "OrderedKeys"), ("get", "InitialValues"), ("get_updates", "OrderedKeys")])
def test_flow_kinds(store, tmp_path, kind, first):
    got = []
    request = rq.Scan(limit=2) if kind.startswith("scan") else rq.Get((1, 2))
    execute_flow(store, request, lambda n, u: got.extend(u), str(tmp_path / "cp"), once=True, kind=kind).awaitTermination()
    assert got[0]["kind"] == first and [r["id"] for r in fold([], got, ["id"])] == [1, 2]
    with pytest.raises(rq.RequestError):
        execute_flow(store, request, print, str(tmp_path / "x"), kind="get" if kind.startswith("scan") else "scan")
