"""Queries of index scans, writes, histories and flows, with their SQL. Stores lie in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import decimals, geo
from .functions.refs import ref
from .model import Index, Model, Part, Prop
from .operators import aggregations as ag
from .operators import filters as fl
from .operators.changes import Change, Check, IncMapChange, ListChange, SetChange
from .operators.projection import Pick, project
from .plans import history, requests
from .sources.store import Store, read_json, write_json
from .streaming.flow import execute_flow, fold

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder where the cluster shares its checkpoints; on a single machine without one, a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="quillbase-store-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared}/store-{uuid.uuid4().hex}"


# Index scans

PRICED = Model("Priced", (Prop(1, "o_orderkey", "sint64", final=True), Prop(2, "o_totalprice", "float64"), Prop(3, "due", "sint32", required=False), Prop(4, "status", "string", required=False)), key=(Part("o_orderkey"),), indexes=(Index("price", (Part("o_totalprice"),)), Index("due", (Part("due", "to_max"),))))
NAMED = Model("Named", (Prop(1, "p_partkey", "sint64"), Prop(2, "label", "string")), key=(Part("p_partkey"),), indexes=(Index("label", (Part("label", "normalize"),)),))
WORDS = Model("Words", (Prop(1, "p_partkey", "sint64"), Prop(2, "words", "list", item=Prop(0, "w", "string")), Prop(3, "p_size", "sint32")), key=(Part("p_partkey"),), indexes=(Index("words", (Part("words", "any"), Part("p_size", "reversed"))),))
HASHED = Model("Hashed", (Prop(1, "id", "fixedbytes"), Prop(2, "c_custkey", "sint64")), key=(Part("id"),))
PLACED = Model("Placed", (Prop(1, "c_custkey", "sint64"), Prop(2, "p", "geopoint")), key=(Part("c_custkey"),), indexes=(Index("cell", (Part("p", "geohash", 16),)),))


def _orders(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.nullif((F.col("o_custkey") % 5).cast("int"), F.lit(3)).alias("due"), F.nullif("o_orderstatus", F.lit("O")).alias("status"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE row(o_totalprice, o_orderkey) >= (SELECT row(o_totalprice, o_orderkey) FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)) ORDER BY o_totalprice, o_orderkey LIMIT 100")
def scan_index_start_key(spark, sf_dir):
    t = _orders(spark, sf_dir)
    start = t.agg(F.max("o_orderkey")).first()[0]
    return requests.fetch_scan(PRICED, t, requests.Scan(start_key=(start,), order=(requests.Order("o_totalprice"),), select=["o_orderkey", "o_totalprice"])).rows


@query("SELECT p_partkey, label FROM (SELECT p_partkey, p_type || '-' || p_name AS label, replace(replace(lower(p_type || p_name), ' ', ''), '-', '') AS n FROM part) WHERE starts_with(n, 's') AND p_partkey <> 5 ORDER BY n, p_partkey LIMIT 200")
def scan_normalized_index(spark, sf_dir):
    t = _t(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", F.lit("-"), "p_name").alias("label"))
    f = fl.And(fl.Prefix(label="S-"), fl.Not(fl.Equals(p_partkey=5)))
    return requests.fetch_scan(NAMED, t, requests.Scan(where=f, order=(requests.Order("label"),), limit=200, allow_table_scan=True, select=["p_partkey", "label"])).rows


@query("SELECT o_orderkey, due FROM (SELECT o_orderkey, nullif((o_custkey % 5)::INT, 3) AS due FROM orders) ORDER BY coalesce(due, 2147483647) DESC, o_orderkey DESC LIMIT 300")
def scan_to_max_index(spark, sf_dir):
    return requests.fetch_scan(PRICED, _orders(spark, sf_dir), requests.Scan(order=(requests.Order("due", True),), limit=300, select=["o_orderkey", "due"])).rows


@query("""SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, list_min(list_filter(string_split(p_name, ' '), lambda x: starts_with(x, 'b') OR x >= 'r')) AS w FROM part)
WHERE w IS NOT NULL ORDER BY w, p_size DESC, p_partkey LIMIT 150""")
def scan_multi_entry_index(spark, sf_dir):
    t = _t(spark, sf_dir, "part").select("p_partkey", F.filter(F.split("p_name", " "), lambda x: x.startswith("b") | (x >= "r")).alias("words"), "p_size")
    r = requests.Scan(where=fl.GreaterThanEquals((ref("words").any(), "a")), order=(requests.Order("words"), requests.Order("p_size", True)), limit=150, allow_table_scan=True, select=["p_partkey", "p_size"])
    return requests.fetch_scan(WORDS, t, r).rows


@query("SELECT c_custkey FROM customer ORDER BY md5(c_custkey::VARCHAR) LIMIT 50 OFFSET 50")
def cursor_binary_key(spark, sf_dir):
    t = _t(spark, sf_dir, "customer").select(F.unhex(F.md5(F.col("c_custkey").cast("string"))).alias("id"), "c_custkey")
    r = requests.Scan(limit=50, select=["c_custkey"])
    token = requests.fetch_scan(HASHED, t, r).next_cursor()
    return requests.fetch_scan(HASHED, t, replace(r, cursor=token)).rows.select("c_custkey")


@query("SELECT o_orderkey, status FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status FROM orders) ORDER BY status NULLS FIRST, o_orderkey LIMIT 60 OFFSET 60")
def cursor_null_place(spark, sf_dir):
    t = _orders(spark, sf_dir)
    r = requests.Scan(order=(requests.Order("status"),), limit=60, strict=False, select=["o_orderkey", "status"])
    token = requests.fetch_scan(PRICED, t, r).next_cursor()
    return requests.fetch_scan(PRICED, t, replace(r, cursor=token)).rows


_CELLS = "(SELECT c_custkey, (SELECT sum(((x >> i) & 1) << (2 * i + 1)) + sum(((y >> i) & 1) << (2 * i)) FROM range(8) t(i))::BIGINT AS cell FROM (SELECT c_custkey, least(floor(((c_custkey * 73 % 360 - 180) + 180) / 360 * 256), 255)::BIGINT AS x, least(floor(((c_custkey * 37 % 180 - 90) + 90) / 180 * 256), 255)::BIGINT AS y FROM customer))"


@query(f"SELECT c_custkey FROM {_CELLS} ORDER BY cell, c_custkey LIMIT 100")
def scan_geohash_index(spark, sf_dir):
    k = F.col("c_custkey")
    t = _t(spark, sf_dir, "customer").select("c_custkey", F.struct((k * 37 % 180 - 90).cast("double").alias("lat"), (k * 73 % 360 - 180).cast("double").alias("lon")).alias("p"))
    by_cell = t.withColumn("cell", geo.geohash(F.col("p.lat"), F.col("p.lon"), 16))
    info = requests.PlanInfo("IndexScan", "cell")
    cols = requests.order_columns(PLACED, requests.Scan(), info)
    return by_cell.orderBy(*[c.asc() for c, _ in cols]).limit(100).select("c_custkey")


@query("SELECT o_orderkey, path FROM (SELECT o_orderkey, 'FetchByKey' AS path FROM orders WHERE o_orderkey = 32) UNION ALL SELECT o_orderkey, 'IndexScan' FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5)")
def fetch_paths(spark, sf_dir):
    t = _orders(spark, sf_dir)
    one = requests.fetch_scan(PRICED, t, requests.Scan(where=fl.Equals(o_orderkey=32), select=["o_orderkey"]))
    five = requests.fetch_scan(PRICED, t, requests.Scan(order=(requests.Order("o_totalprice"),), limit=5, select=["o_orderkey"]))
    return one.rows.withColumn("path", F.lit(one.info.path)).union(five.rows.withColumn("path", F.lit(five.info.path)))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def collect_batch(spark, sf_dir):
    of = lambda t: requests.Response(t, requests.PlanInfo("TableScan"))
    done = requests.collect([
        ("orders", lambda _: of(fl.where(_t(spark, sf_dir, "orders"), fl.GreaterThan(o_totalprice=300000.0)))),
        ("nations", lambda _: of(fl.where(_t(spark, sf_dir, "nation"), fl.Equals(n_regionkey=1)))),
        ("buyers", lambda d: of(requests.collect_inject(d["orders"].rows, F.col("o_custkey"), _t(spark, sf_dir, "customer"), "c_custkey"))),
        ("both", lambda d: of(requests.collect_inject(d["nations"].rows, F.col("n_nationkey"), d["buyers"].rows, "c_nationkey"))),
    ])
    return done["both"].rows.select("c_custkey", "c_name")


# Aggregations by the model's types

SIZES = Model("Sizes", (Prop(1, "p_partkey", "sint64"), Prop(2, "small", "uint8"), Prop(3, "size", "sint32"), Prop(4, "price", "decimal", precision=12, scale=2)), key=(Part("p_partkey"),))


def _sizes(spark, sf_dir):
    """Sizes wrap in their properties' widths, which leaves wrapped sums as they are; one: counts records without a size too."""
    n = F.col("p_size").cast("long")
    size = F.pmod(n * 40_000_000 + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    return _t(spark, sf_dir, "part").select("p_partkey", F.pmod(n, F.lit(1 << 8)).cast("smallint").alias("small"), "p_size", size.cast("int").alias("size"), F.col("p_retailprice").cast("decimal(12,2)").alias("price"), F.lit(1).alias("one"))


@query("SELECT (sum(p_size) % 256)::SMALLINT AS small, ((sum(p_size::HUGEINT * 40000000) + 2147483648) % 4294967296 - 2147483648)::INT AS size, count(*) AS n FROM part")
def agg_model_types(spark, sf_dir):
    r = requests.Scan(aggregations={"small": ag.Sum("small"), "size": ag.Sum("size"), "n": ag.ValueCount("one")})
    out = requests.aggregate_scan(SIZES, _sizes(spark, sf_dir), r)
    # an empty table has a row too, as in SQL
    return out.agg(F.first("small").alias("small"), F.first("size").alias("size"), F.coalesce(F.first("n"), F.lit(0)).alias("n"))


@query("""SELECT ((q + CASE WHEN 2 * r > n OR (2 * r = n AND q % 2 = 1) THEN 1 ELSE 0 END) / 100)::DECIMAL(12,2)::VARCHAR AS average, n, brand FROM (
  SELECT p_brand AS brand, count(*) AS n, sum(round(p_retailprice * 100)::HUGEINT) // count(*) AS q, sum(round(p_retailprice * 100)::HUGEINT) % count(*) AS r FROM part GROUP BY p_brand)""")
def agg_decimal_average(spark, sf_dir):
    t = _t(spark, sf_dir, "part").select("p_brand", F.col("p_retailprice").cast("decimal(12,2)").alias("price"))
    out = ag.bucket_rows(t, [("brand", ag.EnumValues("p_brand", aggs={"average": ag.Average("price")}))], SIZES)
    return out.select(F.col("average").cast("string").alias("average"), F.col("count").alias("n"), "brand")


@query("SELECT l_orderkey, l_linenumber, (l_quantity * 100 + l_tax * 100)::BIGINT AS added, (l_quantity * l_tax * 10000)::BIGINT AS times, CASE WHEN l_quantity > l_tax THEN 1 WHEN l_quantity < l_tax THEN -1 ELSE 0 END AS compared, (l_quantity * 1000 / 4)::BIGINT AS quarter FROM lineitem")
def decimal_arithmetic(spark, sf_dir):
    q, t = F.col("l_quantity").cast("decimal(12,2)"), F.col("l_tax").cast("decimal(12,2)")
    whole = lambda c, scale: (c * 10**scale).cast("bigint")
    four = F.lit(4).cast("decimal(4,0)")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", whole(decimals.plus(q, t), 2).alias("added"), whole(decimals.times(q, t, 2, 2), 4).alias("times"), decimals.compare(q, t).alias("compared"), whole(decimals.divide_exact(decimals.rescale_exact(q, 0), four, 3), 3).alias("quarter"))


# Search in every script

SCRIPTS = [(1, "йод и Ёлка"), (2, "한글 문서"), (3, "नमस्ते दुनिया"), (4, "Ὀδυσσεύς"), (5, "Tiếng Việt"), (6, "straße-ÉTÉ"), (7, "东京 日本")]


@query("SELECT unnest([1, 1, 2, 2, 3, 4, 5, 6, 7]) AS id, unnest(['йод', 'елка', '한글', '하', 'नमस्ते', 'ΟΔΥΣΣΕΎΣ', 'tieng viet', 'STRASSE ete', '东京']) AS q")
def search_scripts(spark, sf_dir):
    t = spark.createDataFrame(SCRIPTS, "id int, body string")
    ctx = fl.Context({"body": fl.Search(("body",))})
    out = None
    for q, kind in (("йод", fl.Matches), ("елка", fl.Matches), ("한글", fl.Matches), ("하", fl.MatchesPrefix), ("नमस्ते", fl.Matches), ("ΟΔΥΣΣΕΎΣ", fl.MatchesPrefix), ("tieng viet", fl.Matches), ("STRASSE ete", fl.Matches), ("东京", fl.Matches)):
        part = fl.where(t, kind(body=q), ctx).select("id", F.lit(q).alias("q"))
        out = part if out is None else out.union(part)
    return out


# Projections


@query("SELECT p_partkey, MAP {'size': p_size} AS m, {'type': CASE WHEN p_size > 25 THEN 1 ELSE 2 END, 'v_big': CASE WHEN p_size > 25 THEN p_size END} AS u FROM part")
def project_map_key_and_union(spark, sf_dir):
    tag = F.when(F.col("p_size") > 25, 1).otherwise(2)
    t = _t(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("size"), F.col("p_size"), F.lit("key"), F.lit(1)).alias("m"), F.struct(tag.alias("type"), F.when(tag == 1, F.col("p_size")).alias("v_big"), F.when(tag == 2, F.col("p_name")).alias("v_small")).alias("u"))
    return project(t, [Pick("m", map_key="size"), Pick("u", ("type", "v_big"))], ("p_partkey",))


# Writes

NATION = Model(
    "Nation",
    (
        Prop(1, "n_nationkey", "sint32", final=True), Prop(2, "n_name", "string", min_size=3, max_size=12), Prop(3, "code", "string", required=False, unique=True),
        Prop(4, "tags", "list", required=False, item=Prop(0, "t", "sint32")), Prop(5, "marks", "set", required=False, item=Prop(0, "m", "string")), Prop(6, "notes", "incmap", required=False, key=Prop(0, "k", "sint64"), item=Prop(0, "v", "string")),
    ),
    key=(Part("n_nationkey"),),
)


def _nations(spark, sf_dir):
    k = F.col("n_nationkey")
    return _t(spark, sf_dir, "nation").select("n_nationkey", F.lit("name").alias("n_name"), F.concat(F.lit("c"), k).alias("code"), F.array(k, k + 1, k).alias("tags"), F.array(F.lit("x")).alias("marks"), F.create_map(F.lit(1).cast("bigint"), F.lit("one")).alias("notes")).coalesce(1).sortWithinPartitions("n_nationkey")


def _stored(spark, sf_dir) -> Store:
    s = Store(spark, scratch(spark), NATION)
    s.add(_nations(spark, sf_dir))
    return s


@query("""SELECT k AS n_nationkey, place, CASE WHEN k < 25 OR place = 2 THEN 'AlreadyExists' WHEN k % 5 = 0 OR k % 5 = 1 THEN 'ValidationFail' ELSE 'AddSuccess' END AS status
FROM (SELECT n_nationkey + 20 AS k, 1 AS place FROM nation UNION ALL SELECT n_nationkey + 20, 2 FROM nation WHERE n_nationkey % 5 = 3)""")
def write_add(spark, sf_dir):
    """Keys 20 to 24 are there; of the others, names too short at 5n, codes that are taken at 5n + 1, keys twice at 5n + 3."""
    s = _stored(spark, sf_dir)
    k = F.col("n_nationkey") + 20
    more = _t(spark, sf_dir, "nation").select(k.alias("n_nationkey"), F.when(k % 5 == 0, "n").otherwise("name").alias("n_name"), F.when(k % 5 == 1, F.lit("c3")).otherwise(F.concat(F.lit("d"), k)).alias("code")).coalesce(1).sortWithinPartitions("n_nationkey")
    again = more.where("(n_nationkey - 20) % 5 = 3").withColumn("code", F.lit(None).cast("string"))
    out = s.add(more.union(again).coalesce(1)).withColumn("at", F.monotonically_increasing_id())
    first = out.groupBy("n_nationkey").agg(F.min("at").alias("first"))
    return out.join(first, "n_nationkey").select("n_nationkey", F.when(F.col("at") == F.col("first"), 1).otherwise(2).alias("place"), "status")


@query("SELECT code, min(n_nationkey)::INT AS n_nationkey FROM (SELECT n_nationkey, 'u' || (n_nationkey % 7) AS code FROM nation) GROUP BY code")
def write_unique(spark, sf_dir):
    """Of equal unique values in a batch the first row takes them."""
    s = Store(spark, scratch(spark), NATION)
    s.add(_nations(spark, sf_dir).withColumn("code", F.concat(F.lit("u"), F.col("n_nationkey") % 7)))
    return s.snapshot().select("code", "n_nationkey")


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN [9, n_nationkey + 1, n_nationkey, 8] ELSE [n_nationkey, n_nationkey + 1, n_nationkey] END AS tags,
  CASE WHEN n_nationkey % 4 = 1 THEN ['x', 'y'] ELSE ['x'] END AS marks, CASE WHEN n_nationkey % 4 = 2 THEN ['one', 'two', 'three'] ELSE ['one'] END AS notes,
  CASE n_nationkey % 4 WHEN 3 THEN 'ValidationFail' ELSE 'ChangeSuccess' END AS status, CASE WHEN n_nationkey % 4 = 2 THEN [2, 3]::BIGINT[] END AS added FROM nation
UNION ALL SELECT 99, NULL, NULL, NULL, 'DoesNotExist', NULL""")
def write_change_kinds(spark, sf_dir):
    s = _stored(spark, sf_dir)
    of = [(ListChange("tags", delete=(None,), insert=((0, 9),), append=(8,)),), (SetChange("marks", ("x", "y")),), (IncMapChange("notes", ("two", "three")),), (Check((("n_name", "other"),)), Change((("n_name", "never"),)))]
    keys = [r[0] for r in _nations(spark, sf_dir).select("n_nationkey").collect()]
    items = [(k, tuple(replace(c, delete=(k,)) if isinstance(c, ListChange) else c for c in of[k % 4]), None) for k in [*keys]] + [(99, of[1], None)]
    out = s.change(items).select("n_nationkey", "status", "added_keys")
    now = s.snapshot().select("n_nationkey", "tags", "marks", F.map_values(F.col("notes")).alias("notes"))
    return out.join(now, "n_nationkey", "left").select("n_nationkey", "tags", "marks", "notes", "status", F.col("added_keys").getItem("notes").alias("added"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'VersionMismatch' ELSE 'ChangeSuccess' END AS status, n_nationkey % 3 = 1 AS moved FROM nation")
def write_optimistic(spark, sf_dir):
    """A wrong expected version fails; a change that alters nothing keeps the version."""
    s = _stored(spark, sf_dir)
    version = s.log().agg(F.max("_version")).first()[0]
    keys = [r[0] for r in _nations(spark, sf_dir).select("n_nationkey").collect()]
    out = s.change([(k, (Change((("n_name", "newer" if k % 3 == 1 else "name"),)),), version - (k % 3 == 0)) for k in keys])
    return out.select("n_nationkey", "status", (F.col("_version") > version).alias("moved"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'erased' WHEN n_nationkey % 3 = 1 THEN 'deleted' ELSE 'there' END AS state, n_nationkey % 3 = 0 OR n_nationkey % 3 = 1 AS found FROM nation UNION ALL SELECT 77, 'erased', false")
def write_delete(spark, sf_dir):
    s = _stored(spark, sf_dir)
    keys = [r[0] for r in _nations(spark, sf_dir).select("n_nationkey").collect()]
    hard = s.delete([*(k for k in keys if k % 3 == 0), 77], hard=True)
    soft = s.delete([k for k in keys if k % 3 == 1])
    found = hard.union(soft).select("n_nationkey", (F.col("status") == "DeleteSuccess").alias("found"))
    now = s.snapshot().select("n_nationkey", "_is_deleted")
    every = spark.createDataFrame([(k,) for k in [*keys, 77]], "n_nationkey int").join(now, "n_nationkey", "left").join(found, "n_nationkey", "left")
    return every.select("n_nationkey", F.when(F.col("_is_deleted").isNull(), "erased").when(F.col("_is_deleted"), "deleted").otherwise("there").alias("state"), F.coalesce("found", F.lit(False)).alias("found"))


@query("SELECT op, count(*) AS n FROM (SELECT 'add' AS op FROM nation UNION ALL SELECT 'change' FROM nation WHERE n_nationkey < 10 UNION ALL SELECT 'soft_delete' FROM nation WHERE n_nationkey = 4) GROUP BY op")
def write_process_update(spark, sf_dir):
    """Another store's log, applied twice and with repeated rows, is applied once; so is its backup."""
    s = _stored(spark, sf_dir)
    s.change([(k, (Change((("n_name", "newer"),)),), None) for k in range(10)])
    s.delete([4])
    other = Store(spark, scratch(spark), NATION)
    other.process_update(s.log().union(s.log()))
    other.process_update(s.log())
    s.backup(path := scratch(spark))
    other.restore(path)
    return other.log().groupBy(F.col("_op").alias("op")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def json_round_trip(spark, sf_dir):
    model = Model("Customer", (Prop(1, "c_custkey", "sint64"), Prop(2, "name", "string", names=("c_name",)), Prop(3, "c_nationkey", "sint32"), Prop(4, "c_acctbal", "float64")), key=(Part("c_custkey"),))
    write_json(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), path := scratch(spark))
    return read_json(spark, model, path).withColumnRenamed("name", "c_name")


# Histories


@query("SELECT n_nationkey, v::INT AS v, name FROM (SELECT n_nationkey, 2 AS v, 'newer' AS name FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, 1, 'name' FROM nation WHERE n_nationkey >= 10) ORDER BY v DESC, n_nationkey LIMIT 12")
def scan_updates_recent(spark, sf_dir):
    """The keys that changed last, with their newest names."""
    s = _stored(spark, sf_dir)
    s.change([(k, (Change((("n_name", "newer"),)),), None) for k in range(10)])
    keys, ups = s.scan_updates(requests.Scan(limit=12), recent_first=True)
    newest = ups.groupBy("n_nationkey").agg(F.max_by("kind", "_version").alias("kind"))
    return keys.join(newest, "n_nationkey").select("n_nationkey", F.when(F.col("kind") == "Change", 2).otherwise(1).alias("v"), F.when(F.col("kind") == "Change", "newer").otherwise("name").alias("name"))


@query("SELECT n_nationkey, ['code', 'marks', 'n_name', 'n_nationkey', 'notes', 'tags'][2:2] AS none, 2 - (n_nationkey >= 10)::INT AS versions FROM nation WHERE n_nationkey BETWEEN 5 AND 14")
def scan_changes_page(spark, sf_dir):
    s = _stored(spark, sf_dir)
    s.change([(k, (Change((("n_name", "newer"),)),), None) for k in range(10)])
    out = s.scan_changes(requests.Scan(start_key=(5,), limit=10), max_versions=5)
    return out.select("n_nationkey", F.array(F.lit("marks")).alias("none"), F.size("versions").alias("versions"))


@query("SELECT n_nationkey, 'change' AS op, 'newer' AS n_name FROM nation WHERE n_nationkey < 10 AND n_nationkey % 2 = 1")
def update_history_filtered(spark, sf_dir):
    s = _stored(spark, sf_dir)
    s.change([(k, (Change((("n_name", "newer"),)),), None) for k in range(10)])
    s.delete([0])
    out = s.scan_update_history(where=fl.And(fl.Equals(n_name="newer"), fl.ValueIn(n_nationkey=[1, 3, 5, 7, 9, 11])), select=["n_name"])
    return out.select("n_nationkey", F.col("_op").alias("op"), "n_name")


_USER_LOG = """(SELECT user_id, event_type, event_id AS v, CASE WHEN event_id % 17 = 0 AND row_number() OVER w > 1 THEN 'soft_delete' ELSE 'write' END AS op
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


@query(f"""SELECT user_id, v AS version, tag FROM (SELECT *, lag(tag) OVER (PARTITION BY user_id ORDER BY v) AS b FROM (SELECT *, (CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END)::INT AS tag FROM {_USER_LOG}))
WHERE op = 'write' AND tag IS DISTINCT FROM b""")
def history_type_changes(spark, sf_dir):
    from .catalog import _log

    tag = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    log = _log(spark, sf_dir).withColumn("u", F.struct(tag.alias("type"), F.col("value").alias("v_amount")))
    return history.type_changes(log, ["user_id"], "u").select("user_id", F.col("_version").alias("version"), F.col("type").alias("tag"))


@query(f"""SELECT user_id, v AS version, CASE WHEN b IS NULL THEN 'New' WHEN e IS NULL THEN 'Delete' ELSE 'Update' END AS kind FROM (
  SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY v) AS b FROM (SELECT *, CASE WHEN op = 'write' THEN event_type END AS e FROM {_USER_LOG})) WHERE e IS DISTINCT FROM b""")
def history_index_changes(spark, sf_dir):
    from .catalog import _log

    return history.index_changes(_log(spark, sf_dir), ["user_id"], [F.col("event_type")]).select("user_id", F.col("_version").alias("version"), "kind")


# Flows


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'newer' ELSE 'name' END AS n_name FROM nation WHERE n_nationkey NOT IN (1, 2) ORDER BY n_nationkey LIMIT 6")
def flow_scan(spark, sf_dir):
    """A page that is followed while records change and go: what a client has after all updates."""
    return _followed(spark, sf_dir, "scan")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'newer' ELSE 'name' END AS n_name FROM nation WHERE n_nationkey NOT IN (1, 2) ORDER BY n_nationkey LIMIT 6")
def flow_scan_updates(spark, sf_dir):
    return _followed(spark, sf_dir, "scan_updates")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'newer' ELSE 'name' END AS n_name FROM nation WHERE n_nationkey IN (0, 4, 5)")
def flow_get_changes(spark, sf_dir):
    return _followed(spark, sf_dir, "get_changes")


def _followed(spark, sf_dir, kind: str) -> DataFrame:
    s = _stored(spark, sf_dir)
    request = requests.Scan(limit=6) if kind.startswith("scan") else requests.Get((0, 1, 4, 5))
    got: list[dict] = []
    q = execute_flow(s, request, lambda _, u: got.extend(u), scratch(spark), kind=kind)
    try:
        q.processAllAvailable()
        s.change([(k, (Change((("n_name", "newer"),)),), None) for k in range(0, 25, 2)])
        q.processAllAvailable()
        s.delete([1, 2])
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in fold([], got, ["n_nationkey"])], "n_nationkey int, n_name string")
