"""Queries over the driver's tables, with their SQL. Each applies operators of this engine to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, text
from .functions.refs import ref
from .functions.values import round_to
from .model import Index, Model, Part, Prop
from .operators import aggregations as ag
from .operators import filters as fl
from .operators.changes import Change, ListChange, apply_all
from .operators.projection import Pick, project
from .plans import history, requests
from .streaming.changelog import changelog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ORDERS = Model(
    "Orders",
    (
        Prop(1, "o_orderkey", "sint64", final=True), Prop(2, "o_custkey", "sint64", final=True), Prop(3, "o_orderstatus", "string"),
        Prop(4, "o_totalprice", "float64"), Prop(5, "o_orderdate", "datetime", final=True), Prop(6, "o_orderpriority", "string"),
    ),
    key=(Part("o_orderkey"),),
    indexes=(Index("price", (Part("o_totalprice"),)), Index("newest", (Part("o_orderdate", "reversed"), Part("o_orderkey"))), Index("customer", (Part("o_custkey"), Part("o_totalprice", "reversed")))),
)
LINEITEM = Model(
    "Lineitem",
    (
        Prop(1, "l_orderkey", "sint64", final=True), Prop(2, "l_linenumber", "sint32", final=True), Prop(3, "l_partkey", "sint64"), Prop(4, "l_suppkey", "sint64"), Prop(5, "l_quantity", "float64"),
        Prop(6, "l_extendedprice", "float64"), Prop(7, "l_discount", "float64"), Prop(8, "l_tax", "float64"), Prop(9, "l_returnflag", "string"), Prop(10, "l_linestatus", "string"), Prop(11, "l_shipdate", "datetime"),
    ),
    key=(Part("l_orderkey"), Part("l_linenumber")),
    indexes=(Index("price", (Part("l_extendedprice"),)), Index("shipped", (Part("l_shipdate", "reversed"),))),
)
DOCUMENTS = Model("Documents", (Prop(1, "doc_id", "sint64"), Prop(2, "text", "string"), Prop(3, "lang", "string"), Prop(4, "source", "string"), Prop(5, "n_chars", "sint64")), key=(Part("doc_id"),), indexes=(Index("words", (Part("text"),), search=True),))
PARTS = Model("Parts", (Prop(1, "p_partkey", "sint64"), Prop(2, "p_name", "string"), Prop(3, "p_brand", "string"), Prop(4, "p_type", "string"), Prop(5, "p_size", "sint32"), Prop(6, "p_retailprice", "float64")), key=(Part("p_partkey"),), indexes=(Index("name", (Part("p_name"), Part("p_type")), search=True),))


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Get, Scan, orders, pages


@query("SELECT k.i::INT AS ordinal, o.o_orderkey, o.o_orderstatus, o.o_totalprice FROM (VALUES (7,0),(999999999,1),(1,2),(32,3),(3,4),(7,5)) k(key,i) JOIN orders o ON o.o_orderkey = k.key")
def get_by_keys(spark, sf_dir):
    r = requests.fetch_get(ORDERS, _t(spark, sf_dir, "orders"), requests.Get((7, 999999999, 1, 32, 3, 7), select=["o_orderkey", "o_orderstatus", "o_totalprice"]))
    return r.rows.withColumnRenamed("__ordinal", "ordinal")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity < 24 AND l_discount >= 0.05 AND l_discount <= 0.07")
def scan_range_and(spark, sf_dir):
    import datetime as dt

    f = fl.And(fl.Range(l_shipdate=fl.Between(dt.datetime(1995, 1, 1), dt.datetime(1996, 1, 1), include_high=False)), fl.LessThan(l_quantity=24.0), fl.GreaterThanEquals(l_discount=0.05), fl.LessThanEquals(l_discount=0.07))
    return project(fl.where(_t(spark, sf_dir, "lineitem"), f), ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"])


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem WHERE (l_returnflag = 'R' OR l_quantity > 45) AND NOT (l_linestatus = 'O' OR l_tax > 0.05)")
def scan_or_not(spark, sf_dir):
    f = fl.And(fl.Or(fl.Equals(l_returnflag="R"), fl.GreaterThan(l_quantity=45.0)), fl.Not(fl.Equals(l_linestatus="O"), fl.GreaterThan(l_tax=0.05)))
    return project(fl.where(_t(spark, sf_dir, "lineitem"), f), ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"])


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 3, 5, 7, 11, 13)")
def scan_value_in(spark, sf_dir):
    return project(fl.where(_t(spark, sf_dir, "customer"), fl.ValueIn(c_mktsegment=["BUILDING", "MACHINERY"], c_nationkey=[1, 3, 5, 7, 11, 13])), ["c_custkey", "c_mktsegment"])


@query("SELECT p_partkey, p_type FROM part WHERE starts_with(p_brand, 'Brand#1') AND starts_with(p_type, 'S')")
def scan_prefix(spark, sf_dir):
    return project(fl.where(_t(spark, sf_dir, "part"), fl.Prefix(p_brand="Brand#1", p_type="S")), ["p_partkey", "p_type"])


@query("SELECT p_partkey, p_brand FROM part WHERE regexp_full_match(p_brand, 'Brand#[1-3]+') AND NOT regexp_full_match(p_brand, 'Brand')")
def scan_regex_full(spark, sf_dir):
    return project(fl.where(_t(spark, sf_dir, "part"), fl.And(fl.RegEx(p_brand="Brand#[1-3]+"), fl.Not(fl.RegEx(p_brand="Brand")))), ["p_partkey", "p_brand"])


@query("SELECT o_orderkey FROM (SELECT *, nullif(o_orderstatus, 'O') AS s FROM orders) WHERE s IS NOT NULL AND o_totalprice >= 1000")
def scan_exists(spark, sf_dir):
    t = _t(spark, sf_dir, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("O")))
    return project(fl.where(t, fl.And(fl.Exists("s"), fl.GreaterThanEquals(o_totalprice=1000.0))), ["o_orderkey"])


@query("SELECT o_orderkey, s FROM (SELECT *, nullif(o_orderstatus, 'O') AS s FROM orders) WHERE s IS DISTINCT FROM 'F'")
def not_over_null(spark, sf_dir):
    t = _t(spark, sf_dir, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("O")))
    return project(fl.where(t, fl.Not(fl.Equals(s="F"))), ["o_orderkey", "s"])


@query("SELECT o_orderkey, s FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s FROM orders) WHERE s IS NOT NULL")
def project_drops_empty(spark, sf_dir):
    t = _t(spark, sf_dir, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("O")))
    return project(t, ["s"], keep=("o_orderkey",))


@query("SELECT o_orderkey, {'st': o_orderstatus} AS o FROM orders WHERE o_orderstatus <> 'P'")
def project_nested(spark, sf_dir):
    t = _t(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("st"), F.col("o_totalprice").alias("pr")).alias("o"))
    return project(t, ["o_orderkey", Pick("o", ("st",))])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC LIMIT 100")
def scan_top_k(spark, sf_dir):
    r = requests.Scan(order=(requests.Order("l_extendedprice", True),), select=["l_orderkey", "l_linenumber", "l_extendedprice"])
    return requests.fetch_scan(LINEITEM, _t(spark, sf_dir, "lineitem"), r).rows


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 500")
def scan_order_desc_ties(spark, sf_dir):
    r = requests.Scan(order=(requests.Order("l_shipdate", True),), limit=500, select=["l_orderkey", "l_linenumber", "l_shipdate"])
    return requests.fetch_scan(LINEITEM, _t(spark, sf_dir, "lineitem"), r).rows


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 37 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def scan_index_fixed_part(spark, sf_dir):
    r = requests.Scan(where=fl.Equals(o_custkey=37), order=(requests.Order("o_totalprice", True),), limit=20, select=["o_orderkey", "o_custkey", "o_totalprice"])
    return requests.fetch_scan(ORDERS, _t(spark, sf_dir, "orders"), r).rows


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 50")
def scan_page_cursor(spark, sf_dir):
    from dataclasses import replace

    t = _t(spark, sf_dir, "orders")
    r = requests.Scan(order=(requests.Order("o_totalprice"),), limit=50, select=["o_orderkey", "o_totalprice"])
    token = requests.fetch_scan(ORDERS, t, r).next_cursor()
    return requests.fetch_scan(ORDERS, t, replace(r, cursor=token)).rows


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 100")
def scan_start_key(spark, sf_dir):
    r = requests.Scan(start_key=(100,), include_start=False, select=["o_orderkey", "o_custkey"])
    return requests.fetch_scan(ORDERS, _t(spark, sf_dir, "orders"), r).rows


@query("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'bolt') OR starts_with(p_name, 'r') OR p_name LIKE '% r%'")
def scan_any_element(spark, sf_dir):
    t = _t(spark, sf_dir, "part").withColumn("words", F.split("p_name", " "))
    f = fl.Or(fl.Equals((ref("words").any(), "bolt")), fl.Prefix((ref("words").any(), "r")))
    return project(fl.where(t, f), ["p_partkey", "p_name"])


@query("SELECT p_partkey FROM part WHERE p_size > 20 AND string_split(p_name, ' ')[2] >= 'g'")
def scan_map_and_item_refs(spark, sf_dir):
    t = _t(spark, sf_dir, "part").withColumns({"words": F.split("p_name", " "), "m": F.create_map(F.lit("size"), F.col("p_size"), F.lit("key"), F.lit(1))})
    f = fl.And(fl.GreaterThan((ref("m").key("size"), 20)), fl.Exists(ref("m").has_key("key")), fl.GreaterThanEquals((ref("words").item(1), "g")), fl.Equals((ref("m").any_key(), "size")), fl.LessThan((ref("m").any_value(), 2)))
    return project(fl.where(t, f), ["p_partkey"])


@query("SELECT entry, p_partkey FROM (SELECT p_partkey, min(w) AS entry FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE starts_with(w, 'b') GROUP BY p_partkey) ORDER BY entry, p_partkey LIMIT 200")
def scan_any_value_index(spark, sf_dir):
    t = _t(spark, sf_dir, "part")
    return requests.scan_index_any(t, ["p_partkey"], F.split("p_name", " "), "b", limit=200).select(F.col("__entry").alias("entry"), "p_partkey")


@query("SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.4)) > 0")
def scan_any_in_vector(spark, sf_dir):
    return project(fl.where(_t(spark, sf_dir, "embeddings"), fl.GreaterThan((ref("embedding").any(), 0.4))), ["vec_id"])


@query("SELECT event_id, u.t::INT AS tag FROM (SELECT event_id, {'t': CASE event_type WHEN 'purchase' THEN 1 ELSE 2 END} AS u, value FROM events) WHERE u.t = 1 AND value > 10")
def scan_typed_union(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    tag = F.when(F.col("event_type") == "purchase", 1).otherwise(2)
    t = e.withColumn("u", F.struct(tag.alias("type"), F.when(tag == 1, F.col("value")).alias("v_amount"), F.when(tag == 2, F.col("event_type")).alias("v_name")))
    return fl.where(t, fl.GreaterThan((ref("u").typed(1, "amount"), 10.0))).select("event_id", ref("u").type().value().alias("tag"))


# Joins


@query("SELECT o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_name IN ('FRANCE', 'GERMANY', 'NATION_3', 'NATION_7') OR c.c_acctbal < 0")
def fk_hop_filter(spark, sf_dir):
    customer = ref("o_custkey").hop("customer", _t(spark, sf_dir, "customer"), "c_custkey")
    nation = customer.field("c_nationkey").hop("nation", _t(spark, sf_dir, "nation"), "n_nationkey")
    f = fl.Or(fl.ValueIn((nation.field("n_name"), ["FRANCE", "GERMANY", "NATION_3", "NATION_7"])), fl.LessThan((customer.field("c_acctbal"), 0.0)))
    return project(fl.where(_t(spark, sf_dir, "orders"), f), ["o_orderkey"])


@query("SELECT o_orderkey FROM orders o LEFT JOIN customer c ON nullif(o.o_custkey, 7) = c.c_custkey WHERE NOT coalesce(c.c_mktsegment = 'BUILDING', false)")
def fk_hop_not_dangling(spark, sf_dir):
    t = _t(spark, sf_dir, "orders").withColumn("fk", F.nullif("o_custkey", F.lit(7).cast("long")))
    segment = ref("fk").hop("customer", _t(spark, sf_dir, "customer"), "c_custkey").field("c_mktsegment")
    return project(fl.where(t, fl.Not(fl.Equals((segment, "BUILDING")))), ["o_orderkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def collect_inject(spark, sf_dir):
    first = fl.where(_t(spark, sf_dir, "orders"), fl.GreaterThan(o_totalprice=200000.0))
    return project(requests.collect_inject(first, F.col("o_custkey"), _t(spark, sf_dir, "customer"), "c_custkey"), ["c_custkey", "c_name"])


# Aggregations


@query("SELECT round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS average, count(l_quantity) AS n, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem WHERE l_returnflag = 'R'")
def agg_stats(spark, sf_dir):
    page = fl.where(_t(spark, sf_dir, "lineitem"), fl.Equals(l_returnflag="R"))
    s = ag.aggregate(page, {"s": ag.Stats("l_quantity")}).select("s.*")
    return s.select(F.round("sum", 2).alias("total"), F.round("average", 6).alias("average"), F.col("count").alias("n"), F.col("min").alias("least"), F.col("max").alias("most"))


@query("SELECT (sum(p_size) // count(p_size))::INT AS average, trunc(-sum(p_size) / count(p_size))::INT AS below, sum(p_size)::INT AS total FROM part")
def agg_int_average_truncates(spark, sf_dir):
    t = _t(spark, sf_dir, "part").withColumn("minus", -F.col("p_size"))
    return ag.aggregate(t, {"average": ag.Average("p_size", "sint32"), "below": ag.Average("minus", "sint32"), "total": ag.Sum("p_size", "sint32")})


@query("SELECT (((sum(p_size) % 256) + 256) % 256)::SMALLINT AS u8, (((sum(p_size) + 128) % 256 + 256) % 256 - 128)::TINYINT AS s8 FROM part")
def agg_sum_wraps(spark, sf_dir):
    return ag.aggregate(_t(spark, sf_dir, "part"), {"u8": ag.Sum("p_size", "uint8"), "s8": ag.Sum("p_size", "sint8")})


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100)")
def agg_page_scoped(spark, sf_dir):
    r = requests.Scan(order=(requests.Order("o_totalprice", True),), aggregations={"n": ag.ValueCount("o_orderkey"), "total": ag.Sum("o_totalprice")}, select=["o_orderkey"])
    return requests.fetch_scan(ORDERS, _t(spark, sf_dir, "orders"), r).aggregations.select("n", F.round("total", 2).alias("total"))


@query("SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_totalprice < -1 HAVING count(*) > 0")
def agg_empty_no_row(spark, sf_dir):
    page = fl.where(_t(spark, sf_dir, "orders"), fl.LessThan(o_totalprice=-1.0))
    return ag.aggregate(page, {"n": ag.ValueCount("o_orderkey"), "total": ag.Sum("o_totalprice")})


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS count, round(sum(l_quantity), 2) AS total, round(avg(l_extendedprice), 4) AS average, min(l_discount) AS least, max(l_discount) AS most FROM lineitem GROUP BY 1, 2")
def bucket_enum_nested(spark, sf_dir):
    inner = ag.EnumValues("l_linestatus", aggs={"total": ag.Sum("l_quantity"), "average": ag.Average("l_extendedprice"), "least": ag.Min("l_discount"), "most": ag.Max("l_discount")})
    out = ag.aggregate(_t(spark, sf_dir, "lineitem"), {"flags": ag.EnumValues("l_returnflag", aggs={"statuses": inner})})
    rows = out.select(F.explode("flags").alias("f")).select(F.col("f.key").alias("flag"), F.explode("f.statuses").alias("s"))
    return rows.select("flag", F.col("s.key").alias("status"), F.col("s.count").alias("count"), F.round("s.total", 2).alias("total"), F.round("s.average", 4).alias("average"), F.col("s.least").alias("least"), F.col("s.most").alias("most"))


@query("SELECT CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END::INT AS tag, count(*) AS count, round(sum(value), 2) AS total FROM events GROUP BY 1")
def bucket_types(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    t = e.withColumn("u", F.struct(F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).otherwise(3).alias("type")))
    out = ag.aggregate(t, {"types": ag.Types("u", aggs={"total": ag.Sum("value")})})
    return out.select(F.explode("types").alias("x")).select(F.col("x.key").alias("tag"), F.col("x.count").alias("count"), F.round("x.total", 2).alias("total"))


def _histogram(unit: str, table: str, column: str, value: str):
    def run(spark, sf_dir):
        a = ag.DateHistogram(column, "datetime", {"total": ag.Sum(value)}, unit)
        return ag.bucket_rows(_t(spark, sf_dir, table), [("bucket", a)]).select("bucket", "count", F.round("total", 2).alias("total"))

    run.__name__ = f"hist_{unit}"
    trunc = {"minutes": "minute", "hours": "hour", "days": "day", "months": "month", "quarters": "quarter", "years": "year", "decades": "decade", "seconds": "second", "millis": "millisecond"}.get(unit)
    bucket = f"date_trunc('{trunc}', {column})::TIMESTAMP" if trunc else f"make_timestamp(year({column}) - year({column}) % {dict(centuries=100, millennia=1000)[unit]}, 1, 1, 0, 0, 0.0)"
    return query(f"SELECT {bucket} AS bucket, count(*) AS count, round(sum({value}), 2) AS total FROM {table} GROUP BY 1")(run)


for _u in ("months", "quarters", "years", "decades", "centuries", "millennia", "days"):
    _histogram(_u, "orders", "o_orderdate", "o_totalprice")
for _u in ("hours", "minutes", "seconds", "millis"):
    _histogram(_u, "events", "ts", "value")


# Search


@query("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name || ' ' || lower(p_type), ' '), 'bolt') AND p_type = 'SMALL'")
def search_matches(spark, sf_dir):
    return project(fl.where(_t(spark, sf_dir, "part"), fl.Matches(name="small-BOLT"), requests.context(PARTS)).where("p_type = 'SMALL'"), ["p_partkey", "p_name"])


@query("SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name || ' ' || lower(p_type), ' '), lambda x: starts_with(x, 'sm'))) > 0 AND len(list_filter(string_split(p_name || ' ' || lower(p_type), ' '), lambda x: starts_with(x, 'g'))) > 0")
def search_prefix(spark, sf_dir):
    return project(fl.where(_t(spark, sf_dir, "part"), fl.MatchesPrefix(name="Sm G"), requests.context(PARTS)), ["p_partkey"])


@query("SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name || ' ' || lower(p_type), ' '), lambda x: regexp_full_match(x, 'b.*t'))) > 0")
def search_regex(spark, sf_dir):
    return project(fl.where(_t(spark, sf_dir, "part"), fl.MatchesRegEx(name="b.*t"), requests.context(PARTS)), ["p_partkey"])


@query(r"""SELECT doc_id FROM documents WHERE lang = 'en' AND regexp_matches(text, '(?i)(^|[\s\p{Z}\-‐-—])[\p{M}\p{Z}\p{P}\p{S}]*t[\p{M}\p{P}\p{S}]*h[\p{M}\p{P}\p{S}]*i[\p{M}\p{P}\p{S}]*s[\p{M}\p{P}\p{S}]*($|[\s\p{Z}\-‐-—])')""")
def search_documents(spark, sf_dir):
    return project(fl.where(_t(spark, sf_dir, "documents"), fl.And(fl.Equals(lang="en"), fl.Matches(words="This")), requests.context(DOCUMENTS)), ["doc_id"])


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\\s\\p{Z}\\-‐-—]+'), lambda x: x <> ''))::INT AS n FROM documents")
def transform_split(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(text.split(F.col("text"))).alias("n"))


# Geography: points derived from ids

_POINTS = "(SELECT c_custkey, (c_custkey * 37 % 180 - 90)::DOUBLE AS lat, (c_custkey * 73 % 360 - 180)::DOUBLE AS lon FROM customer)"


def _points(spark, sf_dir):
    k = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select("c_custkey", F.struct((k * 37 % 180 - 90).cast("double").alias("lat"), (k * 73 % 360 - 180).cast("double").alias("lon")).alias("p"))


@query(f"SELECT c_custkey FROM {_POINTS} WHERE lat BETWEEN -30 AND 40 AND (lon >= 150 OR lon <= -120)")
def geo_box_antimeridian(spark, sf_dir):
    return project(fl.where(_points(spark, sf_dir), fl.GeoWithinBox("p", -30.0, 150.0, 40.0, -120.0)), ["c_custkey"])


@query(f"SELECT c_custkey FROM (SELECT *, pow(sin(radians(lat - 48.85) / 2), 2) + cos(radians(lat)) * cos(radians(48.85)) * pow(sin(radians(lon - 2.35) / 2), 2) AS h FROM {_POINTS}) WHERE 2 * 6371008.8 * atan2(sqrt(h), sqrt(greatest(0, 1 - h))) <= 3000000")
def geo_radius(spark, sf_dir):
    return project(fl.where(_points(spark, sf_dir), fl.GeoWithinRadius("p", 48.85, 2.35, 3_000_000.0)), ["c_custkey"])


@query(f"SELECT c_custkey FROM {_POINTS} WHERE lat >= 0 AND lat <= 50 AND lon >= -60 AND lon <= 60 - lat")
def geo_polygon(spark, sf_dir):
    ring = [(0.0, -60.0), (0.0, 60.0), (50.0, 10.0), (50.0, -60.0)]
    return project(fl.where(_points(spark, sf_dir), fl.GeoWithinPolygon("p", ring)), ["c_custkey"])


@query(f"SELECT c_custkey, (SELECT sum(((x >> i) & 1) << (2 * i + 1)) + sum(((y >> i) & 1) << (2 * i)) FROM range(8) t(i))::BIGINT AS cell FROM (SELECT c_custkey, least(floor((lon + 180) / 360 * 256), 255)::BIGINT AS x, least(floor((lat + 90) / 180 * 256), 255)::BIGINT AS y FROM {_POINTS})")
def geo_hash(spark, sf_dir):
    return _points(spark, sf_dir).select("c_custkey", geo.geohash(F.col("p.lat"), F.col("p.lon"), 16).alias("cell"))


# Versions: events of a user are the writes of its record

_LOG = """(SELECT user_id, event_type, value, event_id AS v,
  CASE WHEN event_id % 17 = 0 AND row_number() OVER w > 1 THEN 'soft_delete' WHEN row_number() OVER w = 1 THEN 'add' ELSE 'change' END AS op
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


def _log(spark, sf_dir):
    """The first event of a user is found by one aggregation, not by numbering its events."""
    e = _t(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    first = e.groupBy(F.col("user_id").alias("u")).agg(F.min("event_id").alias("f"))
    e = e.join(first, e["user_id"] == first["u"]).drop("u")
    is_first = F.col("event_id") == F.col("f")
    return changelog(e, F.col("event_id"), is_first, (F.col("event_id") % 17 == 0) & ~is_first).drop("event_id", "f")


@query(f"SELECT user_id, arg_max(event_type, v) AS event_type, arg_max(value, v) AS value, min(v) AS first_version, max(v) AS last_version, arg_max(op, v) = 'soft_delete' AS deleted FROM {_LOG} WHERE v <= (SELECT max(event_id) // 2 FROM events) GROUP BY 1")
def as_of_version(spark, sf_dir):
    top = _t(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] // 2
    out = history.as_of(_log(spark, sf_dir), ["user_id"], top)
    return out.select("user_id", "event_type", "value", F.col("_first_version").alias("first_version"), F.col("_last_version").alias("last_version"), F.col("_is_deleted").alias("deleted"))


@query(f"SELECT user_id, event_type FROM (SELECT user_id, arg_max(event_type, v) AS event_type, arg_max(op, v) AS op FROM {_LOG} GROUP BY 1) WHERE op <> 'soft_delete'")
def soft_deleted(spark, sf_dir):
    return history.as_of(_log(spark, sf_dir), ["user_id"]).where("not _is_deleted").select("user_id", "event_type")


@query(f"""SELECT user_id, v AS version, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC) AS r FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY v) AS b FROM {_LOG}) WHERE op <> 'soft_delete' AND (op = 'add' OR event_type IS DISTINCT FROM b)) WHERE r <= 2""")
def changes_max_versions(spark, sf_dir):
    cells = history.cell_changes(_log(spark, sf_dir), ["user_id"], max_versions=2)
    return cells.where("path = 'event_type'").select("user_id", F.col("_version").alias("version"), F.get_json_object("value", "$.v").alias("event_type"))


@query(f"""SELECT user_id, v AS version, CASE op WHEN 'add' THEN 'Addition' WHEN 'change' THEN 'Change' ELSE 'Removal' END AS kind FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id, op = 'add' ORDER BY v DESC) AS r FROM {_LOG}) WHERE op = 'add' OR r <= 3""")
def updates_max_versions(spark, sf_dir):
    return history.updates(_log(spark, sf_dir), ["user_id"], max_versions=3).select("user_id", F.col("_version").alias("version"), "kind")


@query(f"SELECT user_id, v AS version, op FROM {_LOG} ORDER BY v DESC LIMIT 100")
def update_history(spark, sf_dir):
    return history.update_history(_log(spark, sf_dir), 100).select("user_id", F.col("_version").alias("version"), F.col("_op").alias("op"))


@query("""WITH n AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 50000), k AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)
SELECT o_orderkey, 'Removal' AS kind, 'NotInRange' AS reason FROM k WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)
UNION ALL SELECT o_orderkey, 'Addition', NULL FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM k)""")
def ordered_keys_diff(spark, sf_dir):
    t = _t(spark, sf_dir, "orders")
    log = t.select("o_orderkey", F.lit(1).cast("long").alias("_version"), F.lit(history.ADD).alias("_op"))
    return history.ordered_keys_diff(fl.where(t, fl.GreaterThan(o_totalprice=50000.0)), log, t.where("o_orderkey % 2 = 0"), "o_orderkey")


# Changes and transforms


@query("""SELECT p_partkey, CASE WHEN list_position(w, 'STEEL') > 0 THEN list_concat(list_slice(w, 1, list_position(w, 'STEEL') - 1), list_slice(w, list_position(w, 'STEEL') + 1, len(w))) ELSE w END || ['NEW'] AS words, 'changed' AS p_brand
FROM (SELECT p_partkey, string_split(p_type, ' ') || ['STEEL'] AS w FROM part)""")
def change_list(spark, sf_dir):
    t = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat(F.split("p_type", " "), F.array(F.lit("STEEL"))).alias("words"))
    after, _ = apply_all((Change((("p_brand", "changed"),)), ListChange("words", delete=("STEEL",), append=("NEW",))), {"words": F.col("words"), "p_brand": F.col("p_brand")}, t.schema)
    return t.select("p_partkey", *[c.alias(n) for n, c in after.items()])


@query("SELECT DISTINCT make_date(year(o_orderdate) - year(o_orderdate) % 10, 1, 1) AS decade, date_trunc('quarter', o_orderdate)::DATE AS quarter FROM orders")
def transform_round_date(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return _t(spark, sf_dir, "orders").select(round_to(d, "decades", "date").alias("decade"), round_to(d, "quarters", "date").alias("quarter")).distinct()


from . import catalog_store  # noqa: E402  (it uses the changelog of events above)

QUERIES |= catalog_store.QUERIES
ORACLE_SQL |= catalog_store.ORACLE_SQL
