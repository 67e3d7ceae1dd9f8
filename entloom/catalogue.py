"""Registered queries over the driver's tables, each with its DuckDB equivalent.

Every query runs over whole tables: through the library's operators, or as plain DataFrame calls where Spark has the operation itself.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entloom.entity import Entity, Rule, entity
from entloom.functions import transforms as tr
from entloom.functions.keys import content_id, input_hash
from entloom.operators.intervals import asof_join, overlap_join, range_totals
from entloom.operators.loading import keep_last, merged, spread, unseen, update, upsert, validate
from entloom.operators.numbering import number_rows, running_sum
from entloom.operators.relational import Desc, join_many, join_reference, ordered_list, project, row_count
from entloom.plans import codec
from entloom.plans.model import Load, Out, Pipeline, Query, Selection, Step
from entloom.plans.runlog import VIEWS
from entloom.plans.runner import Options, Runner
from entloom.sources.files import Connection, database_partitioned, write_database
from entloom.sources.scratch import shared_dir, stored
from entloom.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query, by its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def work_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share."""
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


def md5_id(*cols: str) -> str:
    """The SQL of `content_id`."""
    parts = ", ".join(f"CASE WHEN {c} IS NULL THEN 'N' ELSE concat('V', length(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)) END" for c in cols)
    return f"regexp_replace(md5(concat_ws('|', {parts})), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


# -- projection and filters ------------------------------------------------------------


@query("SELECT n_nationkey AS id, n_name AS label, n_regionkey AS region FROM nation")
def project_label(spark, sf_dir):
    return project(table(spark, sf_dir, "nation"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("region"))


@query("SELECT t.* FROM region AS t")
def whole_entity_alias(spark, sf_dir):
    return table(spark, sf_dir, "region").alias("t").select("t.*")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND (o_totalprice > 1000 OR o_custkey IS NULL) AND o_custkey <> 7")
def filter_eq_in(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "orders").where((c("o_orderstatus") == "F") & c("o_orderpriority").isin("1-URGENT", "2-HIGH") & ((c("o_totalprice") > 1000) | c("o_custkey").isNull()) & (c("o_custkey") != 7))
    return project(rows, "o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) - INTERVAL 30 DAY FROM orders)")
def scalar_subquery_max(spark, sf_dir):
    return spark.sql(
        "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_orderdate > (SELECT max(o_orderdate) - make_dt_interval(:days) FROM {orders})",
        args={"days": 30},
        orders=table(spark, sf_dir, "orders"),
    )


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def order_limit(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_custkey", "o_totalprice")


# -- joins -------------------------------------------------------------------------------


@query("SELECT c.c_custkey, o.o_orderkey, l.l_linenumber, l.l_partkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING'")
def fk_join_chain(spark, sf_dir):
    c, o, x = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    rows = c.where("c_mktsegment = 'BUILDING'").join(o, o.o_custkey == c.c_custkey).join(x, x.l_orderkey == o.o_orderkey)
    return project(rows, "c_custkey", "o_orderkey", "l_linenumber", "l_partkey")


@query("SELECT c.c_custkey, coalesce(CAST(o.o_orderkey AS VARCHAR), 'never run') AS last_order FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'")
def left_join_coalesce(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    rows = c.join(o, (o.o_custkey == c.c_custkey) & (o.o_orderstatus == "P"), "left")
    return project(rows, "c_custkey", F.coalesce(F.col("o_orderkey").cast("string"), F.lit("never run")).alias("last_order"))


@query("SELECT a.r_name AS left_name, b.r_name AS right_name FROM region a CROSS JOIN region b")
def cross_join(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    return r.select(F.col("r_name").alias("left_name")).crossJoin(r.select(F.col("r_name").alias("right_name")))


@query("SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def anti_join(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)")
def semi_join(spark, sf_dir):
    o, x = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_quantity > 49")
    return o.join(x, o.o_orderkey == x.l_orderkey, "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT n.n_name AS nation, s.s_suppkey AS supplier FROM nation n FULL JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000")
def full_join(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    rows = n.join(s, (s.s_nationkey == n.n_nationkey) & (s.s_acctbal > 5000), "full")
    return project(rows, F.col("n_name").alias("nation"), F.col("s_suppkey").alias("supplier"))


@query("SELECT DISTINCT c.c_custkey AS customer, p.p_partkey AS part FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey WHERE p.p_size > 40")
def link_table_join(spark, sf_dir):
    """Customers and parts, many to many, through a link table that refers to both by hash."""
    registry: dict = {}
    customer = entity("customer", {"custkey": "int8"}, ["custkey"], registry=registry)
    part = entity("part", {"partkey": "int8"}, ["partkey"], registry=registry)
    bought = entity("bought", {}, ["customer_id", "part_id"], {"customer_id": customer, "part_id": part}, registry=registry)
    c = table(spark, sf_dir, "customer").select(customer.key({"custkey": F.col("c_custkey")}).alias("id"), "c_custkey")
    p = table(spark, sf_dir, "part").where("p_size > 40").select(part.key({"partkey": F.col("p_partkey")}).alias("id"), "p_partkey")
    sold = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    link = sold.select(customer.key({"custkey": F.col("o_custkey")}).alias("customer_id"), part.key({"partkey": F.col("l_partkey")}).alias("part_id")).distinct()
    return project(join_many(c, customer, link, bought, p, part), F.col("c_custkey").alias("customer"), F.col("p_partkey").alias("part"))


@query(
    "WITH e AS (SELECT event_id AS seen_id, user_id AS seen_user, max(ts) AS seen_ts FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY event_id, user_id), "
    "l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = (SELECT max(event_type) FROM events)) "
    "SELECT l.event_id, l.user_id, e.seen_id, epoch_us(l.ts) - epoch_us(e.seen_ts) AS micros FROM l ASOF LEFT JOIN e ON l.user_id = e.seen_user AND l.ts > e.seen_ts"
)
def asof_last_event(spark, sf_dir):
    """For each event of one type the user's last event of another type before it."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    kinds = events.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi")).first()
    left = events.where(F.col("event_type") == kinds["hi"]).drop("event_type")
    right = events.where(F.col("event_type") == kinds["lo"]).select(F.col("event_id").alias("seen_id"), F.col("user_id").alias("seen_user"), F.col("ts").alias("seen_ts"))
    rows = asof_join(left, right, ("ts", "seen_ts"), [("user_id", "seen_user")], ties=["seen_id"], equal=False)
    micros = ((F.col("ts") - F.col("seen_ts")).cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")
    return rows.select("event_id", "user_id", "seen_id", micros.alias("micros"))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o.latest FROM lineitem l ASOF LEFT JOIN (SELECT o_orderdate AS day, max(o_orderkey) AS latest FROM orders GROUP BY 1) o ON l.l_shipdate >= o.day"
)
def asof_last_order(spark, sf_dir):
    """The last order placed up to each line's shipping: one group, which is dealt into ranges of time."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("latest"), F.col("o_orderdate").alias("day"))
    return asof_join(lines, orders, ("l_shipdate", "day"), ties=["latest"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "latest")


@query("SELECT p.p_partkey, count(*) AS n, CAST(sum(c.c_custkey) AS BIGINT) AS keys FROM part p JOIN customer c ON c.c_acctbal BETWEEN p.p_retailprice - p.p_size AND p.p_retailprice + p.p_size GROUP BY p.p_partkey")
def range_join_prices(spark, sf_dir):
    """Balances within a band around each part's price; bands differ in width."""
    points = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    price, size = F.col("p_retailprice"), F.col("p_size")
    bands = table(spark, sf_dir, "part").select("p_partkey", (price - size).alias("lo"), (price + size).alias("hi"))
    return range_totals(points, bands, "c_acctbal", "lo", "hi", "p_partkey", "c_custkey").withColumnRenamed("total", "keys")


@query(
    "SELECT a.o_orderkey AS one, b.o_orderkey AS two FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey "
    "AND a.o_orderdate <= b.o_orderdate + to_days(CAST(b.o_orderkey % 90 AS INTEGER)) AND b.o_orderdate <= a.o_orderdate + to_days(CAST(a.o_orderkey % 90 AS INTEGER))"
)
def overlapping_orders(spark, sf_dir):
    """Pairs of a customer's orders whose times overlap, each lasting a number of days of its own."""
    rows = table(spark, sf_dir, "orders")
    until = F.col("o_orderdate") + F.make_dt_interval(F.col("o_orderkey") % 90)
    one, two = (rows.select(F.col("o_orderkey").alias(n), F.col("o_custkey").alias(f"{n}_by"), F.col("o_orderdate").alias(f"{n}_from"), until.alias(f"{n}_to")) for n in ("one", "two"))
    return overlap_join(one, two, ("one_from", "one_to"), ("two_from", "two_to"), [("one_by", "two_by")]).where("one < two").select("one", "two")


# -- aggregates and windows ---------------------------------------------------------------


@query("SELECT o_custkey, count(o_orderkey) AS n_orders, max(o_orderdate) AS last_date FROM orders GROUP BY o_custkey HAVING count(o_orderkey) > 1 ORDER BY n_orders DESC, o_custkey")
def group_having_order(spark, sf_dir):
    groups = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n_orders"), F.max("o_orderdate").alias("last_date"))
    return groups.where("n_orders > 1").orderBy(F.desc("n_orders"), "o_custkey")


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS order_list FROM orders GROUP BY o_custkey")
def ordered_array_agg(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey").cast("string"))
    return rows.groupBy("o_custkey").agg(F.array_join(ordered_list("k", F.col("o_orderdate"), F.col("o_orderkey")), ",").alias("order_list"))


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_totalprice DESC, o_orderkey) AS order_list FROM orders GROUP BY o_custkey")
def ordered_array_agg_desc(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey").cast("string"))
    return rows.groupBy("o_custkey").agg(F.array_join(ordered_list("k", Desc(F.col("o_totalprice")), F.col("o_orderkey")), ",").alias("order_list"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS total, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS mean FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(spark, sf_dir):
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").groupingSets([("l_returnflag", "l_linestatus"), ("l_returnflag",), ()], "l_returnflag", "l_linestatus")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min(q).alias("least"), F.max(q).alias("most"), F.sum(q.cast("decimal(18,2)")).cast("double").alias("total"), F.round(F.avg(q.cast("double")), 6).alias("mean"))


@query("SELECT o_orderkey, rank() OVER w AS place, lag(o_orderkey) OVER w AS before, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS near FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_ranks(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("place"), F.lag("o_orderkey").over(w).alias("before"), F.count(F.lit(1)).over(w.rowsBetween(-1, 0)).alias("near"))


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_name) AS number FROM nation")
def row_numbers(spark, sf_dir):
    """A number for every row of a table of bounded size: the window is one task."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.row_number().over(Window.orderBy("n_name")).cast("long").alias("number"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS number FROM orders")
def row_numbers_all(spark, sf_dir):
    """A number for every row of a table of any size."""
    return number_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "number")


@query(
    "SELECT event_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY event_type) AS n, "
    "CAST(sum(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)"
)
def row_numbers_grouped(spark, sf_dir):
    """Numbers and running sums within few large groups."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    placed = number_rows(events, [F.desc("ts"), F.desc("event_id")], ["event_type"], "place", "n")
    return running_sum(placed, "event_id", ["ts", "event_id"], ["event_type"]).select("event_id", "place", "n", "running")


@query("SELECT DISTINCT event_type, max(ts) AS last_ts FROM events GROUP BY event_type")
def distinct_max(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("last_ts")).distinct()


@query("SELECT o_orderstatus, count(*) AS n, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS state FROM orders GROUP BY o_orderstatus")
def status_counts(spark, sf_dir):
    groups = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return groups.withColumn("state", F.when(F.col("o_orderstatus") == "F", "done").otherwise("open"))


@query("SELECT event_type, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type")
def runtime_share(spark, sf_dir):
    groups = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return groups.select("event_type", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).cast("double").alias("share"))


@query("SELECT count(1) AS n FROM (SELECT * FROM lineitem WHERE l_quantity > 10) x")
def query_count(spark, sf_dir):
    return row_count(table(spark, sf_dir, "lineitem").where("l_quantity > 10"))


@query("SELECT c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_name AS name, 'supplier' AS kind FROM supplier")
def union_all(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind")))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    both = a.intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))
    return both.subtract(table(spark, sf_dir, "nation").where("n_regionkey = 0").select("n_nationkey"))


# -- keys and loads --------------------------------------------------------------------------


@query(f"SELECT c_custkey, {md5_id('c_custkey', 'c_mktsegment')} AS id FROM customer")
def content_hash_id(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", content_id(F.col("c_custkey"), F.col("c_mktsegment")).alias("id"))


@query("SELECT event_id, " + md5_id("strftime(make_timestamp(epoch_us(ts)), '%Y-%m-%d %H:%M:%S.%f')") + " AS id FROM events")
def instant_hash_id(spark, sf_dir):
    """An instant's id is the same in every session time zone."""
    return table(spark, sf_dir, "events").select("event_id", content_id(F.col("ts").cast("timestamp")).alias("id"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return keep_last(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1"
)
def key_collapse(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    return keep_last(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"]).drop("l_shipdate")


_LAST = "SELECT user_id, event_id, event_type, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_id % 2 = {}) WHERE rn = 1"


@query(
    f"SELECT coalesce(o.user_id, n.user_id) AS id, CASE WHEN n.user_id IS NOT NULL THEN n.event_type ELSE o.event_type END AS event_type, o.value AS value, "
    f"CASE WHEN n.user_id IS NOT NULL THEN n.event_id ELSE o.event_id END AS event_id FROM ({_LAST.format(0)}) o FULL JOIN ({_LAST.format(1)}) n ON o.user_id = n.user_id"
)
def upsert_merge(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "id").select("id", "event_type", "value", "event_id")
    old, new = (keep_last(events.where(F.col("event_id") % 2 == k), ["id"], ["event_id"]) for k in (0, 1))
    return upsert(old.select("id", "event_type", "value", "event_id"), new, ["event_type", "event_id"])


@query(
    f"SELECT {md5_id('c_custkey')} AS id, c_custkey AS custkey, CASE WHEN c_custkey % 100 = 7 THEN 'changed' ELSE c_mktsegment END AS segment, c_acctbal AS balance FROM customer "
    f"UNION ALL SELECT {md5_id('-1 - s_suppkey')}, -1 - s_suppkey, 'new', NULL FROM supplier"
)
def bucketed_upsert(spark, sf_dir):
    """Two loads into a keyed table: all customers, then a hundredth of them changed and suppliers added. Each rewrites the buckets it touches."""
    e = entity("customer", {"custkey": "int8", "segment": "text", "balance": "float8"}, ["custkey"], registry={})
    store = Store(spark, work_folder(spark), bucket_rows=200)

    def load(rows, *supplied):
        new = stored(rows.withColumn("id", e.key({"custkey": F.col("custkey")})), "new")
        store.merge(e.full_name, e.struct, new, lambda old, fresh: merged(old, fresh, supplied))

    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    load(customers, "custkey", "segment", "balance")
    load(customers.where("custkey % 100 = 7").select("custkey", F.lit("changed").alias("segment")), "custkey", "segment")
    load(table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("custkey"), F.lit("new").alias("segment")), "custkey", "segment")
    return store.read(e.full_name, e.struct).select("id", "custkey", "segment", "balance")


@query("SELECT c.c_custkey AS id, CASE WHEN o.n IS NOT NULL THEN 'ordered' ELSE c.c_mktsegment END AS segment FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o.o_custkey = c.c_custkey")
def update_existing_only(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).distinct()
    stranger = spark.createDataFrame([(-1,)], "id long")
    return update(old, seen.unionByName(stranger).withColumn("segment", F.lit("ordered")), ["segment"])


@query(f"SELECT o.o_orderkey, {md5_id('o.o_custkey')} AS customer_id FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey")
def lookup_fk_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", content_id(F.col("o_custkey")).alias("customer_id"))


@query("SELECT doc_id, lang, unnest(string_split(text, ' ')) AS word FROM documents")
def broadcast_explode(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array("lang").alias("lang"), F.split("text", " ", -1).alias("word"))
    return spread(rows, ["lang", "word"], ["doc_id"])


@query("SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{4,}')) AS number FROM documents")
def empty_list_drops_row(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("([0-9]{4,})")).alias("number"))
    return spread(rows, ["number"], ["doc_id"])


# -- transforms -----------------------------------------------------------------------------------


@query("SELECT l_orderkey, array_to_string(list_transform(list(l_linenumber * 10 + 1 ORDER BY l_linenumber, l_partkey, l_suppkey), lambda x: CAST(x AS VARCHAR)), ',') AS codes FROM lineitem GROUP BY l_orderkey")
def map_transform(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(ordered_list("l_linenumber", F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias("lines"))
    rows = rows.withColumn("ten", F.array(F.lit(10)))
    made = tr.map_lists("codes", lambda n, ten: (n * ten + 1).cast("string"), "lines", "ten").apply(rows, {})
    return made.select("l_orderkey", F.array_join("codes", ",").alias("codes"))


def _parts(priority: str) -> tuple:
    rank, _, name = priority.partition("-")
    return int(rank), name.strip().lower()


@query("SELECT o_orderkey, CAST(string_split(o_orderpriority, '-')[1] AS INTEGER) AS rank, lower(trim(substr(o_orderpriority, 3))) AS label FROM orders")
def row_udf_multi_output(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return tr.python(_parts, ["o_orderpriority"], "rank int, label string").apply(rows, {}).select("o_orderkey", "rank", "label")


@tr.transform("shown string, more long")
def _shown(number: int | None, text: str | None) -> tuple:
    return f"{number!r}/{text!r}", None if number is None else number + 1


@query("SELECT l_orderkey, l_linenumber, concat(coalesce(CAST(k AS VARCHAR), 'None'), '/', CASE WHEN k IS NULL THEN 'None' ELSE concat(chr(39), l_returnflag, chr(39)) END) AS shown, k + 1 AS more FROM (SELECT *, nullif(l_linenumber, 2) AS k FROM lineitem)")
def row_udf_nulls(spark, sf_dir):
    """Null integers and texts reach a Python function as None, integers as int."""
    k = F.nullif(F.col("l_linenumber"), F.lit(2))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", k.alias("k"), F.when(k.isNotNull(), F.col("l_returnflag")).alias("t"))
    return _shown.on("k", "t").apply(rows, {}).select("l_orderkey", "l_linenumber", "shown", "more")


def _not_error(kind: str, value: float, settings: dict) -> str:
    if kind == settings["skip"]:
        raise tr.SkipRow(kind)
    return kind.upper()


@query("SELECT event_id, upper(event_type) AS kind FROM events WHERE event_type <> (SELECT min(event_type) FROM events)")
def skip_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    least = events.agg(F.min("event_type")).first()[0]
    return tr.python(_not_error, ["event_type", "value"], "kind string").apply(events, {"skip": least}).select("event_id", "kind")


@query("SELECT DISTINCT event_type, user_id FROM events WHERE (event_type, user_id) NOT IN (SELECT event_type, user_id FROM events WHERE event_id * 10 < (SELECT max(event_id) FROM events))")
def repeat_antijoin(spark, sf_dir):
    """The seen inputs are the first tenth of the ids, so they grow with the table."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    hashed = events.withColumn("input_hash", input_hash("v1", {c: F.col(c) for c in ("event_type", "user_id")}))
    last = hashed.agg(F.max("event_id").alias("last"))
    seen = hashed.crossJoin(F.broadcast(last)).where("event_id * 10 < last").drop("last")
    return unseen(hashed, seen).select("event_type", "user_id")


# -- validation -------------------------------------------------------------------------------------



@query("SELECT event_id, CASE WHEN value_ok THEN 'ok' ELSE 'bad' END AS verdict, number FROM (SELECT event_id, TRY_CAST(event_type AS INTEGER) IS NOT NULL AS value_ok, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS number FROM events)")
def coerce_validation(spark, sf_dir):
    from entloom.functions.typenames import spark_type

    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("k"), F.get_json_object("props", "$.k").alias("number"))
    spec = Entity("coerced", {"k": spark_type("int4"), "number": spark_type("int4")}, ("k",))
    checked = validate(rows, spec, "coerce")
    return checked.select("event_id", F.when(F.array_contains("__errors", "k"), "bad").otherwise("ok").alias("verdict"), "number")


@query("SELECT p_partkey AS k, p_size AS size, p_size BETWEEN 1 AND 25 AND p_name IS NOT NULL AND p_brand LIKE 'Brand#%' AS fits FROM part")
def strict_validation(spark, sf_dir):
    from entloom.functions.typenames import spark_type

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    spec = Entity("strict", {"k": spark_type("int8"), "size": spark_type("int4"), "name": spark_type("text"), "brand": spark_type("text")}, ("k",), rules={"size": Rule(ge=1, le=25), "name": Rule(required=True), "brand": Rule(pattern="^Brand#")})
    return validate(rows, spec, "strict").select("k", "size", (F.size("__errors") == 0).alias("fits"))


# -- functions -----------------------------------------------------------------------------------------


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type || '-child' AS label FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.concat("event_type", F.lit("-child")).alias("label"))


@query("SELECT doc_id FROM documents WHERE list_has_any([lang, source], ['de', 'src3'])")
def array_overlap_tags(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.arrays_overlap(F.array("lang", "source"), F.array(F.lit("de"), F.lit("src3")))).select("doc_id")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '[0-4]/?$')")
def regex_source_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.col("url").rlike("[0-4]/?$")).select("page_id", "url")


# -- run log ---------------------------------------------------------------------------------------------



@functools.cache
def _logged(app: str, sf_dir: str) -> Runner:
    """Two runs of a pipeline over the given tables, one of whose steps fails: its rule refuses orders of status P. The first leaves the suppliers out."""
    spark = SparkSession.active()
    registry: dict = {}
    customer = entity("customer", {"key": "int8", "orders": "int8"}, ["key"], registry=registry)
    order = entity("order", {"key": "int8", "status": "text"}, ["key"], {"customer_id": customer}, rules={"status": Rule(one_of=("F", "O"))}, registry=registry)
    supplier = entity("supplier", {"key": "int8"}, ["key"], registry=registry)

    def rows(name, **columns):
        return lambda s: table(s, sf_dir, name).select(*(F.col(c).alias(k) for k, c in columns.items()))

    def counted(read):
        return read(order).groupBy(F.col("customer_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))

    p = Pipeline("logged")
    p.add(Step("1 customers", rows("customer", key="c_custkey"), loads=[Load(customer, {"key": Out("key")}, insert=True)]))
    found = Load(customer, {"key": Out("customer")})
    p.add(Step("2 orders", rows("orders", key="o_orderkey", customer="o_custkey", status="o_orderstatus"), loads=[Load(order, {"key": Out("key"), "status": Out("status"), "customer_id": found}, insert=True)]))
    p.add(Step("3 counts", Query(counted, {order: ["customer_id"]}), loads=[Load(customer, {"orders": Out("n")}, id=Out("id"))]))
    p.add(Step("4 suppliers", rows("supplier", key="s_suppkey"), loads=[Load(supplier, {"key": Out("key")}, insert=True)]))
    runner = Runner(spark, Store(spark, work_folder(spark)))
    runner.run(p, Options(Selection(exclude=frozenset({"4 suppliers"})), fail_downstream=True))
    runner.run(p, Options(fail_downstream=True))
    return runner


def _log_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    log = _logged(spark.sparkContext.applicationId, sf_dir).log
    ctes = "WITH run AS (SELECT * FROM {runs}), step_run AS (SELECT * FROM {steps}), current_run AS (" + VIEWS["current_run"] + ") "
    return spark.sql(ctes + f"SELECT * FROM ({VIEWS[name]})", runs=log.table("run"), steps=log.table("step_run"))


_CURRENT = (
    "SELECT 2 AS run_id, '1 customers' AS step, 'completed' AS status, count(*) AS inputs_extracted, 0 AS inputs_unique, 0 AS rows_inserted FROM customer "
    "UNION ALL SELECT 2, '2 orders', CASE WHEN count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) > 0 THEN 'failed' ELSE 'completed' END, count(*), count(*), 0 FROM orders "
    "UNION ALL SELECT 2, '3 counts', 'upstream_failed', 0, 0, 0 UNION ALL SELECT 2, '4 suppliers', 'completed', count(*), count(*), count(*) FROM supplier"
)


@query(_CURRENT)
def run_log_current(spark, sf_dir):
    """The second run's steps: customers were all seen before, the orders fail again, what needs them is left out."""
    return _log_view(spark, sf_dir, "current_run").select("run_id", "step", "status", "inputs_extracted", "inputs_unique", "rows_inserted")


@query(f"SELECT run_id, step, status FROM ({_CURRENT}) c WHERE status IN ('failed', 'upstream_failed')")
def run_log_failed(spark, sf_dir):
    return _log_view(spark, sf_dir, "failed_run").select("run_id", "step", "status")


@query(f"SELECT step, CASE status WHEN 'failed' THEN 'failed' ELSE 'never run' END AS status FROM ({_CURRENT}) c WHERE status <> 'completed'")
def steps_to_run(spark, sf_dir):
    return _log_view(spark, sf_dir, "steps_to_run")


@query(
    "SELECT run_id, 4 AS steps, (SELECT count(*) FROM (SELECT 1 FROM orders WHERE o_orderstatus NOT IN ('F', 'O') LIMIT 1)) AS failures, "
    "(SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (run_id - 1) * (SELECT count(*) FROM supplier) AS inputs_extracted, "
    "(2 - run_id) * (SELECT count(*) FROM customer) + (run_id - 1) * (SELECT count(*) FROM supplier) AS rows_inserted FROM (VALUES (1), (2)) r(run_id)"
)
def run_totals(spark, sf_dir):
    """Sums of the counters of the last two runs."""
    return _logged(spark.sparkContext.applicationId, sf_dir).log.last(2).select("run_id", "steps", "failures", "inputs_extracted", "rows_inserted")


@query("SELECT unnest(['event_id', 'user_id', 'event_type', 'value']) AS column, (SELECT count(*) FROM events) AS inputs, unnest([count(DISTINCT event_id), count(DISTINCT user_id), count(DISTINCT event_type), count(DISTINCT value)]) AS exact, TRUE AS close FROM events")
def distinct_sketches(spark, sf_dir):
    """Distinct values of the events' columns, estimated by sketches that two runs left in the log: one over a third of the events, one over the rest. They are within 3 % of the exact numbers."""
    columns = ("event_id", "user_id", "event_type", "value")
    runner = Runner(spark, Store(spark, work_folder(spark)))
    e = entity("kind", {"event_type": "text"}, ["event_type"], registry={})

    def run(condition):
        def source(s):
            return table(s, sf_dir, "events").where(condition).select(*columns)

        step = Step("events", source, loads=[Load(e, {"event_type": Out("event_type")}, insert=True)], sketches=columns)
        if (result := runner.run(Pipeline("sketched", [step]))["events"]).status != "completed":
            raise RuntimeError(result.error)

    run("event_id % 3 = 0")
    run("event_id % 3 <> 0")
    rows = table(spark, sf_dir, "events").agg(*(F.count_distinct(c).alias(c) for c in columns))
    exact = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in columns))).alias("x")).select("x.*")
    close = F.abs(F.col("distinct") - F.col("exact")) <= F.col("exact") * 0.03
    return runner.log.distinct().join(exact, "column").select("column", "inputs", "exact", close.alias("close"))


# -- what queries read ---------------------------------------------------------------------------------------


@query(
    "WITH c AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1), s AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1) "
    "SELECT c.nation, c.n AS customers, s.n AS suppliers, 'public.buyer.balance,public.buyer.nation,public.seller.nation' AS reads FROM c JOIN s ON c.nation = s.nation"
)
def columns_read(spark, sf_dir):
    """A query over two entities of equal columns, beside the columns that its plan reads of each; the other's balance isn't among them."""
    registry: dict = {}
    buyer, seller = (entity(n, {"key": "int8", "nation": "int4", "balance": "float8"}, ["key"], registry=registry) for n in ("buyer", "seller"))
    places = {buyer: ("customer", "c"), seller: ("supplier", "s")}

    def counted(read):
        b, s = read(buyer), read(seller)
        one = b.where("balance > 0").groupBy("nation").agg(F.count(F.lit(1)).alias("customers"))
        return one.join(s.groupBy("nation").agg(F.count(F.lit(1)).alias("suppliers")), "nation")

    def read(e):
        name, p = places[e]
        key = "custkey" if p == "c" else "suppkey"
        return table(spark, sf_dir, name).select(F.col(f"{p}_{key}").alias("key"), F.col(f"{p}_nationkey").alias("nation"), F.col(f"{p}_acctbal").alias("balance"))

    reads = ",".join(sorted(Query(counted).dependency.columns_needed))
    return counted(read).select("nation", "customers", "suppliers", F.lit(reads).alias("reads"))


# -- pipelines ---------------------------------------------------------------------------------------------


def shop_pipeline(sf_dir: str) -> tuple[Pipeline, Entity, Entity]:
    """Customers and their orders: the order's reference is the customer's hash, computed without a join."""
    registry: dict = {}
    customer = entity("customer", {"custkey": "int8", "segment": "text", "orders": "int8"}, ["custkey"], registry=registry)
    order = entity("order", {"orderkey": "int8", "status": "text", "urgent": "bool"}, ["orderkey"], {"customer_id": customer}, registry=registry)

    def customers(spark):
        return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")

    def orders(spark):
        return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")

    def per_customer(read):
        both = join_reference(read(order).withColumnRenamed("id", "order_id"), order, read(customer).select("id"), customer)
        return both.groupBy("id").agg(F.count(F.lit(1)).alias("n"))

    pipeline = Pipeline("shop")
    pipeline.add(Step("3 counts", Query(per_customer, {customer: [], order: ["customer_id"]}), loads=[Load(customer, {"orders": Out("n")}, id=Out("id"))]))
    urgent = tr.native(urgent=F.col("o_orderpriority").startswith("1"))
    found = Load(customer, {"custkey": Out("o_custkey")})
    pipeline.add(Step("2 orders", orders, [urgent], [Load(order, {"orderkey": Out("o_orderkey"), "status": Out("o_orderstatus"), "urgent": Out("urgent"), "customer_id": found}, insert=True)]))
    pipeline.add(Step("1 customers", customers, loads=[Load(customer, {"custkey": Out("c_custkey"), "segment": Out("c_mktsegment")}, insert=True)]))
    return pipeline, customer, order


@query(
    f"SELECT {md5_id('c.c_custkey')} AS id, c.c_custkey AS custkey, c.c_mktsegment AS segment, max(n) AS orders, count(*) FILTER (WHERE o.o_orderpriority LIKE '1%') AS urgent FROM customer c "
    "LEFT JOIN orders o ON o.o_custkey = c.c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) k ON k.o_custkey = c.c_custkey GROUP BY ALL"
)
def pipeline_two_steps(spark, sf_dir):
    """The flagship: three steps in an order that follows from what they read and load; then a query over the entities."""
    return _shop_result(spark, *shop_pipeline(sf_dir))


def _shop_result(spark, pipeline, customer, order):
    runner = Runner(spark, Store(spark, work_folder(spark)))
    results = runner.run(pipeline)
    if bad := {n: r.error for n, r in results.items() if r.status != "completed"}:
        raise RuntimeError(f"steps failed: {bad}")
    urgent = runner.table(order).where("urgent").groupBy(F.col("customer_id").alias("id")).agg(F.count(F.lit(1)).alias("urgent"))
    rows = runner.table(customer).join(urgent, "id", "left")
    return rows.select("id", "custkey", "segment", "orders", F.coalesce("urgent", F.lit(0)).alias("urgent"))


@query(
    "SELECT step, n FROM (SELECT 0 AS place, '1 customers' AS step, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 1, '2 orders', (SELECT count(*) FROM orders) "
    "UNION ALL SELECT 2, '3 counts', (SELECT count(DISTINCT o_custkey) FROM orders))"
)
def dependency_order(spark, sf_dir):
    """The flagship's steps in the order that follows from what they read and load, each with the rows that a dry run of it gives after those before it have run."""
    pipeline, *_ = shop_pipeline(sf_dir)
    runner = Runner(spark, Store(spark, work_folder(spark)))
    runner.sync(pipeline)
    rows = []
    for step in pipeline.sorted():
        rows.append((step.name, sum(runner.dry_run(step, pipeline).values())))
        runner.run_step(step, pipeline, Options())
    return spark.createDataFrame(rows, "step string, n long")


@query(ORACLE_SQL["pipeline_two_steps"])
def pipeline_read_back(spark, sf_dir):
    """The flagship, written as JSON and read back before it runs."""
    pipeline, customer, order = shop_pipeline(sf_dir)
    return _shop_result(spark, codec.loads(codec.dumps(pipeline)), customer, order)


@query("SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey % 3 <> 0 AND c_acctbal > 100")
def jdbc_round_trip(spark, sf_dir):
    """A table written to a database and read again by four connections; the filters are the database's. It is one that lives in this process, so it serves one machine."""
    db = Connection.parse(f"derby:///memory:{uuid.uuid4().hex}?create=true")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("CUSTKEY"), F.col("c_name").alias("NAME"), F.col("c_acctbal").alias("BALANCE"))
    write_database(rows, db, "CUSTOMER")
    read = database_partitioned(spark, db, "SELECT CUSTKEY, NAME, BALANCE FROM CUSTOMER WHERE MOD(CUSTKEY, 3) <> 0", "CUSTKEY", 4)
    return read.where("BALANCE > 100").toDF("custkey", "name", "balance")
