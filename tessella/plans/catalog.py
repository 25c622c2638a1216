"""The query catalogue. `CATALOG` maps a name to (query, SQL or None)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions import numbers as nx, text as fx
from tessella.operators import aggregates as ag, frames as fr, intervals as iv, keyed as kv, kmeans as km, ranks as rk, sets as st, social as so, vectors as vc, windows as wi
from tessella.sources import generators as ge
from tessella.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        CATALOG[f.__name__] = (f, sql)
        return f

    return add


def _r(column: str, digits: int = 4):
    return F.round(F.col(column), digits).alias(column)


# scans, maps, filters


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0")
def filter_even_orders(spark, d):
    return vc.copy_if(table(spark, d, "orders"), F.col("o_orderkey") % 2 == 0).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey FROM orders WHERE o_orderkey % 2 = 0")
def copy_if_renumbered(spark, d):
    v = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), "o_orderkey")
    return vc.copy_if(v, F.col("o_orderkey") % 2 == 0, renumber=True)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 2 AS l_quantity FROM lineitem")
def map_double_qty(spark, d):
    return vc.for_all(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), F.col("l_quantity") * 2, "l_quantity")


@query("SELECT c_custkey, c_name || ' ' AS c_name FROM customer")
def map_append_state(spark, d):
    return vc.for_all(table(spark, d, "customer").select("c_custkey", "c_name"), F.concat("c_name", F.lit(" ")), "c_name")


@query("SELECT event_id AS pos, CASE WHEN event_id % 10 = 0 THEN 0.0 ELSE value END AS value FROM events")
def set_at(spark, d):
    v = table(spark, d, "events").select(F.col("event_id").alias("pos"), "value")
    return vc.set_at(v, v.filter(F.col("pos") % 10 == 0).select("pos", F.lit(0.0).alias("value")))


@query("SELECT event_id AS pos, value FROM events WHERE event_id >= 900")
def scan_from(spark, d):
    return vc.scan_from(table(spark, d, "events").select(F.col("event_id").alias("pos"), "value"), 900)


@query("SELECT event_id AS pos, value FROM events WHERE event_id = 77")
def point_lookup(spark, d):
    return vc.at(table(spark, d, "events").select(F.col("event_id").alias("pos"), "value"), 77)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# aggregation


@query("SELECT sum(l_quantity) AS total, count(*) AS n FROM lineitem")
def executor_sum(spark, d):
    return ag.reduce_all(table(spark, d, "lineitem"), F.sum("l_quantity").alias("total"), F.count("*").alias("n"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def mapreduce_group(spark, d):
    rows = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return ag.map_reduce(rows, ["l_returnflag", "l_linestatus"], F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT o_orderkey % 16 AS shard, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def reduce_shards(spark, d):
    return ag.reduce_shards(table(spark, d, "orders"), F.col("o_orderkey") % 16, F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT round(avg(l_quantity), 6) AS mean_l_quantity, round(avg(l_extendedprice), 4) AS mean_l_extendedprice, round(avg(l_discount), 8) AS mean_l_discount, round(avg(l_tax), 8) AS mean_l_tax FROM lineitem")
def column_means(spark, d):
    m = fr.column_means(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return m.select(_r("mean_l_quantity", 6), _r("mean_l_extendedprice", 4), _r("mean_l_discount", 8), _r("mean_l_tax", 8))


@query("SELECT DISTINCT p_brand FROM part")
def distinct_set(spark, d):
    return kv.distinct_set(table(spark, d, "part"), "p_brand")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def bag_multiset(spark, d):
    return kv.bag(table(spark, d, "part"), "p_brand")


@query("SELECT user_id, arg_min(value, ts) AS value FROM events GROUP BY 1")
def map_first_wins(spark, d):
    return kv.first_wins(table(spark, d, "events"), "user_id", "value", ["ts", "event_id"])


@query("SELECT user_id, arg_max(value, ts) AS value FROM events GROUP BY 1")
def upsert_last_wins(spark, d):
    return kv.last_wins(table(spark, d, "events"), "user_id", "value", ["ts", "event_id"])


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def multimap_group(spark, d):
    m = kv.multimap(table(spark, d, "orders"), "o_custkey", "o_orderkey")
    return m.select("o_custkey", F.array_join(F.transform("o_orderkey", lambda x: x.cast("string")), ",").alias("orders"))


@query("""WITH b AS (SELECT least(floor(value / 50), 10)::BIGINT AS bucket, count(*) AS n FROM events GROUP BY 1)
SELECT r.range AS bucket, coalesce(n, 0) AS n FROM range(11) r LEFT JOIN b ON b.bucket = r.range""")
def latency_histogram(spark, d):
    return ag.latency_histogram(spark, table(spark, d, "events"), "value")


@query("SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.999), 6) AS p99_9 FROM events")
def percentiles(spark, d):
    return ag.percentiles(table(spark, d, "events"), "value", [0.5, 0.9, 0.99, 0.999]).select(_r("p50", 6), _r("p90", 6), _r("p99", 6), _r("p99_9", 6))


@query("SELECT (floor(o_totalprice / 50000) + 1)::BIGINT AS bucket, min(o_totalprice) AS low, count(*) AS n FROM orders WHERE o_totalprice >= 0 AND o_totalprice < 500000 GROUP BY 1")
def partition_sizes(spark, d):
    rows = table(spark, d, "orders").filter("o_totalprice >= 0 AND o_totalprice < 500000")
    return ag.range_sizes(rows, "o_totalprice", 0, 500000, 10)


@query("SELECT count(*) AS n, min(o_orderkey) AS low FROM orders")
def sizes_of_partitions(spark, d):
    parts = ag.partition_sizes(table(spark, d, "orders").select("o_orderkey").repartition(5, "o_orderkey"), "o_orderkey")
    return parts.agg(F.sum("n").cast("long").alias("n"), F.min("low").alias("low"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def response_counts(spark, d):
    return kv.bag(table(spark, d, "events"), "event_type")


@query("SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders")
def time_bounds(spark, d):
    return ag.reduce_all(table(spark, d, "orders"), F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))


# keyed tables


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def erase_keys(spark, d):
    gone = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return kv.erase(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), gone, "o_orderkey")


@query("""WITH held AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 2 = 0), new AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 = 0)
SELECT * FROM held UNION ALL SELECT * FROM new WHERE k NOT IN (SELECT k FROM held)""")
def kv_try_emplace(spark, d):
    return kv.try_emplace(*_two_maps(spark, d), "k")


@query("""WITH held AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 2 = 0), new AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 = 0)
SELECT * FROM new UNION ALL SELECT * FROM held WHERE k NOT IN (SELECT k FROM new)""")
def kv_put(spark, d):
    return kv.put(*_two_maps(spark, d), "k")


@query("""WITH held AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 2 = 0), new AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 = 0)
SELECT k, v, k IN (SELECT k FROM new) AS taken FROM held""")
def kv_get_and_remove(spark, d):
    taken, rest = kv.get_and_remove(*_two_maps(spark, d), "k")
    return taken.withColumn("taken", F.lit(True)).unionByName(rest.withColumn("taken", F.lit(False)))


@query("""WITH held AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 2 = 0), new AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 = 0)
SELECT * FROM held UNION ALL SELECT * FROM new WHERE k NOT IN (SELECT k FROM held)""")
def map_merge(spark, d):
    return kv.merge(*_two_maps(spark, d), "k")


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 AND c_mktsegment = 'BUILDING' THEN 'changed' ELSE c_mktsegment END AS v FROM customer")
def kv_update_if_equals(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    wanted = t.filter("k % 5 = 0").select("k", F.lit("BUILDING").alias("old"), F.lit("changed").alias("new"))
    return kv.update_if_equals(t, wanted, "k", "v")


@query("SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE NOT (c_custkey % 5 = 0 AND c_mktsegment = 'BUILDING')")
def kv_remove_if_equals(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return kv.remove_if_equals(t, t.filter("k % 5 = 0").select("k", F.lit("BUILDING").alias("v")), "k", "v")


@query("""WITH held AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT * FROM held UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0""")
def kv_get_or_emplace(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    return kv.get_or_emplace(t.filter("k % 2 = 0"), t.filter("k % 3 = 0"), "k", "v", -1)


@query("""SELECT user_id, 100 + count(*) FILTER (event_type = 'click') AS state FROM events GROUP BY 1""")
def keyed_apply(spark, d):
    e = table(spark, d, "events")
    held = e.select("user_id").distinct().withColumn("state", F.lit(100).cast("long"))
    clicks = e.filter("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("n"))
    return kv.apply_on(held, clicks, "user_id", "state", F.col("state") + F.col("n"), 100)


@query("SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def kv_contains(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return kv.contains(table(spark, d, "customer"), keys, "c_custkey")


def _two_maps(spark, d):
    c = table(spark, d, "customer")
    held = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return held, c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))


# joins


@query("SELECT l_orderkey, l_linenumber, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def multi_get_inner(spark, d):
    ids = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return kv.multi_get(ids, table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").withColumnRenamed("o_orderkey", "l_orderkey")


@query("SELECT c_custkey, c_nationkey AS n_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def multi_get_strict(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return kv.strict_lookup(c, table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query("SELECT c_custkey, coalesce(v, '') AS v FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def multi_get_default(spark, d):
    held = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("v"))
    return kv.default_lookup(table(spark, d, "customer").select("c_custkey"), held, "c_custkey", "v", "")


@query("SELECT c_custkey, o_orders AS n, o_orders IS NOT NULL AS found FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS o_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def kv_get(spark, d):
    held = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return kv.get(held, table(spark, d, "customer").select("c_custkey"), "c_custkey", "n")


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY event_id) AS p, value FROM events), b AS (SELECT row_number() OVER (ORDER BY ts) AS p, value FROM events)
SELECT round(sum(a.value + b.value), 3) AS total, count(*) AS n FROM a JOIN b USING (p)""")
def zip_sum(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "value")
    z = vc.zipped(rk.with_pos(e, ["event_id"]), rk.with_pos(e, ["ts"], ties=["event_id"]))
    return ag.reduce_all(z, F.round(F.sum(F.col("v0") + F.col("v1")), 3).alias("total"), F.count("*").alias("n"))


_INDEXED = """WITH l AS (SELECT c_nationkey AS idx, c_acctbal AS a, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS occ, c_custkey FROM customer),
r AS (SELECT s_nationkey AS idx, s_acctbal AS a, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS occ FROM supplier)
"""


def _frames(spark, d):
    l = table(spark, d, "customer").select(F.col("c_nationkey").alias("idx"), F.col("c_acctbal").alias("a"), F.col("c_custkey").alias("pos"))
    r = table(spark, d, "supplier").select(F.col("s_nationkey").alias("idx"), F.col("s_acctbal").alias("a"), F.col("s_suppkey").alias("pos"))
    return l, r


def _arith(op: str, sign: str) -> None:
    def run(spark, d):
        return fr.index_arith(*_frames(spark, d), op).select("idx", F.col("occ").cast("long").alias("occ"), F.round("a", 4).alias("a"))

    run.__name__ = {"plus": "index_arith_plus", "minus": "index_arith_minus", "multiplies": "index_arith_mul", "divides": "index_arith_div"}[op]
    query(_INDEXED + f"SELECT idx, l.occ AS occ, round(l.a {sign} r.a, 4) AS a FROM l JOIN r USING (idx) WHERE l.occ = r.occ")(run)


for _op, _sign in (("plus", "+"), ("minus", "-"), ("multiplies", "*"), ("divides", "/")):
    _arith(_op, _sign)


@query(_INDEXED + "SELECT l.c_custkey AS pos, l.idx, coalesce(r.a, l.a) AS a FROM l LEFT JOIN r ON l.idx = r.idx AND l.occ = r.occ")
def modify_by_idx(spark, d):
    return fr.modify_by_idx(*_frames(spark, d))


@query("""WITH e AS (SELECT user_id, (epoch_us(ts) // 1000) AS s, (epoch_us(ts) // 1000) + floor(value * 1000)::BIGINT AS e FROM events), b AS (SELECT min(s) AS lo, max(e) AS hi FROM e),
n AS (SELECT unnest(range(0, ceil((hi - lo) / 3600000.0)::BIGINT)) AS bin, lo FROM b)
SELECT bin, round(sum(CASE WHEN s IS NULL THEN 0 ELSE greatest(0, least(e, lo + (bin + 1) * 3600000) - greatest(s, lo + bin * 3600000)) END) / 3600000.0, 9) AS busy
FROM n LEFT JOIN e ON s < lo + (bin + 1) * 3600000 AND e > lo + bin * 3600000 GROUP BY 1""")
def interval_bins(spark, d):
    s = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").select(s.alias("s"), (s + F.floor(F.col("value") * 1000)).alias("e"))
    return iv.utilisation_bins(rows, "s", "e", 3_600_000).select(F.col("bin").cast("long").alias("bin"), _r("busy", 9))


# set operations


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, d):
    return st.union_all(*_keys(spark, d))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return st.union_distinct(*_keys(spark, d))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(spark, d):
    return st.intersect_all(*_keys(spark, d))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(spark, d):
    return st.except_all(*_keys(spark, d))


@query("""SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_acctbal AS value FROM customer
UNION ALL SELECT (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY s_suppkey) - 1, s_acctbal FROM supplier""")
def union_concat(spark, d):
    a = rk.with_pos(table(spark, d, "customer"), ["c_custkey"]).select("pos", F.col("c_acctbal").alias("value"))
    b = rk.with_pos(table(spark, d, "supplier"), ["s_suppkey"]).select("pos", F.col("s_acctbal").alias("value"))
    return vc.concat(a, b)


def _keys(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))


@query("""WITH p AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ks FROM orders GROUP BY 1)
SELECT o_custkey, unnest(range(0, len(ks))) AS pos, unnest(ks) AS value FROM p""")
def flatten_lists(spark, d):
    lists = kv.multimap(table(spark, d, "orders"), "o_custkey", "o_orderkey").select("o_custkey", F.array("o_orderkey").alias("ks"))
    return st.flatten(lists, "ks", ["o_custkey"]).withColumn("pos", F.col("pos").cast("long"))


# order


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders")
def global_sort_rank(spark, d):
    return rk.with_pos(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "pos")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 700")
def find_by_order(spark, d):
    return rk.find_by_order(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 700, ["o_totalprice", "o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 >= (SELECT count(*) // 2 FROM orders) THEN 1 ELSE 0 END AS half FROM orders")
def split_median(spark, d):
    return rk.split_median(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "half")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20")
def topk_price(spark, d):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return rk.top_k(table(spark, d, "lineitem").select(*cols, "l_extendedprice"), 20, F.desc("l_extendedprice"), *cols)


@query("SELECT event_id AS seq, value FROM events ORDER BY event_id LIMIT 100")
def queue_pop_n(spark, d):
    return rk.pop_front(table(spark, d, "events").select(F.col("event_id").alias("seq"), "value"), 100)


@query("SELECT event_id AS seq, value FROM events ORDER BY event_id DESC LIMIT 100")
def stack_pop_n(spark, d):
    return rk.pop_top(table(spark, d, "events").select(F.col("event_id").alias("seq"), "value"), 100)


@query("SELECT arg_min(value, event_id) AS front, arg_max(value, event_id) AS back FROM events")
def queue_ends(spark, d):
    return rk.ends(table(spark, d, "events"), "value", "event_id")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS pos FROM part")
def bytes_order(spark, d):
    return rk.with_pos(table(spark, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"]).select("p_partkey", "pos")


# windows


@query("""WITH l AS (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events)
SELECT event_id, round(list_sum([v[len(v) - i] * power(0.5, i) for i in range(least(len(v), 61))]) / list_sum([power(0.5, i) for i in range(least(len(v), 61))]), 6) AS ewm FROM l""")
def ewm_span3(spark, d):
    return wi.ewm(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"]).select("event_id", _r("ewm", 6))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT event_id, user_id, i, value AS ewma FROM e WHERE i = 1 UNION ALL
SELECT e.event_id, e.user_id, e.i, CASE WHEN r.ewma = 0 THEN e.value ELSE r.ewma * 0.9 + e.value * 0.1 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT event_id, round(ewma, 6) AS ewma FROM r""")
def ewma_reset(spark, d):
    return wi.ewma_reset(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"]).select("event_id", _r("ewma", 6))


@query("SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS low FROM events")
def moving_min(spark, d):
    return wi.moving_min(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"], 10).select("event_id", "low")


@query("SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events")
def counter_delta(spark, d):
    return wi.deltas(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"]).select("event_id", _r("delta", 6))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS rank FROM events QUALIFY rank >= 5 AND rank < 15")
def timeline_slice(spark, d):
    return wi.timeline_slice(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 5, 15).select("user_id", "event_id", "rank")


@query("SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def tumbling_p99(spark, d):
    w = wi.tumbling(table(spark, d, "events"), "ts", "6 hours", F.count("*").alias("n"), F.percentile("value", 0.99).alias("p99"))
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", _r("p99", 6))


@query("""WITH e AS (SELECT event_id, user_id, ts, (epoch_us(ts) // 1000) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT event_id, max(a - i * 600000) OVER (PARTITION BY user_id ORDER BY ts, event_id) + i * 600000 AS start FROM e""")
def busy_schedule(spark, d):
    e = table(spark, d, "events").withColumn("a", F.unix_millis(F.col("ts").cast("timestamp")))
    return wi.busy_schedule(e, "a", ["user_id"], ["ts", "event_id"], 600_000).select("event_id", "start")


@query("SELECT event_id, 3 + sum(event_id % 7) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS state FROM events")
def running_state(spark, d):
    e = table(spark, d, "events").withColumn("delta", F.col("event_id") % 7)
    return wi.running_state(e, "delta", ["user_id"], ["ts", "event_id"], 3).select("event_id", "state")


@query("SELECT user_id, round(sum(value) * count(*) / (nullif(max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000)), 0)::DOUBLE * count(*) FILTER (event_type = 'click')), 8) AS load FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'click') > 0 AND count(*) > 1")
def utilisation_ratio(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_millis(F.col("ts").cast("timestamp"))).withColumn("one", F.lit(1)).withColumn("hit", (F.col("event_type") == "click").cast("int"))
    return wi.utilisation(e, "value", "t", "one", "hit", ["user_id"]).filter(F.col("load").isNotNull()).select("user_id", _r("load", 8))


# text, numbers


#: The same patterns as SQL strings.
_URL, _MENTION = (p.replace("'", "''") for p in (fx.URL_PATTERN, fx.MENTION_PATTERN))


@query(f"SELECT page_id, array_to_string(regexp_extract_all(url, '{_URL}'), ' ') AS urls FROM pages")
def extract_urls(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(fx.extract_urls(F.col("url")), " ").alias("urls"))


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{_MENTION}', 1), ' ') AS mentions FROM documents WHERE len(regexp_extract_all(text, '{_MENTION}', 1)) > 0")
def extract_mentions(spark, d):
    m = fx.extract_mentions(F.col("text"))
    return table(spark, d, "documents").filter(F.size(m) > 0).select("doc_id", F.array_join(m, " ").alias("mentions"))


@query(f"SELECT page_id, regexp_replace('see ' || url, '{_URL}', '{fx.SHORT_URL_PREFIX}' || substr(sha256(regexp_extract(url, '{_URL}')), 1, 10)) AS text FROM pages")
def shorten_urls(spark, d):
    t = table(spark, d, "pages").select("page_id", F.concat(F.lit("see "), "url").alias("text"))
    return t.select("page_id", fx.shorten_text(F.col("text"), F.transform(fx.extract_urls(F.col("text")), lambda u: fx.short_url(u))).alias("text"))


@query("SELECT c_custkey, sha256(c_name || c_mktsegment) AS digest, md5(c_name) AS checksum FROM customer")
def salted_sha256(spark, d):
    return table(spark, d, "customer").select("c_custkey", fx.salted_sha256(F.col("c_name"), F.col("c_mktsegment")).alias("digest"), F.md5("c_name").alias("checksum"))


@query("SELECT o_orderkey, ((((year(o_orderdate) * 12 + month(o_orderdate)) * 30 + day(o_orderdate)) * 24 + hour(o_orderdate)) * 60 + minute(o_orderdate)) * 60 + second(o_orderdate) AS seconds FROM orders")
def simple_time_seconds(spark, d):
    t = F.col("o_orderdate")
    parts = [f(t).cast("long") for f in (F.year, F.month, F.day, F.hour, F.minute, F.second)]
    return table(spark, d, "orders").select("o_orderkey", nx.simple_seconds(*parts).alias("seconds"))


@query("SELECT p_partkey, CAST(ceil(p_size / 7.0) AS BIGINT) AS up, CAST(power(2, ceil(log2(p_size + 1))) AS BIGINT) AS pow2, p_size // 7 AS down FROM part")
def integer_helpers(spark, d):
    size = F.col("p_size").cast("long")
    return table(spark, d, "part").select("p_partkey", nx.div_round_up(size, F.lit(7)).alias("up"), nx.next_power_of_two(size + 1).alias("pow2"), F.call_function("div", F.col("p_size"), F.lit(7)).cast("int").alias("down"))


@query("SELECT vec_id, embedding[3]::DOUBLE AS third, len(embedding) AS n, round(list_sum([x::DOUBLE * 2 for x in embedding[1:8]]), 6) AS doubled FROM embeddings")
def array_views(spark, d):
    e = F.col("embedding")
    doubled = F.aggregate(nx.visit(nx.slice_view(e, 0, 8), lambda x: x.cast("double") * 2), F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "embeddings").select("vec_id", e[2].cast("double").alias("third"), F.size(e).cast("long").alias("n"), F.round(doubled, 6).alias("doubled"))


# graph and timelines: customers follow by order numbers, events are posts


_EDGES = "WITH edges AS (SELECT DISTINCT o_custkey AS src, (o_orderkey % 97) + 1 AS dst FROM orders) "


def _edges(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 97 + 1).alias("dst")).distinct()


@query(_EDGES + "SELECT dst AS user_id, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS followers FROM edges GROUP BY 1")
def followers_list(spark, d):
    return so.followers(_edges(spark, d)).select("user_id", F.array_join(F.transform("followers", lambda x: x.cast("string")), ",").alias("followers"))


@query(_EDGES + "SELECT src AS user_id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS followees FROM edges GROUP BY 1")
def followees_list(spark, d):
    return so.followees(_edges(spark, d)).select("user_id", F.array_join(F.transform("followees", lambda x: x.cast("string")), ",").alias("followees"))


@query(_EDGES + "SELECT src, dst FROM edges UNION SELECT dst, src FROM edges")
def graph_symmetric(spark, d):
    return so.symmetric(_edges(spark, d))


@query(_EDGES + "SELECT src, dst FROM edges WHERE (src + dst) % 5 <> 0")
def graph_unfollow(spark, d):
    e = _edges(spark, d)
    return so.unfollow(e, e.filter("(src + dst) % 5 = 0"))


def _posts(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("post_id"), "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.array(F.col("event_id") % 50 + 1).alias("mentions"), F.col("event_type").alias("text")
    )


_HOME = _EDGES + """, posts AS (SELECT event_id AS post_id, user_id, (epoch_us(ts) // 1000) AS timestamp, event_id % 50 + 1 AS mention, event_type AS text FROM events),
home AS (SELECT src AS user_id, timestamp, post_id FROM posts JOIN edges ON dst = posts.user_id UNION SELECT mention, timestamp, post_id FROM posts)
"""


@query(_HOME + "SELECT * FROM home")
def home_timeline_fanout(spark, d):
    return so.fan_out(_posts(spark, d), _edges(spark, d))


@query(_HOME + """, cut AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, post_id DESC) - 1 AS rank FROM home QUALIFY rank < 10)
SELECT cut.user_id, cut.post_id, cut.timestamp, rank, text FROM cut JOIN posts ON cut.post_id = posts.post_id""")
def read_home_timeline(spark, d):
    p = _posts(spark, d)
    return so.read_home_timeline(p, _edges(spark, d), 0, 10)


@query(_HOME + """SELECT posts.user_id, posts.post_id, posts.timestamp, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, post_id DESC) - 1 AS rank, text FROM posts QUALIFY rank < 10""")
def read_user_timeline(spark, d):
    p = _posts(spark, d)
    return so.read_timeline(so.user_timeline(p), p.drop("mentions"), 0, 10)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'WRONG_PASSWORD' WHEN c_custkey % 3 = 1 THEN 'OK' ELSE 'NOT_REGISTERED' END AS status FROM customer""")
def login_status(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("username"))
    salted = c.filter("c_custkey % 3 <> 2").select(F.col("c_custkey").alias("user_id"), "username", fx.salted_sha256(F.concat(F.lit("pw"), F.col("username")), F.lit("salt")).alias("password_hashed"), F.lit("salt").alias("salt"))
    tries = c.select("username", F.when(F.col("c_custkey") % 3 == 0, F.lit("wrong")).otherwise(F.concat(F.lit("pw"), F.col("username"))).alias("password"))
    return so.login(tries, salted).join(c, "username").select("c_custkey", "status")


# iteration


def _first_means(spark, d, k: int = 8):
    rows = table(spark, d, "embeddings").filter(F.col("vec_id") < k).orderBy("vec_id").select("embedding").collect()  # k rows, a parameter
    return [[float(x) for x in r[0]] for r in rows]


_MEANS = """WITH m AS (SELECT vec_id AS c, [x::DOUBLE for x in embedding] AS m FROM embeddings WHERE vec_id < 8),
a AS (SELECT vec_id, c, embedding, list_sum([(z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]) for z in list_zip(embedding, m)]) AS dist FROM embeddings, m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, c) = 1)
"""


@query(_MEANS + "SELECT vec_id, CAST(c AS INTEGER) AS cluster FROM a")
def kmeans_assign(spark, d):
    return km.assign(table(spark, d, "embeddings"), _first_means(spark, d), "embedding").select("vec_id", "cluster")


@query(_MEANS + ", u AS (SELECT c, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM a) SELECT CAST(c AS INTEGER) AS cluster, CAST(i AS INTEGER) AS i, round(avg(x), 5) AS mean FROM u GROUP BY 1, 2")
def kmeans_update(spark, d):
    a = km.assign(table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), _first_means(spark, d), "embedding")
    s = ag.vector_sums(a, "cluster", "embedding")
    return s.select("cluster", "n", F.posexplode("sums").alias("i", "x")).select("cluster", "i", F.round(F.col("x") / F.col("n"), 5).alias("mean"))


@query("""WITH RECURSIVE p AS (SELECT vec_id, [round(x::DOUBLE * 1000)::BIGINT for x in embedding] AS d FROM embeddings),
s(n, m, done) AS (SELECT 0, (SELECT list(d ORDER BY vec_id) FROM p WHERE vec_id < 8), false
UNION ALL SELECT n + 1, x.l, x.l = m FROM s, (
  SELECT list(coalesce(u.mean, o.mean) ORDER BY o.c) AS l FROM (SELECT unnest(range(0, 8)) AS c, unnest(m) AS mean FROM s) o
  LEFT JOIN (SELECT c, list(t ORDER BY i) AS mean FROM (SELECT c, i, (sum(v) // count(*))::BIGINT AS t FROM (
    SELECT c, unnest(range(0, len(d))) AS i, unnest(d) AS v FROM (
      SELECT vec_id, any_value(d) AS d, min(struct_pack(dist := list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(d, mean)]), c := c)).c AS c
      FROM p, (SELECT unnest(range(0, 8)) AS c, unnest(m) AS mean FROM s) GROUP BY vec_id)) GROUP BY c, i) GROUP BY c) u USING (c)) x WHERE NOT done),
f AS (SELECT unnest(range(0, 8)) AS c, unnest(m) AS mean FROM s WHERE done),
a AS (SELECT vec_id, min(struct_pack(dist := list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(d, mean)]), c := c)).c AS c FROM p, f GROUP BY vec_id)
SELECT c::INTEGER AS cluster, count(*) AS n FROM a GROUP BY 1""")
def kmeans_fixed_point(spark, d):
    scaled = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("d"))
    means = [[math.floor(abs(x) * 1000 + 0.5) * (1 if x >= 0 else -1) for x in m] for m in _first_means(spark, d)]
    final, _ = km.fit(scaled, means)
    return km.assign(scaled, final).groupBy("cluster").agg(F.count("*").alias("n"))


# sources


@query("SELECT range AS idx FROM range(3, 1000, 7)")
def sequence_index(spark, d):
    return ge.sequence_index(spark, 3, 1000, 7)


@query("SELECT unnest(generate_series(TIMESTAMP '1970-01-01', TIMESTAMP '1970-01-02', INTERVAL '60 seconds')) AS idx")
def datetime_index(spark, d):
    return ge.datetime_index(spark, "1970-01-01", "1970-01-02", 60).select(F.col("idx").cast("timestamp_ntz").alias("idx"))


@query("SELECT range - 1 AS pos, range * (range + 1) // 2 AS value FROM range(1, 45)")
def triangular_numbers(spark, d):
    return ge.triangular(spark, 1000)


@query()
def random_families(spark, d):
    frames = [ge.draw(spark, k, 4096, seed=7).select(F.lit(k).alias("family"), "pos", "value") for k in ge.FAMILIES]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# registers further queries
from tessella.plans import interface  # noqa: E402, F401
