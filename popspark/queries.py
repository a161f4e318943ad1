"""One query for each operator of the engine over the test tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as X
from .model import Definition, Lineage, Selector
from .operators import aggregates, audit, filters, joins, lineage, mutations, policy, sets, similarity
from .plans.catalog import Catalog
from .sources import package, store, universe, variants
from .streaming import increments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def parts(spark: SparkSession, d: str) -> list[DataFrame]:
    """Three populations: orders by status."""
    orders = t(spark, d, "orders")
    return [orders.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")]


def money(c, places: int = 2):
    return c.cast(f"decimal(18,{places})")


def total(c):
    """A sum that doesn't depend on the order of rows."""
    return F.sum(money(c)).cast("double")


# Populations by selectors.

ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"
SELECTORS = {
    "sel_in": (Selector("s", "o_orderpriority", "in", ["1-URGENT", "2-HIGH"]), "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "sel_not_in": (Selector("s", "o_orderpriority", "not_in", ["1-URGENT", "2-HIGH"]), "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    "sel_eq": (Selector("s", "o_orderstatus", "eq", "P"), "o_orderstatus = 'P'"),
    "sel_neq": (Selector("s", "o_orderstatus", "neq", "F"), "o_orderstatus <> 'F'"),
    "sel_gt": (Selector("s", "o_totalprice", "gt", 300000), "o_totalprice > 300000"),
    "sel_gte": (Selector("s", "o_custkey", "gte", 1000), "o_custkey >= 1000"),
    "sel_lt": (Selector("s", "o_custkey", "lt", 50), "o_custkey < 50"),
    "sel_lte": (Selector("s", "o_totalprice", "lte", 20000.5), "o_totalprice <= 20000.5"),
    "sel_between": (Selector("s", "o_totalprice", "between", [100000, 120000]), "o_totalprice BETWEEN 100000 AND 120000"),
    "sel_exclusion": (Selector("s", "o_orderstatus", "in", ["F", "P"], is_exclusion=True), "o_orderstatus NOT IN ('F', 'P')"),
}
for _name, (_selector, _where) in SELECTORS.items():
    QUERIES[_name] = lambda spark, d, s=_selector: filters.select_rows(t(spark, d, "orders"), [s]).select(*ORDER.split(", "))
    ORACLE_SQL[_name] = f"SELECT {ORDER} FROM orders WHERE {_where}"
BOTH = [SELECTORS["sel_in"][0], SELECTORS["sel_between"][0], SELECTORS["sel_exclusion"][0]]


@query(f"SELECT {ORDER} FROM orders WHERE {SELECTORS['sel_in'][1]} AND {SELECTORS['sel_between'][1]} AND {SELECTORS['sel_exclusion'][1]}")
def sel_and(spark, d):
    return filters.select_rows(t(spark, d, "orders"), BOTH).select(*ORDER.split(", "))


@query(f"SELECT {ORDER} FROM orders WHERE ({SELECTORS['sel_in'][1]} OR {SELECTORS['sel_between'][1]}) AND {SELECTORS['sel_exclusion'][1]}")
def sel_or(spark, d):
    return filters.select_rows(t(spark, d, "orders"), BOTH, "OR").select(*ORDER.split(", "))


@query("SELECT n_name, count(DISTINCT o_custkey) AS customers, cast(sum(cast(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 100000 AND 300000 AND o_orderstatus <> 'P' GROUP BY n_name ORDER BY total DESC, n_name LIMIT 10")
def population_by_nation(spark, d):
    wanted = [Selector("a", "o_orderpriority", "in", ["1-URGENT", "2-HIGH"]), Selector("b", "o_totalprice", "between", [100000, 300000]), Selector("c", "o_orderstatus", "neq", "P")]
    found = filters.select_rows(t(spark, d, "orders"), wanted).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return found.groupBy("n_name").agg(F.count_distinct("o_custkey").alias("customers"), total(F.col("o_totalprice")).alias("total")).orderBy(F.desc("total"), "n_name").limit(10)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def point_lookup(spark, d):
    return filters.match(t(spark, d, "orders"), {"o_orderkey": 77}).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (1, 20, 300)")
def in_lookup(spark, d):
    orders = t(spark, d, "orders")
    return filters.keep_keys(orders, filters.keys_frame(orders, "o_custkey", ["1", 20, "300", "none"]), "o_custkey").select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%bolt' AND (p_brand LIKE 'Brand_1_' OR NOT p_type LIKE '%!_%' ESCAPE '!')")
def like_filter(spark, d):
    return t(spark, d, "part").where("p_name LIKE '%bolt' AND (p_brand LIKE 'Brand_1_' OR NOT p_type LIKE '%!_%' ESCAPE '!')").select("p_partkey", "p_name")


@query("SELECT event_id, user_id FROM events WHERE props IS NOT NULL AND json_extract_string(props, '$.missing') IS NULL AND NOT (user_id < 20 OR event_type IS NULL)")
def isnull_filter(spark, d):
    return t(spark, d, "events").where(F.col("props").isNotNull() & F.get_json_object("props", "$.missing").isNull() & ~((F.col("user_id") < 20) | F.col("event_type").isNull())).select("event_id", "user_id")


@query("SELECT o_orderkey FROM orders WHERE ((1::BIGINT << (o_orderkey % 7)::INT) & 36) <> 0")
def bitset_filter(spark, d):
    return filters.with_bits(t(spark, d, "orders").withColumn("bits", X.bit(F.col("o_orderkey") % 7)), "bits", 36).select("o_orderkey")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL")
def key_set(spark, d):
    return filters.key_set(t(spark, d, "orders"), "o_custkey")


# Joins.


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner(spark, d):
    return t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def join_left(spark, d):
    return t(spark, d, "customer").join(parts(spark, d)[2], F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT coalesce(a.c_nationkey, b.s_nationkey) AS nation, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) b ON c_nationkey = s_nationkey")
def join_full(spark, d):
    a = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    return a.join(t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers")), "nation", "full")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def join_semi(spark, d):
    return filters.keep_keys(t(spark, d, "customer"), t(spark, d, "orders").where("o_totalprice > 400000").select("o_custkey"), "c_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_anti(spark, d):
    return filters.drop_keys(t(spark, d, "customer"), parts(spark, d)[2].select("o_custkey"), "c_custkey").select("c_custkey", "c_name")


@query("SELECT r_name, n_name, count(*) AS n FROM region CROSS JOIN nation GROUP BY r_name, n_name")
def join_cross_agg(spark, d):
    return t(spark, d, "region").crossJoin(F.broadcast(t(spark, d, "nation"))).groupBy("r_name", "n_name").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, n_nationkey FROM orders JOIN nation ON o_totalprice BETWEEN n_nationkey * 20000 AND n_nationkey * 20000 + 500")
def join_range(spark, d):
    ranges = t(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 20000).cast("double").alias("low"), (F.col("n_nationkey") * 20000 + 500).cast("double").alias("high"))
    return joins.interval_join(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), ranges, "o_totalprice", "low", "high", 1000.0).select("o_orderkey", "n_nationkey")


@query("SELECT p.event_id, max(v.ts) AS view_ts FROM events p LEFT JOIN events v ON v.user_id = p.user_id AND v.ts <= p.ts AND v.event_type = 'view' WHERE p.event_type = 'purchase' GROUP BY p.event_id")
def join_asof(spark, d):
    e = t(spark, d, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("ts").alias("view_ts"))
    return joins.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "ts", ["view_ts"]).select("event_id", "view_ts")


@query("SELECT c_custkey, c_name, o_orderkey FROM customer JOIN (SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1) ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def lookup_first_row(spark, d):
    hits = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").withColumn("o_custkey", F.col("c_custkey"))
    return joins.lookup_first(hits, t(spark, d, "orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).where("o_orderkey IS NOT NULL").select("c_custkey", "c_name", "o_orderkey")


EXISTS = "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49) AND s_acctbal > (SELECT avg(s_acctbal) FROM supplier)"


@query(EXISTS)
def exists_correlated(spark, d):
    for name in ("supplier", "lineitem"):
        t(spark, d, name).createOrReplaceTempView(name)
    return spark.sql(EXISTS)


LATERAL = "SELECT r_name, x.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) AS x"


@query(LATERAL)
def lateral_join(spark, d):
    for name in ("region", "nation"):
        t(spark, d, name).createOrReplaceTempView(name)
    return spark.sql(LATERAL)


# Aggregations.


@query("SELECT count(*) AS n FROM lineitem")
def count_all(spark, d):
    return t(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def group_count(spark, d):
    return t(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
def top_groups(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(10)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, cast(sum(cast(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(avg(cast(l_discount AS DECIMAL(18,2))), 6) AS discount, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS var FROM lineitem GROUP BY 1, 2")
def agg_stats(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), total(F.col("l_quantity")).alias("quantity"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.round(F.avg(money(F.col("l_discount"))).cast("double"), 6).alias("discount"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.var_pop("l_quantity"), 6).alias("var"))


@query("SELECT count(DISTINCT l_partkey) AS part_count, count(DISTINCT l_suppkey) AS supplier_count FROM lineitem")
def distinct_count(spark, d):
    return t(spark, d, "lineitem").agg(F.count_distinct("l_partkey").alias("part_count"), F.count_distinct("l_suppkey").alias("supplier_count"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12 AND max(o_totalprice) > 300000")
def having_filter(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("m")).where("n > 12 AND m > 300000").select("o_custkey", "n")


GROUPS = "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS g1, grouping(o_orderpriority) AS g2, count(*) AS n FROM orders GROUP BY "


def _groups(spark, d, how):
    t(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql(GROUPS + how).select("o_orderstatus", "o_orderpriority", F.col("g1").cast("bigint").alias("g1"), F.col("g2").cast("bigint").alias("g2"), "n")


for _name, _how in (("rollup", "ROLLUP (o_orderstatus, o_orderpriority)"), ("cube", "CUBE (o_orderstatus, o_orderpriority)"), ("grouping_sets", "GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")):
    QUERIES[_name] = lambda spark, d, how=_how: _groups(spark, d, how)
    ORACLE_SQL[_name] = GROUPS + _how


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, count(*) FILTER (WHERE l_discount = 0) AS plain FROM lineitem GROUP BY 1")
def agg_filter(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 25).alias("big"), F.count_if(F.col("l_discount") == 0).alias("plain"))


@query("SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 4) AS median, round(quantile_cont(l_quantity, 0.9), 4) AS p90 FROM lineitem GROUP BY 1")
def percentile_exact(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.percentile("l_quantity", 0.5), 4).alias("median"), F.round(F.percentile("l_quantity", 0.9), 4).alias("p90"))


@query()
def approx_distinct(spark, d):
    return t(spark, d, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.02).alias("approx_count"), F.percentile_approx("l_quantity", 0.5).alias("approx_median"))


@query("SELECT * FROM (SELECT column_name, distinct_values, rank() OVER (ORDER BY distinct_values DESC) AS rank FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS column_name, unnest([count(DISTINCT o_orderkey), count(DISTINCT o_custkey), count(DISTINCT o_orderstatus), count(DISTINCT o_totalprice), count(DISTINCT o_orderdate), count(DISTINCT o_orderpriority)]) AS distinct_values FROM orders))")
def cardinality_rank(spark, d):
    return aggregates.cardinality_rank(t(spark, d, "orders")).withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT count(DISTINCT o_custkey) AS cardinality FROM orders")
def bitmap_cardinality(spark, d):
    return aggregates.bitmap_size(aggregates.key_bitmap(t(spark, d, "orders"), "o_custkey"))


@query("SELECT count(*) AS cardinality FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def bitmap_and(spark, d):
    return aggregates.bitmap_size(aggregates.bitmap_intersection([aggregates.key_bitmap(p, "o_custkey") for p in parts(spark, d)]))


@query("SELECT count(DISTINCT o_custkey) AS cardinality FROM orders WHERE o_orderstatus IN ('F', 'P')")
def bitmap_or(spark, d):
    p = parts(spark, d)
    return aggregates.bitmap_size(aggregates.bitmap_union([aggregates.key_bitmap(x, "o_custkey") for x in (p[0], p[2])]))


@query("SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, max(n) AS most, arg_max(c_mktsegment, n * 100 + ord) AS top, bool_and(n > 0) AS every, bool_or(n > 400) AS any FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, ascii(c_mktsegment) AS ord FROM customer GROUP BY 1, 2) GROUP BY 1")
def agg_collect(spark, d):
    g = t(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).withColumn("ord", F.ascii("c_mktsegment"))
    return g.groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list("c_mktsegment")), ",").alias("segments"), F.max("n").alias("most"), F.max_by("c_mktsegment", F.col("n") * 100 + F.col("ord")).alias("top"), F.bool_and(F.col("n") > 0).alias("every"), F.bool_or(F.col("n") > 400).alias("any"))


# Windows.



def by_customer():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


@query(f"SELECT o_orderkey, row_number() {OVER}) AS rn FROM orders")
def row_number(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.row_number().over(by_customer()).cast("bigint").alias("rn"))


@query("SELECT s_suppkey, rank() OVER w AS r, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000))")
def rank_dense(spark, d):
    w = Window.partitionBy("s_nationkey").orderBy(F.floor(F.col("s_acctbal") / 1000))
    return t(spark, d, "supplier").select("s_suppkey", F.rank().over(w).cast("bigint").alias("r"), F.dense_rank().over(w).cast("bigint").alias("dr"), F.round(F.percent_rank().over(w), 8).alias("pr"), F.round(F.cume_dist().over(w), 8).alias("cd"))


@query(f"SELECT o_orderkey, ntile(4) {OVER}) AS q FROM orders")
def ntile(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.ntile(4).over(by_customer()).cast("bigint").alias("q"))


@query(f"SELECT o_orderkey, lag(o_totalprice) {OVER}) AS before, lead(o_totalprice, 2, -1.0) {OVER}) AS after FROM orders")
def lag_lead(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.lag("o_totalprice").over(by_customer()).alias("before"), F.lead("o_totalprice", 2, -1.0).over(by_customer()).alias("after"))


@query(f"SELECT o_orderkey, first_value(o_orderkey) {OVER}) AS f, last_value(o_orderkey) {OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) {OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders")
def first_last(spark, d):
    whole = by_customer().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t(spark, d, "orders").select("o_orderkey", F.first("o_orderkey").over(by_customer()).alias("f"), F.last("o_orderkey").over(whole).alias("l"), F.nth_value("o_orderkey", 2).over(whole).alias("second"))


@query(f"SELECT o_orderkey, cast(sum(cast(o_totalprice AS DECIMAL(18,2))) {OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running FROM orders")
def running_sum(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.sum(money(F.col("o_totalprice"))).over(by_customer().rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("running"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM events")
def range_frame(spark, d):
    # Whole seconds as the SQL's cast makes them: rounded, halves to the even one; in no zone.
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    e = t(spark, d, "events").withColumn("s", F.rint(micros / F.lit(1e6)).cast("long"))
    return e.select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("s").rangeBetween(-86400, 0)).alias("n"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def first_per_key(spark, d):
    return joins.first_per_key(t(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


# Order and limits.


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def topk(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal NULLS LAST, c_custkey LIMIT 15 OFFSET 5")
def sort_limit(spark, d):
    return t(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.asc_nulls_last("c_acctbal"), "c_custkey").offset(5).limit(15)


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders) WHERE rn % (n // 100) = 0 AND rn // (n // 100) < 100")
def stride_sample(spark, d):
    return aggregates.stride_sample(t(spark, d, "orders").select("o_orderkey", "o_custkey"), [F.col("o_orderkey")], 100)


# Set algebra.


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'")
def union_populations(spark, d):
    p = parts(spark, d)
    return sets.union([p[0], p[2]]).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def intersect_populations(spark, d):
    return sets.intersect(parts(spark, d), "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def membership_union(spark, d):
    p = parts(spark, d)
    return sets.members([p[0], p[2]], "o_custkey", "union")


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def membership_intersect(spark, d):
    p = parts(spark, d)
    return sets.members([p[0], p[2]], "o_custkey", "intersection")


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def membership_difference(spark, d):
    return sets.members(parts(spark, d)[1:], "o_custkey", "difference")


MASKS = "WITH m AS (SELECT o_custkey, bit_or(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END) AS mask FROM orders GROUP BY 1)"


@query(f"{MASKS}, r AS (SELECT unnest(range(1, 8)) AS mask) SELECT r.mask, count(m.mask) AS intersection_size, count(*) FILTER (WHERE m.mask = r.mask) AS exclusive_size FROM r LEFT JOIN m ON (m.mask & r.mask) = r.mask GROUP BY r.mask")
def overlap_regions(spark, d):
    return sets.overlap_regions(parts(spark, d), "o_custkey")


@query(f"{MASKS} SELECT i, j, (SELECT count(*) FROM m WHERE (mask >> i::INT) & 1 = 1 AND (mask >> j::INT) & 1 = 1) AS shared FROM (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j)")
def overlap_matrix(spark, d):
    return sets.overlap_matrix(parts(spark, d), "o_custkey")


@query(f"{MASKS} SELECT count(*) FILTER (WHERE mask & 1 <> 0) AS left_keys, count(*) FILTER (WHERE mask & 2 <> 0) AS right_keys, count(*) FILTER (WHERE mask & 3 = 3) AS shared, count(*) FILTER (WHERE mask & 3 = 1) AS left_only, count(*) FILTER (WHERE mask & 3 = 2) AS right_only, round(count(*) FILTER (WHERE mask & 3 = 3) / count(*) FILTER (WHERE mask & 3 <> 0), 8) AS jaccard_similarity, round(count(*) FILTER (WHERE mask & 3 = 3) / least(count(*) FILTER (WHERE mask & 1 <> 0), count(*) FILTER (WHERE mask & 2 <> 0)), 8) AS overlap_coefficient FROM m")
def overlap_stats(spark, d):
    p = parts(spark, d)
    return sets.overlap_stats(p[0], p[1], "o_custkey").withColumns({c: F.round(c, 8) for c in ("jaccard_similarity", "overlap_coefficient")})


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def except_all(spark, d):
    p = parts(spark, d)
    return p[0].select("o_custkey").exceptAll(p[1].select("o_custkey"))


@query("SELECT o_orderkey AS key, NULL AS c_name, o_totalprice FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT c_custkey, c_name, NULL FROM customer")
def union_by_name(spark, d):
    return sets.widened_union([parts(spark, d)[2].select(F.col("o_orderkey").cast("int").alias("key"), "o_totalprice"), t(spark, d, "customer").select("c_name", F.col("c_custkey").alias("key"))]).select("key", "c_name", "o_totalprice")


# Mutations.


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_custkey < 10")
def append(spark, d):
    return mutations.append(parts(spark, d)[0], t(spark, d, "orders").where("o_custkey < 10")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (1, 2, 3, 4)")
def delete_rows(spark, d):
    orders = t(spark, d, "orders")
    return mutations.delete_rows(orders, filters.keys_frame(orders, "o_custkey", [1, "2", 3, "4"]), "o_custkey").select("o_orderkey")


@query("WITH n AS (SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_custkey < 100) SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM n) UNION ALL SELECT * FROM n")
def upsert(spark, d):
    base = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return mutations.upsert(base, base.where("o_custkey < 100").withColumn("o_totalprice", F.col("o_totalprice") + 1), "o_custkey")


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS updated, count(*) FILTER (WHERE o_orderstatus <> 'F') AS inserted FROM orders WHERE o_custkey < 200")
def upsert_counts(spark, d):
    return mutations.upsert_counted(parts(spark, d)[0], t(spark, d, "orders").where("o_custkey < 200"), ["o_orderkey", "o_custkey"])[1]


@query("WITH s1 AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey >= 50 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P') SELECT * FROM s1 WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey < 20")
def increment_two_steps(spark, d):
    f, o, p = (x.select("o_orderkey", "o_custkey") for x in parts(spark, d))
    keys = spark.range(50).select(F.col("id").alias("o_custkey"))
    nation = t(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return mutations.increment(f, [(keys, p), (nation, o.where("o_custkey < 20"))], "o_custkey")


@query("SELECT count(*) AS num_rows, min(o_orderkey) AS low, max(o_orderkey) AS high, 4 AS parts FROM orders")
def partition_counts(spark, d):
    root = store.scratch(spark, "partition")
    package.write_package(spark, f"{root}/whole", Definition("orders"), {"Orders": t(spark, d, "orders")})
    made = package.partition(spark, f"{root}/whole", f"{root}/parts", "o_orderkey", parts=4)
    rows = sets.union([package.read_dataset(spark, p, "Orders") for p in made])
    return rows.agg(F.count("*").alias("num_rows"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.lit(len(made)).alias("parts"))


# Packages.


def _packages(spark: SparkSession, d: str, index: str | None = "o_custkey") -> str:
    root = store.scratch(spark, "catalog")
    for s, part in zip("FOP", parts(spark, d), strict=True):
        definition = Definition(f"status {s}", selectors=(Selector("status", "o_orderstatus", "eq", s),), lineage=Lineage(("warehouse",), ("orders",)))
        package.write_package(spark, f"{root}/{s}", definition, {"Orders": part}, index=index)
    return root


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000")
def pruned_scan_selectors(spark, d):
    return Catalog(spark, _packages(spark, d, None)).scan("Orders", "o_orderstatus = 'P' AND o_totalprice > 200000", ["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND o_custkey IN (7, 70, 700)")
def pruned_sql(spark, d):
    t(spark, d, "customer").createOrReplaceTempView("pruned_sql_customer")
    return Catalog(spark, _packages(spark, d)).sql("SELECT o_orderkey, c_name FROM orders JOIN pruned_sql_customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND o_custkey IN (7, 70, 700)")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (7, 70, 700)")
def pruned_scan_keys(spark, d):
    return Catalog(spark, _packages(spark, d)).scan("Orders", "o_custkey IN (7, 70, 700)", ["o_orderkey", "o_custkey"])


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def catalog_sql(spark, d):
    return Catalog(spark, _packages(spark, d, None)).sql("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")


@query("SELECT 'status ' || o_orderstatus AS name, 1 AS revision, 'Orders' AS label, count(*) AS num_rows, 6 AS num_columns FROM orders GROUP BY o_orderstatus")
def inspect_packages(spark, d):
    root = _packages(spark, d, None)
    return sets.union([package.inspect(spark, f"{root}/{s}") for s in "FOP"]).select("name", "revision", "label", "num_rows", "num_columns")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def package_intersect(spark, d):
    root = _packages(spark, d)
    return package.read_dataset(spark, package.intersect(spark, [f"{root}/F", f"{root}/P"], f"{root}/both", "o_custkey"), "Orders").select("o_orderkey")


@query("SELECT * FROM (VALUES (1, 'Create'), (2, 'Append'), (3, 'Delete rows')) AS r(revision, message), (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS fp, count(*) FILTER (WHERE o_orderstatus IN ('F', 'P') AND o_custkey <> 1) AS rest FROM orders)")
def package_history(spark, d):
    root = _packages(spark, d, None)
    package.append(spark, f"{root}/F", parts(spark, d)[2], "Orders")
    package.delete_rows(spark, f"{root}/F", "o_custkey", [1])
    sizes = [package.open_package(spark, f"{root}/F", r).num_rows for r in (1, 2, 3)]
    return package.revisions(spark, f"{root}/F").select("revision", "message", *[F.lit(n).cast("bigint").alias(c) for n, c in zip(sizes, ("f", "fp", "rest"), strict=True)])


# Similarity.

COSINE = "round(list_dot_product(e.embedding::DOUBLE[], q.v::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(q.v::DOUBLE[], q.v::DOUBLE[])), 4)"
NEAR = f"(SELECT e.vec_id, e.label, {COSINE} AS score FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 7) q WHERE e.vec_id <> 7)"


def _all_hits(spark, d):
    vectors = t(spark, d, "embeddings")
    found = similarity.cosine_scores(vectors, similarity.query_vector(vectors, "vec_id", 7), "vec_id")
    return found.select("vec_id", "label", F.round("score", 4).alias("score"))


def _hits(spark, d, k, where=None):
    vectors = t(spark, d, "embeddings")
    found = similarity.cosine_topk(vectors, similarity.query_vector(vectors, "vec_id", 7), k, "vec_id", filters=where)
    return found.select("vec_id", "label", F.round("score", 4).alias("score"))


@query(f"SELECT * FROM {NEAR} ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk(spark, d):
    return _hits(spark, d, 10)


@query(f"SELECT * FROM {NEAR} WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 5")
def cosine_topk_filtered(spark, d):
    return _hits(spark, d, 5, {"label": 3})


@query(f"SELECT label, max(score) AS score FROM {NEAR} GROUP BY label")
def best_score_per_key(spark, d):
    return similarity.best_per_key(_all_hits(spark, d), "label")


@query(f"SELECT l.label, l.score, c.vec_id FROM (SELECT label, max(score) AS score FROM {NEAR} GROUP BY label) l LEFT JOIN (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label) c USING (label) ORDER BY score DESC, label LIMIT 5")
def hits_lookup_join(spark, d):
    return similarity.hits_with_rows(_all_hits(spark, d).drop("vec_id"), t(spark, d, "embeddings").select("label", "vec_id"), "label", [F.col("vec_id")], 5)


def _universe(spark, d, key, **how):
    root = store.scratch(spark, "universe")
    source = {"Vectors": t(spark, d, "embeddings")} if "embedding" in how else {"Parts": t(spark, d, "part")}
    package.write_package(spark, f"{root}/p", Definition("p"), source)
    return universe.build(spark, f"{root}/p", next(iter(source)), key, f"{root}/u", **how)


@query(f"SELECT vec_id, score FROM {NEAR} ORDER BY score DESC, vec_id LIMIT 10")
def universe_search_by_key(spark, d):
    u = _universe(spark, d, "vec_id", embedding="embedding")
    return universe.search_by_key(spark, u, 7, 10).select("vec_id", F.round("score", 4).alias("score"))


@query("SELECT p_partkey FROM part")
def universe_members(spark, d):
    u = _universe(spark, d, "p_partkey", text=F.col("p_name"))
    return universe.members_of(spark, u).select(F.col("p_partkey").cast("bigint").alias("p_partkey"))


@query("SELECT DISTINCT o_custkey AS id FROM orders")
def bitmap_package_ids(spark, d):
    path = store.scratch(spark, "bitmap")
    variants.write_bitmap(spark, path, Definition("b"), t(spark, d, "orders"), "o_custkey")
    return variants.read_any(spark, path)["members"]


@query("SELECT c_custkey, 'Name: ' || c_name || '. Segment: ' || c_mktsegment AS text, CASE WHEN length('Name: ' || c_name || '. Segment: ' || c_mktsegment) > 30 THEN substr('Name: ' || c_name || '. Segment: ' || c_mktsegment, 1, 30) || '...' ELSE 'Name: ' || c_name || '. Segment: ' || c_mktsegment END AS preview FROM customer")
def record_texts(spark, d):
    c = t(spark, d, "customer")
    shown = c.select("c_custkey", similarity.record_text(c, [("Name", "c_name"), ("Segment", "c_mktsegment"), ("None", "absent")]).alias("text"))
    return shown.withColumn("preview", X.preview(F.col("text"), 30))


@query()
def embed_and_search(spark, d):
    c = t(spark, d, "part")
    vectors = similarity.with_embedding(c.select("p_partkey", "p_name", "p_type"), F.concat_ws(" ", "p_name", "p_type"))
    query_row = similarity.query_vector(vectors, "p_partkey", text="red widget small")
    return similarity.cosine_topk(vectors, query_row, 10, "p_partkey").select("p_partkey", F.round("score", 4).alias("score"))


# Governance.


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def policy_predicate(spark, d):
    p = policy.Policy("p", type="predicate", predicate="c_mktsegment = 'BUILDING' AND c_acctbal > 0")
    return policy.apply_policy(t(spark, d, "customer"), p, [F.col("c_custkey")]).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, '***MASKED***' AS c_name, '***MASKED***' AS c_acctbal FROM customer")
def policy_mask(spark, d):
    p = policy.Policy("p", type="column_mask", masked_columns=("C_NAME", "c_acctbal"))
    return policy.apply_policy(t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), p, [F.col("c_custkey")])


@query("SELECT c_custkey, '-' AS c_name FROM customer WHERE ((1::BIGINT << (c_custkey % 7)::INT) & 9) <> 0 ORDER BY c_custkey LIMIT 40")
def policy_max_rows(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", "c_name", X.bit(F.col("c_custkey") % 7).alias("SOURCES_BITSET"))
    every = [policy.Policy("a", source_bitset=9, priority=2), policy.Policy("b", type="row_limit", max_rows=40), policy.Policy("c", type="column_mask", masked_columns=("c_name",), mask_value="-"), policy.Policy("d", enabled=False, predicate="false")]
    return policy.apply_policies(rows, every, [F.col("c_custkey")]).select("c_custkey", "c_name")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus IN ('O', 'P')")
def universe_union(spark, d):
    return policy.universe_keys(parts(spark, d)[1:], "o_custkey", "union")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def universe_intersection(spark, d):
    keys = policy.universe_keys(parts(spark, d)[1:], "o_custkey", "intersection").withColumnRenamed("o_custkey", "c_custkey")
    return policy.apply_policy(t(spark, d, "customer"), policy.Policy("p"), [], keys, "c_custkey").select("c_custkey")


@query("SELECT * FROM (VALUES ('package', 'package', 'union', 2), ('system', 'table', 'holds', 1), ('table', 'package', 'extracted', 4)) AS e(source, target, kind, n)")
def lineage_edges(spark, d):
    root = _packages(spark, d, None)
    package.union(spark, [f"{root}/F", f"{root}/P"], f"{root}/FP")
    edges = lineage.graph(spark, Catalog(spark, root).packages)[1]
    kind_of = lambda c: F.split(c, ":")[0]
    return edges.groupBy(kind_of(F.col("source")).alias("source"), kind_of(F.col("target")).alias("target"), "kind").agg(F.count("*").cast("int").alias("n"))


AUDIT = "SELECT ts AS timestamp, user_id::VARCHAR AS user_id, event_type AS query_type, event_id % 100 AS rows_returned, round(value, 2) AS elapsed_ms, event_id % 9 <> 0 AS success FROM events"


def _log(spark, d):
    return t(spark, d, "events").select(F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("query_type"), (F.col("event_id") % 100).alias("rows_returned"), F.round("value", 2).alias("elapsed_ms"), (F.col("event_id") % 9 != 0).alias("success"))


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE success) AS succeeded, count(*) FILTER (WHERE NOT success) AS failed, round(count(*) FILTER (WHERE success) / count(*), 8) AS success_rate, round(avg(elapsed_ms), 4) AS avg_elapsed_ms, cast(sum(rows_returned) AS BIGINT) AS rows_returned FROM ({AUDIT})")
def audit_stats(spark, d):
    return audit.stats(_log(spark, d)).withColumns({"success_rate": F.round("success_rate", 8), "avg_elapsed_ms": F.round("avg_elapsed_ms", 4)})


@query(f"SELECT query_type, count(*) AS total FROM ({AUDIT}) GROUP BY 1")
def audit_by_type(spark, d):
    return audit.by_type(_log(spark, d))


@query(f"SELECT timestamp, query_type FROM ({AUDIT}) WHERE user_id = '5' ORDER BY timestamp DESC LIMIT 5")
def audit_log(spark, d):
    return audit.logs(_log(spark, d), 5, "5").select("timestamp", "query_type")


# Scalars.


@query("SELECT doc_id, list_filter(list_transform(string_split(lang || ' | ' || source || '||' || n_chars::VARCHAR, '|'), lambda x: trim(x)), lambda x: x <> '') AS codes FROM documents")
def split_trim_codes(spark, d):
    joined = F.concat(F.col("lang"), F.lit(" | "), F.col("source"), F.lit("||"), F.col("n_chars").cast("string"))
    return t(spark, d, "documents").select("doc_id", X.codes(joined).alias("codes"))


@query("SELECT DISTINCT c_mktsegment, regexp_replace(lower(c_mktsegment || '-Set v1'), '[^a-z0-9_]', '_', 'g') AS name FROM customer")
def sanitize_label(spark, d):
    return t(spark, d, "customer").select("c_mktsegment", X.table_name(F.concat("c_mktsegment", F.lit("-Set v1"))).alias("name")).distinct()


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS preview FROM documents")
def truncate_preview(spark, d):
    return t(spark, d, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("SELECT o_orderkey, substr(o_orderdate::VARCHAR, 1, 10) AS day, substr(o_orderdate::VARCHAR, 1, 4) AS year FROM orders")
def date_prefix(spark, d):
    text = F.col("o_orderdate").cast("string")
    return t(spark, d, "orders").select("o_orderkey", X.date_prefix(text).alias("day"), X.date_prefix(text, 4).alias("year"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS n FROM events")
def json_extract(spark, d):
    k = F.get_json_object("props", "$.k")
    return t(spark, d, "events").select("event_id", k.alias("k"), k.try_cast("int").alias("n"))


@query("SELECT c_custkey, ('0x' || substr(sha256(c_custkey::VARCHAR), 1, 8))::BIGINT % 16 AS bucket FROM customer")
def sha_bucket(spark, d):
    return t(spark, d, "customer").select("c_custkey", X.hash_bucket(F.col("c_custkey"), 16).alias("bucket"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(cast(l_extendedprice AS DECIMAL(18,2)) * (1 - cast(l_discount AS DECIMAL(18,2))), 2)::DOUBLE AS net, round(l_quantity / 7, 4) AS q, abs(l_discount - 0.05) > 0.03 AS far, greatest(l_tax, l_discount) AS most, l_partkey % 10 AS m, floor(l_quantity / 10)::BIGINT AS f FROM lineitem WHERE l_orderkey < 500")
def round_scores(spark, d):
    return t(spark, d, "lineitem").where("l_orderkey < 500").select("l_orderkey", "l_linenumber", "l_partkey", F.round(money(F.col("l_extendedprice")) * (1 - money(F.col("l_discount"))), 2).cast("double").alias("net"), F.round(F.col("l_quantity") / 7, 4).alias("q"), (F.abs(F.col("l_discount") - 0.05) > 0.03).alias("far"), F.greatest("l_tax", "l_discount").alias("most"), (F.col("l_partkey") % 10).alias("m"), F.floor(F.col("l_quantity") / 10).alias("f"))


@query("SELECT p_partkey, upper(p_name) AS up, length(p_type) AS n, replace(p_type, ' ', '-') AS dashed, split_part(p_type, ' ', 1) AS head, starts_with(p_type, 'STANDARD') AS std, lpad(p_partkey::VARCHAR, 8, '0') AS padded, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, coalesce(nullif(p_size, 1), -1) AS size, md5(p_name) AS digest FROM part")
def string_functions(spark, d):
    return t(spark, d, "part").select("p_partkey", F.upper("p_name").alias("up"), F.length("p_type").cast("bigint").alias("n"), F.replace("p_type", F.lit(" "), F.lit("-")).alias("dashed"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("head"), F.startswith("p_type", F.lit("STANDARD")).alias("std"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("padded"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"), F.coalesce(F.nullif("p_size", F.lit(1)), F.lit(-1)).alias("size"), F.md5("p_name").alias("digest"))


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate)::DATE AS month_start, date_diff('day', TIMESTAMP '1992-01-01', date_trunc('day', o_orderdate)) AS days, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, (o_orderdate + INTERVAL 1 MONTH)::DATE AS next_month FROM orders")
def date_functions(spark, d):
    o = F.col("o_orderdate")
    return t(spark, d, "orders").select("o_orderkey", F.year(o).cast("bigint").alias("y"), F.month(o).cast("bigint").alias("m"), F.trunc(o.cast("date"), "month").alias("month_start"), F.datediff(o.cast("date"), F.lit("1992-01-01").cast("date")).cast("bigint").alias("days"), X.iso(o).alias("iso"), F.add_months(o.cast("date"), 1).alias("next_month"))


@query("SELECT vec_id, len(embedding) AS n, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS square, list_contains([1, 2, 3], label) AS known, list_sort([label, 5, 1]) AS sorted, list_sum(list_transform([1, 2, 3], lambda x: x * label))::BIGINT AS weighted FROM embeddings")
def array_functions(spark, d):
    e, label = F.col("embedding"), F.col("label")
    return t(spark, d, "embeddings").select("vec_id", F.size(e).cast("bigint").alias("n"), F.round(X.dot(e, e), 4).alias("square"), F.array_contains(F.array(F.lit(1), F.lit(2), F.lit(3)), label).alias("known"), F.array_sort(F.array(label, F.lit(5), F.lit(1))).alias("sorted"), F.aggregate(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda x: x * label), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("weighted"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal / 0.0 > 0 THEN NULL ELSE s_acctbal END AS safe, s_nationkey IS DISTINCT FROM 3 AS other FROM supplier WHERE s_acctbal > 0")
def json_safe(spark, d):
    s = t(spark, d, "supplier").where("s_acctbal > 0")
    return s.select("s_suppkey", X.json_safe(F.col("s_acctbal") * F.lit(float("inf"))).alias("safe"), (~F.col("s_nationkey").eqNullSafe(3)).alias("other"))


# Windows over time, in batch form; the same functions run on streams.


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_events(spark, d):
    return increments.windowed(t(spark, d, "events"), "ts", [F.col("event_type")], "1 hour").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT s AS start, count(*) AS n FROM events, LATERAL (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s) GROUP BY 1")
def sliding_events(spark, d):
    return increments.windowed(t(spark, d, "events"), "ts", [], "2 hours", "1 hour").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def session_events(spark, d):
    return increments.sessions(t(spark, d, "events"), "ts", [F.col("user_id")], "6 hours").select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def entry(spark: SparkSession, d: str) -> DataFrame:
    return population_by_nation(spark, d)
