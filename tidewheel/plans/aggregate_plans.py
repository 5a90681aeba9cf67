"""Queries: aggregation, grouping, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.operators import aggregates as A
from tidewheel.operators import ordering
from tidewheel.plans.registry import Plans
from tidewheel.tables import load

plans = Plans()


def exact(column: str, kind: str = "decimal(18,4)"):
    """A measure as a decimal, so that sums do not depend on their order."""
    return F.col(column).cast(kind)


def _paid():
    """A line's discounted price: 17 digits, so that the product stays in a machine word."""
    return exact("l_extendedprice", "decimal(11,2)") * (F.lit(1).cast("decimal(1,0)") - exact("l_discount", "decimal(4,2)"))


def _revenue():
    return F.sum(_paid()).cast("double")


_REVENUE = "sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(5,2)))::DOUBLE"

FLAGSHIP_SQL = f"""
SELECT c_mktsegment, count(DISTINCT o_orderkey) AS n_orders, {_REVENUE} AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderdate >= DATE '1995-01-01' GROUP BY c_mktsegment HAVING count(*) > 10 ORDER BY revenue DESC
"""


@plans.query(FLAGSHIP_SQL)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Scan, filter, two equi-joins, aggregate, HAVING and sort.

    Lines are added up by order before any join, so what is joined has a row for each order.
    """
    c = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    o = load(spark, d, "orders").where("o_orderdate >= DATE '1995-01-01'").select("o_orderkey", "o_custkey")
    per_order = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(_paid()).alias("r"), F.count("*").alias("n"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    grouped = rows.groupBy("c_mktsegment").agg(F.count("*").alias("n_orders"), F.sum("r").cast("double").alias("revenue"), F.sum("n").alias("n")).where("n > 10").drop("n")
    return ordering.order_by(grouped, "revenue desc")


@plans.query(f"""
SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS sum_qty, {_REVENUE} AS revenue,
  sum(l_quantity::DECIMAL(18,4))::DOUBLE / count(*) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL
""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    q = F.sum(exact("l_quantity")).cast("double")
    rows = load(spark, d, "lineitem").where("l_shipdate <= DATE '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(q.alias("sum_qty"), _revenue().alias("revenue"), (q / F.count("*")).alias("avg_qty"), F.count("*").alias("n"))


@plans.query("""
SELECT count(*) AS n, count(p) AS known, sum(v)::DOUBLE AS total, sum(v)::DOUBLE / count(v) AS mean, max(v)::DOUBLE AS high, min(v)::DOUBLE AS low
FROM (SELECT nullif(o_orderpriority, '1-URGENT') AS p, o_totalprice::DECIMAL(18,4) AS v FROM orders)
""")
def agg_simple(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select(F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p"), exact("o_totalprice").alias("v"))
    total = F.sum("v").cast("double")
    return rows.agg(F.count("*").alias("n"), F.count("p").alias("known"), total.alias("total"), (total / F.count("v")).alias("mean"), F.max("v").cast("double").alias("high"), F.min("v").cast("double").alias("low"))


@plans.query("SELECT coalesce(max(CASE WHEN l_quantity > 49 THEN 1 END), 0) AS some, coalesce(max(CASE WHEN l_quantity > 1000 THEN 1 END), 0) AS none FROM lineitem")
def agg_any(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").agg(A.any_(F.col("l_quantity") > 49).alias("some"), A.any_(F.col("l_quantity") > 1000).alias("none"))


@plans.query("SELECT count(DISTINCT l_quantity) AS countu, sum(DISTINCT l_quantity::DECIMAL(18,4))::DOUBLE AS sumu, sum(DISTINCT l_quantity::DECIMAL(18,4))::DOUBLE / count(DISTINCT l_quantity) AS avgu FROM lineitem")
def agg_unique(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").agg(A.countu("l_quantity").alias("countu"), A.sumu(exact("l_quantity")).cast("double").alias("sumu"), A.avgu(exact("l_quantity")).alias("avgu"))


@plans.query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers, count(*) AS n FROM orders GROUP BY ALL")
def count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("n_customers"), F.count("*").alias("n"))


_MOMENTS = "count(*)::DOUBLE AS n, sum(x)::DOUBLE AS sx, sum(x * x)::DOUBLE AS sxx, sum(y)::DOUBLE AS sy, sum(y * y)::DOUBLE AS syy, sum(x * y)::DOUBLE AS sxy"


@plans.query(f"""
WITH m AS (SELECT l_returnflag, {_MOMENTS} FROM (SELECT l_returnflag, l_quantity::DECIMAL(12,2) AS x, (l_discount * 100)::DECIMAL(12,2) AS y FROM lineitem) GROUP BY ALL)
SELECT l_returnflag, round((sxx - sx * sx / n) / (n - 1), 4) AS var_samp, round((sxx - sx * sx / n) / n, 4) AS var_pop, round(sqrt((sxx - sx * sx / n) / (n - 1)), 4) AS stddev_samp,
  round((sxy - sx * sy / n) / n, 4) AS covar_pop, round((sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)), 4) AS corr
FROM m
""")
def agg_stat(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100, 2).alias("y"))
    return rows.groupBy("l_returnflag").agg(
        F.round(F.var_samp("x"), 4).alias("var_samp"), F.round(F.var_pop("x"), 4).alias("var_pop"), F.round(F.stddev_samp("x"), 4).alias("stddev_samp"), F.round(F.covar_pop("x", "y"), 4).alias("covar_pop"), F.round(F.corr("x", "y"), 4).alias("corr")
    )


@plans.query("""
SELECT event_type, max(ts) AS last, min(props) AS first_props, sum(user_id)::BIGINT AS users, sum(value::DECIMAL(18,4))::DOUBLE AS total, count(*) AS n FROM events GROUP BY ALL
""")
def agg_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates over dates, strings, integers and decimals."""
    return load(spark, d, "events").groupBy("event_type").agg(F.max("ts").alias("last"), F.min("props").alias("first_props"), F.sum("user_id").alias("users"), F.sum(exact("value")).cast("double").alias("total"), F.count("*").alias("n"))


@plans.query("SELECT o_custkey, count(*) AS n, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS total FROM orders GROUP BY ALL HAVING count(*) > 15")
def group_having(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(exact("o_totalprice")).cast("double").alias("total")).where("n > 15")


@plans.query("SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS high, coalesce(max(CASE WHEN o_orderstatus = 'P' THEN 1 END), 0) AS pending FROM orders GROUP BY ALL")
def accumulator_merge(spark: SparkSession, d: str) -> DataFrame:
    """Partial aggregates by month, merged."""
    partial = load(spark, d, "orders").groupBy("o_orderpriority", F.trunc("o_orderdate", "MM").alias("month")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("high"), A.any_(F.col("o_orderstatus") == "P").alias("pending"))
    return A.accumulate(partial, ["o_orderpriority"], {"n": "count", "high": "max", "pending": "any"})


@plans.query("""
SELECT r_name, n_name, count(*) AS n, sum(s_acctbal::DECIMAL(18,4))::DOUBLE AS total, 2 - grouping(r_name) - grouping(n_name) AS level
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)
""")
def break_report(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "supplier").join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return A.break_report(rows, ["r_name", "n_name"], {"n": F.count("*"), "total": F.sum(exact("s_acctbal")).cast("double")})


@plans.query("SELECT count(*) AS n_groups, count(DISTINCT l_returnflag) AS n_flags, min(l_linestatus) AS first FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)")
def break_unique(spark: SparkSession, d: str) -> DataFrame:
    return A.once_per_break(load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"n_groups": F.count("*"), "n_flags": F.count_distinct("l_returnflag"), "first": F.min("l_linestatus")})


@plans.query("SELECT o_orderkey, (sum(o_totalprice::DECIMAL(18,4)) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))::DOUBLE AS so_far FROM orders")
def cumulative_total(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select("o_orderkey", exact("o_totalprice").alias("v"))
    return A.running_sum(rows, "o_orderkey", [], "v", "so_far").select("o_orderkey", F.col("so_far").cast("double").alias("so_far"))


@plans.query("""
SELECT o_custkey, o_orderkey, (sum(o_totalprice::DECIMAL(18,4)) OVER w)::DOUBLE AS so_far, count(*) OVER w AS n, max(o_totalprice) OVER w AS high
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)
""")
def running_by_group(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders")
    out = A.running(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"so_far": F.sum(exact("o_totalprice")), "n": F.count("*"), "high": F.max("o_totalprice")})
    return out.select("o_custkey", "o_orderkey", F.col("so_far").cast("double").alias("so_far"), "n", "high")


@plans.query("""
SELECT o_custkey, o_orderkey, CASE WHEN row_number() OVER w = 1 THEN 1 WHEN o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w THEN 1
  WHEN o_orderpriority IS DISTINCT FROM lag(o_orderpriority) OVER w THEN 2 ELSE 0 END AS broke
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def previous_row_break(spark: SparkSession, d: str) -> DataFrame:
    broke = A.break_changed(["o_orderstatus", "o_orderpriority"], ["o_orderdate", "o_orderkey"], ["o_custkey"])
    return load(spark, d, "orders").select("o_custkey", "o_orderkey", broke.alias("broke"))


@plans.query("SELECT c_mktsegment, count(*) FILTER (WHERE c_nationkey % 3 = 0) AS \"0\", count(*) FILTER (WHERE c_nationkey % 3 = 1) AS \"1\", count(*) FILTER (WHERE c_nationkey % 3 = 2) AS \"2\" FROM customer GROUP BY ALL")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "customer").withColumn("third", (F.col("c_nationkey") % 3).cast("string"))
    return A.crosstab(rows, "c_mktsegment", "third", ["0", "1", "2"], F.count(F.lit(1))).na.fill(0)


# sorting; the order is shown as data


@plans.query("SELECT n_name, row_number() OVER (ORDER BY k ASC NULLS LAST, n_name) AS up, row_number() OVER (ORDER BY k DESC NULLS FIRST, n_name) AS down FROM (SELECT n_name, nullif(n_regionkey, 2) AS k FROM nation)")
def order_nulls_high(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "nation").select("n_name", F.nullif("n_regionkey", F.lit(2)).alias("k"))
    number = lambda *specs: F.row_number().over(Window.orderBy(*map(ordering.key, specs)))
    return rows.select("n_name", number("k", "n_name").alias("up"), number("k desc", "n_name").alias("down"))


@plans.query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer ORDER BY 3, 2 DESC, 1")
def order_by_ordinal(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return ordering.order_by(rows, 3, "c_acctbal desc", 1)


@plans.query("SELECT n_name, n_regionkey, n_nationkey FROM nation ORDER BY n_regionkey DESC, n_name")
def form_sort(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "nation").select("n_name", "n_regionkey", "n_nationkey")
    return ordering.form_order(rows, {"n_name": (2, "a"), "n_regionkey": (1, "d")})


@plans.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def ext_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Extension: not from the reference. The limit is the feature."""
    return ordering.order_by(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice desc", "o_orderkey").limit(25)


@plans.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 40")
def ext_offset(spark: SparkSession, d: str) -> DataFrame:
    """Extension: not from the reference. The limit is the feature."""
    return ordering.order_by(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice desc", "o_orderkey").offset(40).limit(25)


# set operations


@plans.query("SELECT s_nationkey AS key FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "supplier").select(F.col("s_nationkey").alias("key")).union(load(spark, d, "customer").select("c_nationkey")).distinct()


@plans.query("SELECT key, count(*) AS n FROM (SELECT s_nationkey AS key FROM supplier UNION ALL SELECT c_nationkey FROM customer) GROUP BY ALL")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "supplier").select(F.col("s_nationkey").alias("key")).union(load(spark, d, "customer").select("c_nationkey")).groupBy("key").agg(F.count("*").alias("n"))


@plans.query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def ext_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Extension: not from the reference."""
    o = load(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@plans.query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def ext_except(spark: SparkSession, d: str) -> DataFrame:
    """Extension: not from the reference."""
    return load(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(load(spark, d, "orders").select("o_custkey"))


@plans.query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark: SparkSession, d: str) -> DataFrame:
    """Extension: not from the reference."""
    return load(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@plans.query("""
SELECT o_custkey, o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)
""")
def ext_rank_lag(spark: SparkSession, d: str) -> DataFrame:
    """Extension: not from the reference."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return load(spark, d, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"), before.alias("before"))


@plans.query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n, true AS close FROM orders GROUP BY ALL")
def ext_approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Extension: not from the reference. Whether the estimate is within a fifth of the count."""
    rows = load(spark, d, "orders").groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey").alias("a"), F.count_distinct("o_custkey").alias("n"))
    return rows.select("o_orderstatus", "n", (F.abs(F.col("a") - F.col("n")) <= 0.2 * F.col("n")).alias("close"))
