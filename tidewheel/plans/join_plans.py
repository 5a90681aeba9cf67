"""Queries: joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import scalars
from tidewheel.operators import joins
from tidewheel.plans.registry import Plans
from tidewheel.tables import load

plans = Plans()

_CUSTOMER_ORDERS = "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"


def _hinted(spark: SparkSession, d: str, hint: str) -> DataFrame:
    customer = load(spark, d, "customer").select("c_custkey", "c_name").hint(hint)
    return load(spark, d, "orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@plans.query(_CUSTOMER_ORDERS)
def hash_join_hint(spark: SparkSession, d: str) -> DataFrame:
    return _hinted(spark, d, "shuffle_hash")


@plans.query(_CUSTOMER_ORDERS)
def merge_join_hint(spark: SparkSession, d: str) -> DataFrame:
    return _hinted(spark, d, "merge")


@plans.query("SELECT l_orderkey, l_linenumber, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
def key_lookup_join(spark: SparkSession, d: str) -> DataFrame:
    """Spark itself broadcasts a side whose size is under its threshold, and shuffles beyond."""
    s = load(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = load(spark, d, "nation").select("n_nationkey", "n_name")
    return load(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("l_orderkey", "l_linenumber", "n_name")


@plans.query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
def equi_join(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@plans.query("""
SELECT o_orderkey, c_name, n_name FROM orders, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND o_totalprice > 200000
""")
def three_way_join(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").where("o_totalprice > 200000")
    return o.join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@plans.query("SELECT l_orderkey AS orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def natural_join(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_custkey")
    return joins.natural_join(load(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_linenumber"), o)


@plans.query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'")
def left_join(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").where("o_orderstatus = 'F'")
    return load(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@plans.query("SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_custkey % 3 = 0) RIGHT JOIN orders ON c_custkey = o_custkey")
def right_join(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").where("c_custkey % 3 = 0")
    return c.join(load(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "right").select("c_custkey", "o_orderkey")


@plans.query("""
SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT * FROM supplier WHERE s_acctbal < 0) ON c_custkey = s_suppkey
""")
def full_join(spark: SparkSession, d: str) -> DataFrame:
    c, s = load(spark, d, "customer").where("c_acctbal > 0"), load(spark, d, "supplier").where("s_acctbal < 0")
    return c.join(s, F.col("c_custkey") == F.col("s_suppkey"), "full").select("c_custkey", "s_suppkey")


@plans.query("SELECT s_suppkey FROM supplier SEMI JOIN (SELECT * FROM lineitem WHERE l_quantity >= 50) ON s_suppkey = l_suppkey")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    return joins.exists(load(spark, d, "supplier"), load(spark, d, "lineitem").where("l_quantity >= 50"), F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey")


@plans.query("SELECT p_partkey FROM part ANTI JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) ON p_partkey = l_partkey")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    return joins.not_exists(load(spark, d, "part"), load(spark, d, "lineitem").where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey")).select("p_partkey")


@plans.query("SELECT a.r_name AS low, b.r_name AS high FROM region a, region b WHERE a.r_regionkey < b.r_regionkey")
def theta_join(spark: SparkSession, d: str) -> DataFrame:
    a, b = load(spark, d, "region").alias("a"), load(spark, d, "region").alias("b")
    return a.join(b, F.col("a.r_regionkey") < F.col("b.r_regionkey")).select(F.col("a.r_name").alias("low"), F.col("b.r_name").alias("high"))


@plans.query("SELECT r_name, n_name FROM region, nation")
def cartesian_product(spark: SparkSession, d: str) -> DataFrame:
    """The reference's product operator, on the two tables whose sizes are fixed."""
    return load(spark, d, "region").crossJoin(load(spark, d, "nation")).select("r_name", "n_name")


@plans.query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey")
def struct_join(spark: SparkSession, d: str) -> DataFrame:
    """Join on a user-defined pair type."""
    s = load(spark, d, "supplier").select("s_suppkey", scalars.pair(F.col("s_suppkey"), F.col("s_nationkey")).alias("p"))
    c = load(spark, d, "customer").select("c_custkey", scalars.pair(F.col("c_custkey"), F.col("c_nationkey")).alias("q"))
    return s.join(c, F.col("p") == F.col("q")).select("s_suppkey", "c_custkey")


@plans.query("""
SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR || ':' || o_orderstatus, ',' ORDER BY o_orderkey), '') AS orders
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
""")
def master_detail(spark: SparkSession, d: str) -> DataFrame:
    detail = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    nested = joins.master_detail(load(spark, d, "customer").select("c_custkey"), detail, {"c_custkey": "o_custkey"}, ["o_orderkey"])
    line = F.transform("details", lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit(":"), x["o_orderstatus"]))
    return nested.select("c_custkey", F.array_join(line, ",").alias("orders"))


@plans.query("""
SELECT event_id, user_id, b.value AS last_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') a
ASOF LEFT JOIN (SELECT user_id, ts, max_by(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) b USING (user_id, ts)
""")
def ext_as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """Extension: not from the reference. Each purchase with the value of the user's last view."""
    e = load(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("last_value"))
    return joins.as_of(left, right, ["user_id"], "ts", "ts", "view_id", ["last_value"]).select("event_id", "user_id", "last_value")


@plans.query("""
SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal AND s_acctbal + 25
""")
def ext_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Extension: not from the reference."""
    ranges = load(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 25).alias("high"))
    return joins.range_join(load(spark, d, "part").select("p_partkey", "p_retailprice"), ranges, "p_retailprice", "low", "high", 25.0).select("p_partkey", "s_suppkey")
