"""Queries: projection, filter, predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import patterns, scalars
from tidewheel.operators import joins
from tidewheel.plans.registry import Plans
from tidewheel.tables import load

plans = Plans()


@plans.query("SELECT p_partkey AS key, p_name || ' (' || p_brand || ')' AS label, p_size * 2 AS twice FROM part WHERE p_size > 10")
def project_restrict(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("key"), F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("label"), (F.col("p_size") * 2).alias("twice"))


@plans.query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_proj(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@plans.query("""
SELECT l_orderkey, l_linenumber, l_quantity = 10 AS eq, l_quantity <> 10 AS ne, l_quantity < 10 AS lt, l_quantity <= 10 AS le, l_quantity > 10 AS gt, l_quantity >= 10 AS ge
FROM lineitem
""")
def comparisons(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (q == 10).alias("eq"), (q != 10).alias("ne"), (q < 10).alias("lt"), (q <= 10).alias("le"), (q > 10).alias("gt"), (q >= 10).alias("ge"))


@plans.query("""
WITH t AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') = 'F' AS a, nullif(o_orderpriority, '1-URGENT') > '2' AS b FROM orders)
SELECT o_orderkey, a AND b AS both, a OR b AS either, NOT a AS no FROM t
""")
def three_valued_logic(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.nullif("o_orderstatus", F.lit("P")) == "F", F.nullif("o_orderpriority", F.lit("1-URGENT")) > "2"
    return load(spark, d, "orders").select("o_orderkey", (a & b).alias("both"), (a | b).alias("either"), (~a).alias("no"))


@plans.query("SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
def is_null_outer(spark: SparkSession, d: str) -> DataFrame:
    joined = load(spark, d, "customer").join(load(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.where(F.col("o_orderkey").isNull()).select("c_custkey")


@plans.query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def in_list(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey")


@plans.query("SELECT n_name FROM nation WHERE n_nationkey NOT IN (1, 2, 3)")
def not_in_list(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").where(~F.col("n_nationkey").isin(1, 2, 3)).select("n_name")


@plans.query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def in_table_column(spark: SparkSession, d: str) -> DataFrame:
    rich = load(spark, d, "supplier").where("s_acctbal > 5000")
    return joins.in_column(load(spark, d, "customer"), "c_nationkey", rich, "s_nationkey").select("c_custkey", "c_name")


@plans.query("SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1%' OR p_name LIKE '%a_e%'")
def like_pct(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").where(patterns.like(F.col("p_brand"), "Brand#1%") | patterns.like(F.col("p_name"), "%a_e%")).select("p_partkey", "p_brand")


@plans.query("SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '^B[a-z]+#[1-3].$')")
def pattern_range(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").where(patterns.quel_match(F.col("p_brand"), "B[r][a-z][a-z][a-z]#[1-3]?")).select("p_partkey", "p_brand")


@plans.query("SELECT s_suppkey, s_name FROM supplier WHERE regexp_matches(s_name, '[0-4]$')")
def like_escaped_range(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "supplier").where(patterns.like(F.col("s_name"), "%\\[0-4\\]", "\\")).select("s_suppkey", "s_name")


@plans.query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def exists_corr(spark: SparkSession, d: str) -> DataFrame:
    big = load(spark, d, "orders").where("o_totalprice > 100000")
    return joins.exists(load(spark, d, "customer"), big, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@plans.query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def not_exists_corr(spark: SparkSession, d: str) -> DataFrame:
    big = load(spark, d, "orders").where("o_totalprice > 100000")
    return joins.not_exists(load(spark, d, "customer"), big, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@plans.query("SELECT s_suppkey FROM supplier WHERE s_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def any_subselect(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation").where("n_regionkey = 2")
    return joins.quantified_any(load(spark, d, "supplier"), "s_nationkey", "=", n, "n_nationkey").select("s_suppkey")


@plans.query("SELECT c_custkey FROM customer WHERE c_acctbal < ANY (SELECT s_acctbal FROM supplier WHERE s_nationkey < 5)")
def less_than_any(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier").where("s_nationkey < 5")
    return joins.quantified_any(load(spark, d, "customer"), "c_acctbal", "<", s, "s_acctbal").select("c_custkey")


@plans.query("SELECT c_custkey FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier WHERE s_acctbal < 9000)")
def all_subselect(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier").where("s_acctbal < 9000")
    return joins.quantified_all(load(spark, d, "customer"), "c_acctbal", ">", s, "s_acctbal").select("c_custkey")


@plans.query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice::DECIMAL(18,4) > (SELECT sum(o_totalprice::DECIMAL(18,4))::DOUBLE / count(*) FROM orders)")
def scalar_subselect(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    mean = F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("double") / F.count("*")
    return joins.scalar(o, o, mean, "mean").where(F.col("o_totalprice") > F.col("mean")).select("o_orderkey", "o_totalprice")


@plans.query("""
SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE c_custkey >= 100 AND c_mktsegment LIKE 'B%' AND c_nationkey <> 3 AND regexp_matches(c_name, '[0-5]$')
""")
def form_qualification(spark: SparkSession, d: str) -> DataFrame:
    typed = {"c_custkey": ">= 100", "c_mktsegment": "B*", "c_nationkey": "!= 3", "c_name": "'*[0-5]'"}
    return load(spark, d, "customer").where(scalars.all_of(*(patterns.qualification(F.col(c), t) for c, t in typed.items()))).select("c_custkey", "c_name", "c_mktsegment")


@plans.query("SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_name END AS name FROM part")
def iftrue(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", scalars.iftrue(F.col("p_size") % 3, F.col("p_name")).alias("name"))


@plans.query("""
SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END AS class FROM part
""")
def ext_between_case(spark: SparkSession, d: str) -> DataFrame:
    """Extension: not from the reference."""
    size = F.col("p_size")
    return load(spark, d, "part").select("p_partkey", F.when(size.between(1, 10), "small").when(size <= 30, "medium").otherwise("large").alias("class"))
