"""Queries: scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.operators import dml
from tidewheel.plans.registry import Plans
from tidewheel.scratch import new_path
from tidewheel.sources import copy
from tidewheel.tables import load

plans = Plans()


@plans.query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 40")
def scan_filter_project(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").where("l_quantity > 40").select("l_orderkey", "l_linenumber", "l_quantity")


@plans.query("SELECT count(*) AS n, min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem")
def scan_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))


@plans.query("SELECT * FROM orders WHERE o_orderkey IN (1, 7, 32, 33, 999) OR o_custkey = 42")
def keyed_lookup(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return o.where(F.col("o_orderkey").isin(1, 7, 32, 33, 999) | (F.col("o_custkey") == 42))


@plans.query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY ALL")
def partitioned_scan(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "by-priority")
    load(spark, d, "orders").select("o_orderkey", "o_orderpriority").write.partitionBy("o_orderpriority").parquet(path)
    rows = spark.read.schema("o_orderkey long, o_orderpriority string").parquet(path)
    return rows.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


_PARTS = "SELECT p_partkey, p_name, nullif(p_brand, 'Brand#11') AS p_brand, p_size, p_retailprice::DECIMAL(12,2)::VARCHAR AS price FROM part"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    return p.select("p_partkey", "p_name", F.nullif("p_brand", F.lit("Brand#11")).alias("p_brand"), "p_size", F.col("p_retailprice").cast("decimal(12,2)").alias("price"))


def _round_trip(spark: SparkSession, d: str, style: str) -> DataFrame:
    rows, path = _parts(spark, d), new_path(spark, f"copy-{style}")
    fields = [copy.Field("p_partkey", "long"), copy.Field("p_name"), copy.Field("p_brand", "string", "]^NULL^["), copy.Field("p_size", "int"), copy.Field("price", "decimal(12,2)")]
    copy.copy_into(rows, path, fields, style)
    return copy.copy_from(spark, path, fields, style).withColumn("price", F.col("price").cast("string"))


@plans.query(_PARTS)
def copy_roundtrip_tab(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, "tab")


@plans.query(_PARTS)
def copy_roundtrip_csv(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, "csv")


@plans.query(_PARTS)
def copy_roundtrip_ssv(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, "ssv")


@plans.query(_PARTS)
def copy_roundtrip_nl(spark: SparkSession, d: str) -> DataFrame:
    """A value a line."""
    return _round_trip(spark, d, "nl")


def _split_lines(rows):
    for row in rows:
        yield tuple(row["line"].split("|"))


@plans.query("SELECT o_orderkey, o_orderpriority, o_orderkey % 7 AS k FROM orders")
def copy_from_program(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "orders").select(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority", (F.col("o_orderkey") % 7).cast("string")).alias("line"))
    return copy.copy_from_program(lines, _split_lines, [copy.Field("o_orderkey", "long"), copy.Field("o_orderpriority"), copy.Field("k", "long")])


@plans.query("SELECT p_partkey, p_size FROM part")
def copy_dummy_columns(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "copy-dummy")
    copy.copy_into(load(spark, d, "part").select("p_partkey", "p_name", "p_size"), path, style="colon")
    return copy.copy_from(spark, path, [copy.Field("p_partkey", "long"), copy.Field("skipped", None), copy.Field("p_size", "int")], "colon")


@plans.query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def fixed_width_load(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "fixed")
    copy.write_fixed(load(spark, d, "customer"), path, [("c_custkey", 12), ("c_name", 30), ("c_mktsegment", 15)])
    return copy.read_fixed(spark, path, [("c_custkey", 12, "long"), ("c_name", 30, "string"), ("c_mktsegment", 15, "string")])


@plans.query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def xml_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows, path = load(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), new_path(spark, "xml")
    copy.write_xml(rows, path)
    return copy.read_xml(spark, path, rows.schema)


@plans.query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def unload_reload(spark: SparkSession, d: str) -> DataFrame:
    for statement in copy.unload(spark, {"orders_unloaded": load(spark, d, "orders")}, new_path(spark, "unload")):
        spark.sql(statement)
    return spark.sql("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders_unloaded")


@plans.query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 2000")
def remote_table_scan(spark: SparkSession, d: str) -> DataFrame:
    """A table of another database, by JDBC: the filter is the other side's, and tasks read by ranges of the key.

    The other database here is the embedded one that Spark brings along, in the memory of a local session.
    """
    name = "remote_" + new_path(spark, "db").rsplit("-", 1)[1]
    url, driver = f"jdbc:derby:memory:{name};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    load(spark, d, "supplier").write.format("jdbc").options(url=url, driver=driver, dbtable="supplier").save()
    bounds = load(spark, d, "supplier").agg(F.min("s_suppkey").alias("low"), F.max("s_suppkey").alias("high")).first()
    remote = copy.register_import(spark, "remote_supplier", "supplier", "jdbc", url=url, driver=driver, partitionColumn="s_suppkey", lowerBound=str(bounds.low), upperBound=str(bounds.high), numPartitions="4")
    return remote.where("s_acctbal > 2000").select("s_suppkey", "s_name", "s_acctbal")


@plans.query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def gateway_import(spark: SparkSession, d: str) -> DataFrame:
    copy.register_import(spark, "nation_imported", f"{d}/nation.parquet", "parquet")
    copy.register_import(spark, "region_imported", f"{d}/region.parquet", "parquet")
    return spark.sql("SELECT n_name, r_name FROM nation_imported JOIN region_imported ON n_regionkey = r_regionkey")


@plans.query("SELECT event_type AS action, user_id::VARCHAR AS who, event_id FROM events")
def audit_log_scan(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "audit")
    e = load(spark, d, "events")
    e.select(F.concat_ws(" ", F.lit("audit"), F.concat(F.lit("id="), "event_id"), F.concat(F.lit("user="), "user_id"), F.concat(F.lit("action="), "event_type"))).write.text(path)
    found = copy.audit_log(spark, path, r"^audit id=(\d+) user=(\S+) action=(.*)$", ["event_id", "who", "action"])
    return found.select("action", "who", F.col("event_id").cast("long").alias("event_id"))


@plans.query("SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 100, NULL FROM region")
def insert_select(spark: SparkSession, d: str) -> DataFrame:
    target = load(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return dml.insert(target, load(spark, d, "region").select((F.col("r_regionkey") + 100).alias("key")))


@plans.query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY ALL")
def create_table_as(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "ctas")
    load(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment").write.parquet(path)
    return spark.read.parquet(path).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@plans.query("""
SELECT s_suppkey, CASE WHEN n_regionkey = 1 THEN upper(s_name) ELSE s_name END AS s_name
FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def update_from(spark: SparkSession, d: str) -> DataFrame:
    source = load(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey", "n_name")
    updated = dml.update_from(load(spark, d, "supplier"), source, {"s_nationkey": "n_nationkey"}, {"s_name": F.upper("s_name")})
    return updated.select("s_suppkey", "s_name")


@plans.query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSING' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_where(spark: SparkSession, d: str) -> DataFrame:
    return dml.update_where(load(spark, d, "customer"), F.col("c_mktsegment") == "BUILDING", {"c_mktsegment": F.lit("HOUSING")}).select("c_custkey", "c_mktsegment")


@plans.query("SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'F') = 'O', false)")
def delete_where(spark: SparkSession, d: str) -> DataFrame:
    return dml.delete_where(load(spark, d, "orders"), F.nullif("o_orderstatus", F.lit("F")) == "O").select("o_orderkey")


@plans.query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL")
def modify_structure(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "modify")
    dml.modify(load(spark, d, "orders").select("o_orderkey", "o_custkey"), path, "btree", ["o_custkey"])
    return spark.read.parquet(path).groupBy("o_custkey").agg(F.count("*").alias("n"))


@plans.query("SELECT 'hash' AS structure, count(*) AS n, 0::BIGINT AS keys_in_several_files, NULL::BIGINT AS overlapping_files FROM orders UNION ALL SELECT 'isam', count(*), 0, 0 FROM orders UNION ALL SELECT 'truncated', 0, 0, NULL")
def modify_layouts(spark: SparkSession, d: str) -> DataFrame:
    """What a layout promises: a key's rows in one file, and for isam files whose key ranges do not overlap."""
    out = None
    for structure in ("hash", "isam", "truncated"):
        path = new_path(spark, structure)
        dml.modify(load(spark, d, "orders").select("o_orderkey", "o_custkey"), path, structure, ["o_custkey"], 4)
        rows = spark.read.schema("o_orderkey long, o_custkey long").parquet(path).select("o_custkey", F.input_file_name().alias("file"))
        spread = rows.groupBy("o_custkey").agg(F.count_distinct("file").alias("files"), F.count("*").alias("n"))
        found = spread.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("files") > 1).alias("keys_in_several_files"))
        files = rows.groupBy("file").agg(F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high"))
        after = F.lag("high").over(Window.orderBy("low"))
        overlaps = files.select((F.col("low") <= after).alias("o")).agg(F.count_if("o").alias("overlapping_files"))
        one = found.crossJoin(overlaps).select(F.lit(structure).alias("structure"), "n", "keys_in_several_files", F.when(F.lit(structure == "isam"), F.col("overlapping_files")).alias("overlapping_files"))
        out = one if out is None else out.unionByName(one)
    return out


@plans.query("""
SELECT s_suppkey, CASE WHEN n_regionkey = 1 THEN upper(s_name) ELSE s_name END AS s_name
FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def update_from_repeated_source(spark: SparkSession, d: str) -> DataFrame:
    """Source rows that repeat a key are no error where they meet no target row."""
    nation = load(spark, d, "nation")
    source = nation.where("n_regionkey = 1").select("n_nationkey", "n_name")
    strange = nation.select((F.col("n_nationkey") + 1000).alias("n_nationkey"), "n_name")
    updated = dml.update_from(load(spark, d, "supplier"), source.unionByName(strange).unionByName(strange), {"s_nationkey": "n_nationkey"}, {"s_name": F.upper("s_name")})
    return updated.select("s_suppkey", "s_name")


@plans.query("SELECT r_name, count(*) AS n_nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY ALL")
def view_over_join(spark: SparkSession, d: str) -> DataFrame:
    joined = load(spark, d, "region").join(load(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    joined.createOrReplaceTempView("region_nations")
    return spark.sql("SELECT r_name, count(*) AS n_nations FROM region_nations GROUP BY r_name")


@plans.query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) + 99 AS seq FROM customer")
def sequence_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Gap-free numbers from 100 on: a running count over range buckets, not one task for all rows."""
    from tidewheel.operators.aggregates import running_sum

    rows = load(spark, d, "customer").select("c_custkey", F.lit(1).cast("long").alias("one"))
    return running_sum(rows, "c_custkey", [], "one", "seq", 16).select("c_custkey", (F.col("seq") + 99).alias("seq"))
