"""Queries: change streams, windowed streams, user-defined functions, cursors and prepared statements."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.registry import Registry
from tidewheel.plans.registry import Plans
from tidewheel.scratch import new_path
from tidewheel.streaming import changes, windows
from tidewheel.tables import load

plans = Plans()


def _changes(events: DataFrame) -> DataFrame:
    """Events as changes of users: three sources, types by event id."""
    k = F.col("event_id")
    return events.select(
        "user_id", F.when(k % 5 == 0, "D").when(k % 2 == 0, "U").otherwise("I").alias("type"), (k % 4).cast("int").alias("priority"), F.col("ts").alias("changed_at"),
        (k % 3).cast("int").alias("source"), F.floor(k / 10).alias("transaction"), k.alias("sequence"), "event_type", "value",
    )


_CHANGES = """
SELECT user_id, CASE WHEN event_id % 5 = 0 THEN 'D' WHEN event_id % 2 = 0 THEN 'U' ELSE 'I' END AS type, (event_id % 4)::INTEGER AS priority, ts AS changed_at,
  (event_id % 3)::INTEGER AS source, event_id // 10 AS transaction, event_id AS sequence, event_type, value FROM events
"""


def _again(rows: DataFrame) -> DataFrame:
    """The changes, some of which arrive twice."""
    return rows.unionByName(rows.where("sequence % 7 = 0"))


_AGAIN = f"SELECT * FROM ({_CHANGES}) UNION ALL SELECT * FROM ({_CHANGES}) WHERE sequence % 7 = 0"


def _target(spark: SparkSession, d: str) -> DataFrame:
    """Customers as rows that changes of other databases have made before or between."""
    k = F.col("c_custkey")
    made = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(CAST(c_custkey % 31 AS INT))")
    return load(spark, d, "customer").select(
        k.alias("user_id"), (k % 4).cast("int").alias("priority"), made.alias("changed_at"), (k % 4).cast("int").alias("source"), F.lit(0).cast("long").alias("transaction"), F.lit(0).cast("long").alias("sequence"), F.lit("none").alias("event_type"), F.col("c_acctbal").alias("value")
    )


_TARGET = """
SELECT c_custkey AS user_id, (c_custkey % 4)::INTEGER AS priority, TIMESTAMP '2024-01-01' + to_days((c_custkey % 31)::INTEGER) AS changed_at,
  (c_custkey % 4)::INTEGER AS source, 0::BIGINT AS transaction, 0::BIGINT AS sequence, 'none' AS event_type, c_acctbal AS value FROM customer
"""

#: What stands before each change: all changes of the key in the order of their arrival, after the target's row.
_ARRIVED = f"""
c AS ({_AGAIN}), t AS ({_TARGET}),
a AS (SELECT user_id, type, source, transaction, sequence, changed_at, 1 AS new FROM c UNION ALL SELECT user_id, 'I', source, transaction, sequence, changed_at, 0 FROM t WHERE user_id IN (SELECT user_id FROM c)),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY new, changed_at, source, transaction, sequence) AS n FROM a),
l AS (SELECT *, max(CASE WHEN type IN ('I', 'D') THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS settled FROM n),
e AS (SELECT l.*, coalesce(b.type = 'I', false) AS there FROM l LEFT JOIN n b ON b.user_id = l.user_id AND b.n = l.settled)
"""


@plans.query(f"""
WITH {_ARRIVED}
SELECT user_id, sequence, type, CASE WHEN type = 'I' AND there OR type = 'D' AND NOT there THEN 'error' WHEN type = 'U' AND NOT there THEN 'dropped' ELSE 'applied' END AS outcome FROM e WHERE new = 1
""")
def change_passive(spark: SparkSession, d: str) -> DataFrame:
    """Inserts of rows that are there, and deletes of rows that are not, are errors."""
    return changes.resolve(_target(spark, d), _again(_changes(load(spark, d, "events"))), ["user_id"], "passive").select("user_id", "sequence", "type", "outcome")


@plans.query(f"WITH {_ARRIVED} SELECT user_id, sequence, type, CASE WHEN (type = 'I') = there THEN 'error' ELSE 'applied' END AS outcome FROM e WHERE new = 1")
def change_active(spark: SparkSession, d: str) -> DataFrame:
    """Every change that does not meet the row that it needs is an error."""
    return changes.resolve(_target(spark, d), _again(_changes(load(spark, d, "events"))), ["user_id"], "active").select("user_id", "sequence", "type", "outcome")


@plans.query(f"""
WITH {_ARRIVED},
w AS (SELECT *, max(CASE WHEN (type = 'I') <> there AND type <> 'D' THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS made FROM e),
r AS (SELECT w.*, w.there AND m.source = w.source AND m.transaction = w.transaction AND (w.type = 'I' OR w.type = 'U' AND m.sequence = w.sequence) AS again FROM w LEFT JOIN n m ON m.user_id = w.user_id AND m.n = w.made)
SELECT user_id, sequence, type, CASE WHEN again THEN 'benign' WHEN (type = 'I') = there THEN 'error' ELSE 'applied' END AS outcome FROM r WHERE new = 1
""")
def change_benign(spark: SparkSession, d: str) -> DataFrame:
    """As active, but a repeat of the transaction that made the row is dropped."""
    return changes.resolve(_target(spark, d), _again(_changes(load(spark, d, "events"))), ["user_id"], "benign").select("user_id", "sequence", "type", "outcome")


def _resolved_sql(beats: str, order: str) -> str:
    """The table after each source's last change has met the others and the target's row (whose own source's changes follow it)."""
    return f"""
WITH c AS ({_CHANGES}), t AS ({_TARGET}),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, source ORDER BY transaction DESC, sequence DESC) AS k FROM c),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}, source) AS best FROM s WHERE k = 1),
j AS (
  SELECT t.user_id AS old, w.user_id AS new, t.event_type AS old_type, w.event_type AS new_type, t.value AS old_value, w.value AS new_value, w.type,
    w.user_id IS NOT NULL AND (t.user_id IS NULL OR t.source IN (SELECT source FROM c WHERE c.user_id = t.user_id) OR {beats}) AS wins
  FROM t FULL JOIN (SELECT * FROM w WHERE best = 1) w ON t.user_id = w.user_id
)
SELECT coalesce(old, new) AS user_id, CASE WHEN wins THEN new_type ELSE old_type END AS event_type, CASE WHEN wins THEN new_value ELSE old_value END AS value
FROM j WHERE CASE WHEN wins THEN type <> 'D' ELSE old IS NOT NULL END
"""


_BY_PRIORITY = _resolved_sql("w.priority > t.priority OR w.priority = t.priority AND w.source < t.source", "priority DESC")


@plans.query(_resolved_sql("w.type = 'D' OR w.changed_at > t.changed_at OR w.changed_at = t.changed_at AND w.source < t.source", "changed_at DESC"))
def change_lww(spark: SparkSession, d: str) -> DataFrame:
    """The later row prevails, of equal times the lower database number; deletes always find their row."""
    target = _target(spark, d)
    resolved = changes.resolve(target, _changes(load(spark, d, "events")), ["user_id"], "last_write")
    return changes.apply_resolved(target.select("user_id", "event_type", "value"), resolved, ["user_id"], ["event_type", "value"])


@plans.query(_BY_PRIORITY)
def change_priority(spark: SparkSession, d: str) -> DataFrame:
    """The higher priority prevails, of equal ones the lower database number."""
    target = _target(spark, d)
    resolved = changes.resolve(target, _changes(load(spark, d, "events")), ["user_id"], "priority")
    return changes.apply_resolved(target.select("user_id", "event_type", "value"), resolved, ["user_id"], ["event_type", "value"])


@plans.query(f"""
WITH {_ARRIVED}, x AS (SELECT * FROM e WHERE new = 1),
bad AS (SELECT DISTINCT source, transaction FROM x WHERE (type = 'I') = there)
SELECT 'applied' AS outcome, count(*) AS n FROM x WHERE (type = 'I') <> there
UNION ALL SELECT 'collision', count(*) FROM x WHERE (type = 'I') = there
UNION ALL SELECT 'transactions', count(*) FROM bad
""")
def change_error_modes(spark: SparkSession, d: str) -> DataFrame:
    """Rows in error are skipped; how many of each kind, and in how many transactions."""
    good, errors = changes.split_errors(_again(_changes(load(spark, d, "events"))), ["user_id"], "active", "skip_row", _target(spark, d))
    counted = good.select(F.lit("applied").alias("outcome")).unionByName(errors.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))
    return counted.unionByName(errors.select("source", "transaction").distinct().select(F.lit("transactions").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n")))


def _winner_sql(order: str = "changed_at DESC, source") -> str:
    return f"""
WITH c AS ({_CHANGES}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}, transaction DESC, sequence DESC) AS k FROM c)
SELECT user_id, type, priority, changed_at, source, transaction, sequence, event_type, value FROM r WHERE k = 1
"""


@plans.query(f"SELECT user_id, count(*) AS n_changes, count(DISTINCT source) AS n_sources FROM ({_CHANGES}) GROUP BY ALL HAVING count(DISTINCT source) > 1")
def change_collisions(spark: SparkSession, d: str) -> DataFrame:
    return changes.collisions(_changes(load(spark, d, "events")), ["user_id"])


@plans.query(f"""
WITH w AS ({_winner_sql()}), t AS (SELECT c_custkey AS user_id, 'none' AS event_type, c_acctbal AS value FROM customer)
SELECT coalesce(t.user_id, w.user_id) AS user_id, CASE WHEN w.type IS NULL THEN t.event_type ELSE w.event_type END AS event_type, CASE WHEN w.type IS NULL THEN t.value ELSE w.value END AS value
FROM t FULL JOIN w ON t.user_id = w.user_id WHERE w.type IS NULL OR w.type <> 'D'
""")
def change_apply(spark: SparkSession, d: str) -> DataFrame:
    target = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("none").alias("event_type"), F.col("c_acctbal").alias("value"))
    return changes.apply(target, changes.winners(_changes(load(spark, d, "events")), ["user_id"]), ["user_id"], ["event_type", "value"])


@plans.query(f"""
WITH i AS (SELECT * FROM ({_CHANGES}) WHERE type = 'I')
SELECT sequence, user_id IN (SELECT c_custkey FROM customer) AS collides FROM i
""")
def change_dup_insert(spark: SparkSession, d: str) -> DataFrame:
    target = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    fresh, collide = changes.duplicate_inserts(target, _changes(load(spark, d, "events")), ["user_id"])
    return fresh.select("sequence", F.lit(False).alias("collides")).unionByName(collide.select("sequence", F.lit(True).alias("collides")))


@plans.query(f"""
SELECT user_id, sequence, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY changed_at DESC, source DESC, transaction DESC, sequence DESC) > 1 THEN 1 ELSE 0 END AS in_archive FROM ({_CHANGES})
""")
def change_shadow(spark: SparkSession, d: str) -> DataFrame:
    return changes.shadow(_changes(load(spark, d, "events")), ["user_id"]).select("user_id", "sequence", "in_archive")


@plans.query(f"SELECT user_id, type, value FROM ({_CHANGES}) WHERE priority >= 2")
def change_subset(spark: SparkSession, d: str) -> DataFrame:
    return changes.subset(_changes(load(spark, d, "events")), F.col("priority") >= 2, ["user_id", "type", "value"])


@plans.query(_BY_PRIORITY)
def change_target_types(spark: SparkSession, d: str) -> DataFrame:
    """A protected read-only target: it takes changes, by priority, and sends none."""
    target, incoming = _target(spark, d), _changes(load(spark, d, "events"))
    sent = changes.outgoing(incoming, "protected_read_only").select("user_id", "event_type", "value")
    return changes.deliver(target, incoming, ["user_id"], ["event_type", "value"], "protected_read_only", "priority").select("user_id", "event_type", "value").unionByName(sent)


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(load(spark, d, "events").schema).parquet(f"{d}/events*.parquet")


@plans.query(_winner_sql())
def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    """The change stream applied by micro-batches; the last applied change of each key."""
    path = new_path(spark, "changes")
    write = changes.batch_writer(path, ["user_id"], ["event_type", "value"], "last_write")
    stream = _changes(_stream(spark, d)).writeStream.foreachBatch(write).option("checkpointLocation", f"{path}_checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    columns = ["user_id", "type", "priority", "changed_at", *changes.ORDER, "event_type", "value"]
    return changes.winners(spark.read.parquet(path).select(*columns), ["user_id"])


@plans.query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total
FROM events GROUP BY ALL
""")
def ext_tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    """Extension: not from the reference."""
    values = {"n": F.count("*"), "total": F.sum(F.col("value").cast("decimal(18,4)")).cast("double")}
    return windows.windowed(load(spark, d, "events"), "ts", ["event_type"], values, "1 hour")


@plans.query("""
WITH s AS (SELECT user_id, ts, value, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events))
SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k
""")
def ext_session_window(spark: SparkSession, d: str) -> DataFrame:
    """Extension: not from the reference."""
    return windows.sessions(load(spark, d, "events"), "ts", ["user_id"], {"n": F.count("*")}, "30 minutes")


@plans.query("""
WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, n FROM w
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)
""")
def ext_stream_window(spark: SparkSession, d: str) -> DataFrame:
    """Extension: not from the reference. Windows of a stream that its watermark has closed."""
    path = new_path(spark, "windows")
    events = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.windowed(events, "ts", ["event_type"], {"n": F.count("*")}, "1 hour", late="10 minutes")
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}_checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@plans.query("""
SELECT start AS window_start, start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n
FROM (SELECT event_type, ts, unnest([time_bucket(INTERVAL 15 MINUTES, ts) - INTERVAL (k * 15) MINUTES FOR k IN range(4)]) AS start FROM events) GROUP BY ALL
""")
def ext_sliding_window(spark: SparkSession, d: str) -> DataFrame:
    """Extension: not from the reference."""
    return windows.windowed(load(spark, d, "events"), "ts", ["event_type"], {"n": F.count("*")}, "1 hour", "15 minutes")


@plans.query("""
WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTES AS closed FROM events WHERE event_id % 10 BETWEEN 1 AND 8),
w AS (SELECT event_id % 10 = 0 AS second, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM events)
SELECT window_start, count(*) FILTER (WHERE NOT second OR window_start + INTERVAL 1 HOUR > closed) AS n FROM w, m
GROUP BY window_start, closed HAVING window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events) AND count(*) FILTER (WHERE NOT second OR window_start + INTERVAL 1 HOUR > closed) > 0
""")
def ext_stream_late(spark: SparkSession, d: str) -> DataFrame:
    """Extension: not from the reference. A tenth of the events comes last: what falls into windows that were closed before is late, and left out."""
    path = new_path(spark, "late")
    events = load(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    for part in ("event_id % 10 BETWEEN 1 AND 8", "event_id % 10 = 9", "event_id % 10 = 0"):  # a batch each; a batch closes windows by what came before it
        events.where(part).coalesce(1).write.mode("append").parquet(f"{path}_in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}_in")
    out = windows.windowed(stream, "ts", [], {"n": F.count("*")}, "1 hour", late="10 minutes")
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}_checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


# user-defined functions


def _discounted(price: pd.Series, share: pd.Series) -> pd.Series:
    return price * (1 - share)


class _Letters:
    def eval(self, text: str):
        for k, c in enumerate(text or ""):
            yield k + 1, c


def functions() -> Registry:
    registry = Registry()
    registry.add("discounted", _discounted, ("double", "double"), "double")
    registry.add("letters", _Letters, ("string",), "position int, letter string", "table")
    return registry


@plans.query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS price FROM lineitem")
def udf_scalar(spark: SparkSession, d: str) -> DataFrame:
    registry = functions()
    registry.install(spark)
    price = registry.call("discounted", F.col("l_extendedprice"), F.col("l_discount"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", price.alias("price"))


@plans.query("SELECT n_name, i::INTEGER AS position, n_name[i] AS letter FROM (SELECT n_name, unnest(range(1, length(n_name) + 1)) AS i FROM nation)")
def udtf_split(spark: SparkSession, d: str) -> DataFrame:
    functions().install(spark)
    load(spark, d, "nation").createOrReplaceTempView("nation_letters")
    return spark.sql("SELECT n_name, position, letter FROM nation_letters, LATERAL letters(n_name)")


@plans.query("SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 1000 GROUP BY ALL")
def prepared_statement(spark: SparkSession, d: str) -> DataFrame:
    text = "SELECT n_name, count(*) AS n FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE s_acctbal > :least GROUP BY n_name"
    return spark.sql(text, args={"least": 1000}, supplier=load(spark, d, "supplier"), nation=load(spark, d, "nation"))


