"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from tidewheel import plans
from tidewheel.tables import NAMES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def rows(names, found):
    return sorted(tuple(map(repr, r)) for r in zip(*(found[c] for c in names)))


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_same_as_sql(spark, duck, small, name):
    ours = plans.QUERIES[name](spark, small).toArrow()
    theirs = duck.sql(plans.ORACLE[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert rows(ours.column_names, ours.to_pydict()) == rows(ours.column_names, theirs.to_pydict())


@pytest.mark.parametrize("name", sorted(plans.QUERIES.keys() - plans.ORACLE.keys()))
def test_runs_without_sql(spark, small, name):
    assert plans.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert plans.QUERIES.keys() <= __spark_entry__.queries().keys()
    assert plans.ORACLE.keys() <= __spark_entry__.oracle_sql().keys()


def test_stream_windows_are_those_of_the_batch(spark, small):
    from pyspark.sql import functions as F

    from tidewheel.streaming.windows import windowed
    from tidewheel.tables import load

    batch = {(r.window_start, r.event_type): r.n for r in windowed(load(spark, small, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], {"n": F.count("*")}, "1 hour").collect()}
    stream = plans.QUERIES["ext_stream_window"](spark, small).collect()
    assert all(batch[r.window_start, r.event_type] == r.n for r in stream)
    assert 0 <= len(batch) - len(stream) < 20  # the last windows are still open
