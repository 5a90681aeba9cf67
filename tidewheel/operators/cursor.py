"""Cursors and session facts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession


def fetch(frame: DataFrame, rows: int = 100) -> Iterator[list[Row]]:
    """Open a cursor: lists of at most `rows` rows, while the driver holds one partition at a time."""
    cursor = frame.toLocalIterator(prefetchPartitions=False)
    while batch := list(islice(cursor, rows)):
        yield batch


def dbmsinfo(spark: SparkSession, name: str) -> str:
    """A fact about the session by its name; an unknown name gives an empty text."""
    facts = {
        "_version": spark.version,
        "database": spark.catalog.currentDatabase(),
        "username": spark.sparkContext.sparkUser(),
        "session_id": spark.sparkContext.applicationId,
        "on_error_state": "rollback statement" if spark.conf.get("spark.sql.ansi.enabled") == "true" else "continue",
    }
    return facts.get(name.lower(), "")
