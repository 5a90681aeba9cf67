"""A Spark session with the settings that the engine expects."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def findable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it lies, unless their path has it: for local sessions started elsewhere.

    On a cluster the package is installed or given with --py-files.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [ROOT])
    return spark


def with_package(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query, or a stage, whose session's workers can find this package."""

    @functools.wraps(query)
    def run(spark: SparkSession, *rest) -> DataFrame:
        return query(findable(spark), *rest)

    return run


def session(name: str = "tidewheel", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """ANSI mode, UTC and adaptive execution; `master` and `partitions` only where given, so that a cluster's own stay."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("TIDEWHEEL_DRIVER_MEMORY", "8g")).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return findable(builder.getOrCreate())
