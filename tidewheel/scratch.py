"""The folder that driver and executors share, and the life of what is written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_local: dict[str, tempfile.TemporaryDirectory] = {}  # by application; deleted when the driver ends
_runs: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, as the session has it.

    Where it is unset, a local session (a test) gets a temporary folder of its own; on a cluster that is an error, as no
    machine-local folder would do.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _local:
        _local[app] = tempfile.TemporaryDirectory(prefix="tidewheel-", ignore_cleanup_errors=True)
    return "file://" + _local[app].name


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_runs[-1] if _runs else shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def run(spark: SparkSession) -> Iterator[str]:
    """All that is written inside lies in one folder, which goes at the end: compute and store a result inside.

    Outside of a run, tables of intermediate steps stay in the shared folder, as a lazy result may still read them.
    """
    path = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    _runs.append(path)
    try:
        yield path
    finally:
        _runs.remove(path)
        delete(spark, path)
