"""What several operators need: tables written in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewheel.scratch import delete, new_path
from tidewheel.tables import load as table  # noqa: F401


class Scratch:
    """Tables of one run of an operator, as Parquet in the shared folder.

    keep() writes a frame and reads it back, which cuts its lineage: a lost executor
    costs no more than the step that was running. What is not dropped stays until the
    end of scratch.run(), if the operator was called in one, as its result may read it.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = new_path(spark, name)
        self.count = 0

    def path(self, label: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{label}"

    def keep(self, frame: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        frame.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(frame.schema).parquet(path)
        kept.kept_at = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        """Delete kept tables that no later step reads."""
        for frame in frames:
            delete(self.spark, frame.kept_at)
