"""Reading the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: list[str] = NAMES) -> None:
    """Temporary views of the tables, for SQL text."""
    for name in names:
        load(spark, folder, name).createOrReplaceTempView(name)
