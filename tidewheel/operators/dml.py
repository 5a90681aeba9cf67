"""INSERT, UPDATE and DELETE as new frames: Parquet tables are rewritten, not changed in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class AmbiguousUpdate(ValueError):
    """More than one source row for a target row."""


def insert(target: DataFrame, source: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Append source rows; target columns that `columns` (default: the source's) does not name are NULL."""
    names = columns or source.columns
    rows = source.toDF(*names)
    return target.unionByName(rows.select(*(F.col(c).cast(t) if c in names else F.lit(None).cast(t).alias(c) for c, t in target.dtypes)))


def update_from(target: DataFrame, source: DataFrame, on: dict[str, str], assign: dict[str, Column], check: bool = True) -> DataFrame:
    """UPDATE target FROM source: columns of `assign` (over target and source columns) where a source row matches.

    With `check`, several source rows that meet one target row are an error ("ambiguous update") when the result is
    computed; repeated source keys that meet none are not. It costs one aggregation of the source, which the join needs
    on the same keys anyway.
    """
    keys = list(on.values())
    rows = source.where(reduce(Column.__and__, (F.col(k).isNotNull() for k in keys)))
    others = [c for c in source.columns if c not in keys]
    grouped = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count("*").alias("_n"), F.min(F.struct(*others) if others else F.lit(1)).alias("_row"))
    joined = target.join(grouped, reduce(Column.__and__, (target[t] == grouped[f"_{k}"] for t, k in on.items())), "left")
    if check:
        ambiguous = F.raise_error(F.lit("ambiguous update: several source rows for one target row")).cast("boolean")
        joined = joined.where(F.coalesce(F.when(F.col("_n") > 1, ambiguous), F.lit(True)))
    wide = joined.select(*target.columns, "_n", *(F.col(f"_row.{c}").alias(c) for c in others)) if others else joined
    kinds = dict(target.dtypes)
    return wide.select(*(F.when(F.col("_n").isNotNull(), assign[c]).otherwise(F.col(c)).cast(kinds[c]).alias(c) if c in assign else F.col(c) for c in target.columns))


def update_where(target: DataFrame, condition: Column, assign: dict[str, Column]) -> DataFrame:
    kinds = dict(target.dtypes)
    return target.select(*(F.when(condition, assign[c]).otherwise(F.col(c)).cast(kinds[c]).alias(c) if c in assign else F.col(c) for c in target.columns))


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true (a NULL condition deletes nothing)."""
    return target.where(~F.coalesce(condition, F.lit(False)))


def modify(frame: DataFrame, path: str, structure: str, keys: list[str], partitions: int | None = None) -> None:
    """Rewrite a table with another layout: heap as it is, hash by key, isam and btree in key order."""
    if structure == "hash":
        frame = frame.repartition(*([partitions] if partitions else []), *keys)
    elif structure in ("isam", "btree"):
        frame = frame.repartitionByRange(*([partitions] if partitions else []), *keys).sortWithinPartitions(*keys)
    elif structure == "truncated":
        frame = frame.limit(0)
    elif structure != "heap":
        raise ValueError(f"no such structure: {structure}")
    frame.write.mode("overwrite").parquet(path)
