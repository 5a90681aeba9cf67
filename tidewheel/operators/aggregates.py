"""Aggregates with the reference dialect's names and report-style totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.ordering import key


def any_(condition: Column | None = None) -> Column:
    """1 if any row (for which the condition holds) is there, else 0."""
    return F.coalesce(F.max(F.lit(1) if condition is None else F.when(condition, 1)), F.lit(0))


def countu(column: str) -> Column:
    return F.count_distinct(column)


def sumu(column: str | Column) -> Column:
    return F.sum_distinct(F.col(column) if isinstance(column, str) else column)


def avgu(column: str | Column) -> Column:
    """Mean of the distinct values, as a double."""
    value = F.col(column) if isinstance(column, str) else column
    return F.sum_distinct(value).cast("double") / F.count_distinct(value)


def break_report(frame: DataFrame, breaks: list[str], totals: dict[str, Column], level: str = "level") -> DataFrame:
    """Footers of a control-break report: totals for each group of each break level and for the report.

    `level` is the number of break columns that are set: all of them in the innermost footer, 0 in the report's.
    """
    rolled = frame.rollup(*breaks).agg(F.grouping_id().alias("_id"), *(c.alias(n) for n, c in totals.items()))
    unset = F.bit_count(F.col("_id"))
    return rolled.withColumn(level, (F.lit(len(breaks)) - unset).cast("int")).drop("_id")


def running(frame: DataFrame, by: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Cumulative aggregates from the start of each `by` group, in the given order."""
    window = Window.partitionBy(*by).orderBy(*map(key, order)).rowsBetween(Window.unboundedPreceding, 0)
    return frame.select("*", *(c.over(window).alias(n) for n, c in values.items()))


def _bucket(column: Column, bounds: list, low: int, high: int) -> Column:
    """The number of bounds below a value, by halving: as many comparisons as the logarithm of the bounds."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(column <= F.lit(bounds[middle]), _bucket(column, bounds, low, middle)).otherwise(_bucket(column, bounds, middle + 1, high))


def running_sum(frame: DataFrame, order: str, ties: list[str], value: str, into: str, buckets: int | None = None) -> DataFrame:
    """Cumulative sum from the start of the report, without sorting all rows in one task.

    `order` is cut at approximate quantiles into buckets (as many as there are shuffle partitions, 1000 at most); inside
    a bucket a window runs over its rows, and the totals of the buckets before (one row for each bucket) are added.
    `order` with `ties` has to be unique, and not null.
    """
    buckets = buckets or min(1000, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / buckets for k in range(1, buckets)] or [0.5]
    bounds = sorted(set(frame.agg(F.percentile_approx(order, shares).alias("b")).first()["b"] or []))
    dealt = frame.withColumn("_bucket", _bucket(F.col(order), bounds, 0, len(bounds)))
    totals = dealt.groupBy("_bucket").agg(F.sum(value).alias("_total"))
    before = totals.select("_bucket", F.coalesce(F.sum("_total").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_bucket").orderBy(key(order), *map(key, ties)).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_inside", inside).join(F.broadcast(before), "_bucket").withColumn(into, F.col("_inside") + F.col("_before")).drop("_bucket", "_inside", "_before")


def break_changed(columns: list[str], order: list[str], by: list[str] | None = None) -> Column:
    """The most major of `columns` (1-based) whose value differs from the row before; 0 if none, 1 on the first row."""
    window = Window.partitionBy(*(by or [])).orderBy(*map(key, order))
    first = F.row_number().over(window) == 1
    out = F.when(first, 1)
    for k, c in enumerate(columns, 1):
        out = out.when(~F.col(c).eqNullSafe(F.lag(c).over(window)), k)
    return out.otherwise(0)


def once_per_break(frame: DataFrame, breaks: list[str], totals: dict[str, Column]) -> DataFrame:
    """Aggregates that take each group of break values once, not each row."""
    return frame.select(*breaks).distinct().agg(*(c.alias(n) for n, c in totals.items()))


def accumulate(partials: DataFrame, by: list[str], parts: dict[str, str]) -> DataFrame:
    """Merge partial aggregates: partial counts (and `any`) are added, the others are aggregated again by their own name."""
    merge = {"count": F.sum, "sum": F.sum, "any": F.max, "min": F.min, "max": F.max}
    return partials.groupBy(*by).agg(*(merge[kind](c).alias(c) for c, kind in parts.items()))


def crosstab(frame: DataFrame, row: str, column: str, values: list[str], value: Column) -> DataFrame:
    """A row for each `row` and a column for each of `values`; absent cells are NULL."""
    return frame.groupBy(row).pivot(column, values).agg(value)
