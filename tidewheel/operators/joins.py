"""Joins beyond what one DataFrame call says."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.ordering import key


def common(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns of the same name and type, in the left's order."""
    kinds = dict(right.dtypes)
    return [c for c, t in left.dtypes if kinds.get(c) == t]


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner", first_only: bool = False) -> DataFrame:
    """Join on all common columns, as a detail table; with first_only on the first one, as a look-up table."""
    names = common(left, right)
    if not names:
        raise ValueError("the tables have no common columns")
    return left.join(right, names[:1] if first_only else names, how)


def master_detail(master: DataFrame, detail: DataFrame, on: dict[str, str], order: list[str], into: str = "details") -> DataFrame:
    """One row per master row with its detail rows as an array, in order; [] where there are none.

    Details are grouped by the join columns before the join, so a master row meets one row. An array holds all details
    of one master row.
    """
    columns = [c for c in detail.columns if c not in on.values()]
    rows = detail.groupBy(*(F.col(d).alias(f"_{d}") for d in on.values())).agg(F.sort_array(F.collect_list(F.struct(*order, *(c for c in columns if c not in order)))).alias(into))
    matched = master.join(rows, reduce(Column.__and__, (master[m] == rows[f"_{d}"] for m, d in on.items())), "left")
    return matched.drop(*(f"_{d}" for d in on.values())).withColumn(into, F.coalesce(into, F.array().cast(dict(rows.dtypes)[into])))


def in_column(frame: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Rows whose value is in another table's column."""
    return frame.join(other.select(F.col(other_column).alias("_in")), F.col(column) == F.col("_in"), "left_semi")


def exists(frame: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    return frame.join(other, on, "left_semi")


def not_exists(frame: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    return frame.join(other, on, "left_anti")


_LIMITS = {"<": "max", "<=": "max", ">": "min", ">=": "min"}


def _compare(left: Column, operator: str, right: Column) -> Column:
    return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[operator]


def quantified_any(frame: DataFrame, column: str, operator: str, other: DataFrame, other_column: str) -> DataFrame:
    """column <operator> ANY (select other_column): equality is a semi join, an order needs only the extreme value."""
    values = other.select(F.col(other_column).alias("_any"))
    if operator in _LIMITS:
        limit = values.agg(F.expr(f"{_LIMITS[operator]}(_any)").alias("_any"))
        return frame.join(F.broadcast(limit), _compare(F.col(column), operator, F.col("_any")), "left_semi")  # one row
    if operator == "!=":
        bounds = values.agg(F.min("_any").alias("_low"), F.max("_any").alias("_high"))
        return frame.join(F.broadcast(bounds), (F.col(column) != F.col("_low")) | (F.col(column) != F.col("_high")), "left_semi")
    return frame.join(values, F.col(column) == F.col("_any"), "left_semi")


def quantified_all(frame: DataFrame, column: str, operator: str, other: DataFrame, other_column: str) -> DataFrame:
    """column <operator> ALL (select other_column), with SQL's rule for NULL: a NULL among the values leaves no row, no values leave every row."""
    facts = other.agg(F.count("*").alias("_n"), F.count(other_column).alias("_known"), F.min(other_column).alias("_low"), F.max(other_column).alias("_high"))
    value = F.col(column)
    test = {
        "<": value < F.col("_low"),
        "<=": value <= F.col("_low"),
        ">": value > F.col("_high"),
        ">=": value >= F.col("_high"),
        "=": (value == F.col("_low")) & (value == F.col("_high")),
    }
    if operator == "!=":
        values = other.select(F.col(other_column).alias("_all"))
        known = frame.join(F.broadcast(facts), (F.col("_n") == 0) | ((F.col("_n") == F.col("_known")) & value.isNotNull()), "left_semi")
        return known.join(values, value == F.col("_all"), "left_anti")
    return frame.join(F.broadcast(facts), (F.col("_n") == 0) | ((F.col("_n") == F.col("_known")) & test[operator]), "left_semi")


def scalar(frame: DataFrame, other: DataFrame, aggregate: Column, name: str) -> DataFrame:
    """Add one value computed from another table."""
    return frame.crossJoin(F.broadcast(other.agg(aggregate.alias(name))))  # one row


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, tie: str, values: list[str]) -> DataFrame:
    """Each left row with the `values` of the last right row of the same `by` at or before its time.

    One shuffle on `by`: both sides in one frame, sorted by time (right rows first), and the last right row seen carried on.
    The columns of left are kept; `tie` orders right rows of equal time.
    """
    from pyspark.sql import Window

    kept = [c for c in left.columns if c not in by]
    payload = F.struct(*values)
    rows = left.select(*by, F.col(left_time).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*kept).alias("_own"), F.lit(None).cast(right.select(payload.alias("x")).schema["x"].dataType).alias("_seen"))
    marks = right.select(*by, F.col(right_time).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(rows.schema["_own"].dataType).alias("_own"), payload.alias("_seen"))
    window = Window.partitionBy(*by).orderBy("_at", "_side", key("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.unionByName(marks).withColumn("_last", F.last("_seen", ignorenulls=True).over(window))
    return seen.where("_side = 1").select(*by, "_own.*", *(F.col(f"_last.{v}").alias(v) for v in values))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points joined with the ranges [low, high] that hold them, by an equi-join on cells of `width`."""
    cell = lambda c: F.floor(F.col(c) / F.lit(width))
    spans = ranges.withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    return points.withColumn("_cell", cell(point)).join(spans, "_cell").where(F.col(point).between(F.col(low), F.col(high))).drop("_cell")
