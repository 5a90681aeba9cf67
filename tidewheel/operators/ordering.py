"""Sorting with NULL as the highest value, in either direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key(spec: str | Column) -> Column:
    """`name`, `name asc`, `name desc`, or a column (ascending): NULL is greater than every value."""
    if isinstance(spec, Column):
        return spec.asc_nulls_last()
    name, _, way = spec.partition(" ")
    if way.strip().lower() not in ("", "a", "asc", "d", "desc"):
        raise ValueError(f"no sort direction: {way}")
    return F.col(name).desc_nulls_first() if way.strip().lower().startswith("d") else F.col(name).asc_nulls_last()


def order_by(frame: DataFrame, *specs: str | int | Column) -> DataFrame:
    """Sort by names, columns or 1-based ordinals; without any, by the first column."""
    specs = specs or (1,)
    return frame.orderBy(*(key(frame.columns[s - 1] if isinstance(s, int) else s) for s in specs))


def form_order(frame: DataFrame, fields: dict[str, tuple[int, str]]) -> DataFrame:
    """Sort by a form's fields: each has a sequence number from 1 to 300 and `a` or `d`."""
    if any(not 1 <= n <= 300 for n, _ in fields.values()):
        raise ValueError("sequence numbers are 1 to 300")
    return order_by(frame, *(f"{name} {way}" for name, (_, way) in sorted(fields.items(), key=lambda x: x[1][0])))
