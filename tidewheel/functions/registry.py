"""User-defined functions: a catalogue of names with their types, registered in a session."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Entry:
    name: str
    use: str  # scalar or table
    arguments: tuple[str, ...]
    result: str
    function: Callable


class Registry:
    """Functions added by name; a table function is a class with an eval method, a scalar one takes and gives pandas series."""

    def __init__(self) -> None:
        self.entries: dict[str, Entry] = {}

    def add(self, name: str, function: Callable | None, arguments: tuple[str, ...], result: str, use: str = "scalar") -> None:
        if function is None:
            raise ValueError(f"{name} has no function")
        if len(arguments) > 4:
            raise ValueError("a function has at most four arguments")
        self.entries[name] = Entry(name, use, arguments, result, function)

    def install(self, spark: SparkSession) -> None:
        for e in self.entries.values():
            if e.use == "table":
                spark.udtf.register(e.name, F.udtf(e.function, returnType=e.result))
            else:
                spark.udf.register(e.name, F.pandas_udf(e.function, e.result))

    def call(self, name: str, *columns: Column) -> Column:
        return F.call_function(name, *columns)

    def catalogue(self, spark: SparkSession) -> DataFrame:
        rows = [(e.name, e.use, len(e.arguments), ",".join(e.arguments), e.result) for e in self.entries.values()]
        return spark.createDataFrame(rows, "name string, use string, n_arguments int, arguments string, result string")
