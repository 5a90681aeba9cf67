"""Scalar functions of the reference dialect that Spark spells differently or lacks."""

from __future__ import annotations

import re

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# strings


def plus(*parts: Column) -> Column:
    """String `+`: concatenation, NULL if any part is."""
    return F.concat(*parts)


def char_length(column: Column) -> Column:
    """Length of a char value, whose trailing blanks do not count."""
    return F.length(F.rtrim(column))


def squeeze(column: Column) -> Column:
    """Runs of white space become one blank, none stays at the ends."""
    return F.trim(F.regexp_replace(column, r"\s+", " "))


def byteextract(column: Column, n: int) -> Column:
    """The n-th byte (from 1) as binary, empty beyond the end."""
    return F.substring(F.encode(column, "UTF-8"), n, 1)


def locate(column: Column, part: str) -> Column:
    """First position of `part`, from 1; one more than the length if it is not there."""
    at = F.instr(column, part)
    return F.when(at > 0, at).otherwise(F.length(column) + 1)


def bytes_of(column: Column) -> Column:
    """The bytes of a value as an array of integers."""
    raw = F.encode(column, "UTF-8")
    n = F.octet_length(raw)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("long"))).otherwise(F.when(n == 0, F.array().cast("array<bigint>")))


def checksum(column: Column) -> Column:
    """Adler-32 of the bytes: sums modulo 65521, from 1 and 0."""
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def step(s: Column, x: Column) -> Column:
        a = (s["a"] + x) % 65521
        return F.struct(a.alias("a"), ((s["b"] + a) % 65521).alias("b"))

    return F.aggregate(bytes_of(column), start, step, lambda s: s["b"] * 65536 + s["a"])


def hash_value(column: Column, kind: str = "string") -> Column:
    """CRC-32 of the bytes; long types are refused. The final inversion of the original is not known."""
    if kind.startswith("long"):
        raise TypeError("hash() does not take long types")
    return F.crc32(F.encode(column, "UTF-8"))


# numbers


def iftrue(condition: Column, value: Column) -> Column:
    """The value where the condition's number is not zero, else NULL."""
    return F.when(condition != 0, value)


def power(base: Column, exponent: Column | int) -> Column:
    """float ** int."""
    return F.pow(base.cast("double"), exponent if isinstance(exponent, int) else exponent.cast("int"))


#: Fixed value: the largest magnitude of money.
MONEY_LIMIT = "999999999999.99"


def money(column: Column) -> Column:
    """A value as money: two decimals, rounded half up; beyond the limit an error."""
    value = F.round(column.cast("decimal(38,10)"), 2)
    return F.when(F.abs(value) > F.lit(MONEY_LIMIT).cast("decimal(14,2)"), F.raise_error(F.lit("money out of range")).cast("decimal(14,2)")).otherwise(value.cast("decimal(14,2)"))


def money_compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1, on cents."""
    return F.signum((money(left) * 100).cast("long") - (money(right) * 100).cast("long")).cast("int")


def version_text(number: Column) -> Column:
    """xxxyyzz as 'x.y' or, if zz is not 0, 'x.y.z'."""
    parts = [F.floor(number / 10000), F.floor(number / 100) % 100, number % 100]
    x, y, z = (p.cast("long").cast("string") for p in parts)
    return F.when(parts[2] == 0, F.concat_ws(".", x, y)).otherwise(F.concat_ws(".", x, y, z))


# lists, complex numbers, pairs


def list_total(column: Column) -> Column:
    return F.aggregate(column, F.lit(0).cast("double"), lambda s, x: s + x)


def list_locate(column: Column, value: Column) -> Column:
    """First position of the value from 1, 0 if it is not there."""
    return F.array_position(column, value)


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def complex_add(a: Column, b: Column) -> Column:
    return complex_of(a["re"] + b["re"], a["im"] + b["im"])


def complex_multiply(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def conjugate(z: Column) -> Column:
    return complex_of(z["re"], -z["im"])


def complex_abs(z: Column) -> Column:
    return F.sqrt(z["re"] * z["re"] + z["im"] * z["im"])


def polar(z: Column) -> Column:
    return F.struct(complex_abs(z).alias("radius"), F.atan2(z["im"], z["re"]).alias("angle"))


def pair(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(p: Column, q: Column) -> Column:
    dx, dy = p["x"] - q["x"], p["y"] - q["y"]
    return F.sqrt(dx * dx + dy * dy)


def slope(p: Column, q: Column) -> Column:
    """NULL for a vertical line."""
    return F.when(p["x"] != q["x"], (q["y"] - p["y"]) / (q["x"] - p["x"]))


def midpoint(p: Column, q: Column) -> Column:
    return pair((p["x"] + q["x"]) / 2, (p["y"] + q["y"]) / 2)


# plane geometry: a path is an array of pairs, a polygon a path that closes by itself


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once for a row: a lambda makes what it mentions of the outside anew for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _edges(path: Column) -> Column:
    n = F.size(path)
    pairs = F.zip_with(path, F.slice(path, 2, F.greatest(n, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))  # the last has no end
    return F.when(n > 1, F.slice(pairs, 1, n - 1)).otherwise(F.array().cast("array<struct<p:struct<x:double,y:double>,q:struct<x:double,y:double>>>"))


def _closed(polygon: Column) -> Column:
    return F.concat(polygon, F.slice(polygon, 1, 1))


def _length(path: Column) -> Column:
    return F.aggregate(_edges(path), F.lit(0.0), lambda s, e: s + distance(e["p"], e["q"]))


def path_length(path: Column) -> Column:
    return _once(path, _length)


def perimeter(polygon: Column) -> Column:
    return _once(polygon, lambda given: _once(_closed(given), _length))


def area(polygon: Column) -> Column:
    def twice(path: Column) -> Column:
        return F.aggregate(_edges(path), F.lit(0.0), lambda s, e: s + (e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]))

    return F.abs(_once(polygon, lambda given: _once(_closed(given), twice))) / 2


def inside(point: Column, polygon: Column) -> Column:
    """Whether a ray from the point crosses the border an odd number of times."""

    def crosses(at: Column, e: Column) -> Column:
        p, q = e["p"], e["q"]
        straddles = (p["y"] > at["y"]) != (q["y"] > at["y"])
        x = (q["x"] - p["x"]) * (at["y"] - p["y"]) / F.when(q["y"] != p["y"], q["y"] - p["y"]).otherwise(1.0) + p["x"]
        return straddles & (at["x"] < x)

    def odd(at: Column, path: Column) -> Column:
        return F.size(F.filter(_edges(path), lambda e: crosses(at, e))) % 2 == 1

    return _once(point, lambda at: _once(polygon, lambda given: _once(_closed(given), lambda path: odd(at, path))))


def boxes_intersect(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    return (a_low["x"] <= b_high["x"]) & (b_low["x"] <= a_high["x"]) & (a_low["y"] <= b_high["y"]) & (b_low["y"] <= a_high["y"])


def type_name(column: Column) -> Column:
    return F.typeof(column)


def all_of(*conditions: Column) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))


#: Geometry types by code, with the number of dimensions of what they describe.
GEOMETRIES = {
    "point": 0, "linestring": 1, "polygon": 2, "multipoint": 0, "multilinestring": 1, "multipolygon": 2, "geometrycollection": 2,
}
VARIANTS = {"": 0, "Z": 1000, "M": 2000, "ZM": 3000}


def geometry_code(name: Column) -> Column:
    """The numeric code of a geometry's name, with Z, M or ZM behind it: point 1, pointz 1001, and so on."""
    codes = {base + v.lower(): k + plus for k, base in enumerate(GEOMETRIES, 1) for v, plus in VARIANTS.items()}
    return F.try_element_at(F.create_map(*(F.lit(x) for pair_ in codes.items() for x in pair_)), F.lower(name))


def geometry_dimension(code: Column) -> Column:
    """0 for points, 1 for lines, 2 for areas and collections."""
    dimensions = {k: n for k, n in enumerate(GEOMETRIES.values(), 1)}
    return F.try_element_at(F.create_map(*(F.lit(x) for pair_ in dimensions.items() for x in pair_)), code % 1000)


def blank_padded(column: Column) -> Column:
    """A char value: trailing blanks do not count in comparisons, grouping and joins."""
    return F.collate(column, "UTF8_BINARY_RTRIM")


def display(column: Column, form: str) -> Column:
    """A value in a display format: iW whole numbers and fW.D numbers to the right, eW.D in powers of ten, cW texts to the left.

    W is the width; 0 is as wide as the value. A number that is wider is shown as stars, a longer text is cut.
    """
    found = re.fullmatch(r"([ifec])(\d+)(?:\.(\d+))?", form)
    if not found:
        raise ValueError(f"no such format: {form}")
    kind, width, places = found[1], int(found[2]), int(found[3] or 0)
    if kind == "c":
        text = column.cast("string")
        return F.rpad(F.left(text, F.lit(width)), width, " ") if width else text
    if kind == "i":
        text = F.round(column.cast("decimal(38,6)"), 0).cast("decimal(38,0)").cast("string")
    elif kind == "f":
        text = column.cast(f"decimal(38,{places})").cast("string")
    else:
        text = F.format_string(f"%.{places}e", column.cast("double"))
    return F.when(F.length(text) > width, F.lit("*" * width)).otherwise(F.lpad(text, width, " ")) if width else text
