"""Pattern dialects as anchored regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _set(body: str) -> str:
    """The inside of a bracket: characters and ranges, nothing else is special."""
    out = []
    k = 0
    while k < len(body):
        if k + 2 < len(body) and body[k + 1] == "-":
            low, high = body[k], body[k + 2]
            if low > high:
                raise ValueError(f"range {low}-{high} runs backwards")
            out.append(f"{_literal(low)}-{_literal(high)}")
            k += 3
        else:
            out.append(_literal(body[k]))
            k += 1
    return "[" + "".join(out) + "]"


def _literal(c: str) -> str:
    return c if c.isalnum() or ord(c) > 127 else f"\\{c}"


def quel_regex(pattern: str) -> str:
    """`*` is any text, `?` one character, `[a-z]` a range or set; a backslash takes the next character as it is."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            out.append(_literal(pattern[k + 1]))
            k += 1
        elif c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif c == "[" and "]" in pattern[k + 1 :]:
            end = pattern.index("]", k + 1)
            out.append(_set(pattern[k + 1 : end]))
            k = end
        else:
            out.append(_literal(c))
        k += 1
    return "^" + "".join(out) + "$"


def like_regex(pattern: str, escape: str | None = None) -> str:
    """SQL LIKE; after the escape character `%`, `_` and itself are plain, and `[` opens a range that escape + `]` ends."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if escape and c == escape:
            k += 1
            if k == len(pattern):
                raise ValueError("the pattern ends with its escape character")
            if pattern[k] == "[":
                end = pattern.find(escape + "]", k + 1)
                if end < 0:
                    raise ValueError("a range is not closed")
                out.append(_set(pattern[k + 1 : end]))
                k = end + 1
            else:
                out.append(_literal(pattern[k]))
        elif c == "%":
            out.append("(?s:.*)")
        elif c == "_":
            out.append("(?s:.)")
        else:
            out.append(_literal(c))
        k += 1
    return "^" + "".join(out) + "$"


def quel_match(column: Column, pattern: str) -> Column:
    return column.rlike(quel_regex(pattern))


def like(column: Column, pattern: str, escape: str | None = None) -> Column:
    """Plain patterns stay LIKE, which a scan can use; ranges become a regular expression."""
    if escape is None or escape + "[" not in pattern:
        return column.like(pattern) if escape is None else column.rlike(like_regex(pattern, escape))
    return column.rlike(like_regex(pattern, escape))


_OPERATOR = re.compile(r"\s*(!=|<>|<=|>=|=|<|>)?\s*(.*?)\s*$", re.S)


def qualification(column: Column, typed: str) -> Column:
    """What a user typed into a query form's field: an operator (default =) and a value; * ? [] make a pattern.

    An empty field restricts nothing.
    """
    operator, value = _OPERATOR.match(typed).groups()
    if not value and not operator:
        return F.lit(True)
    value = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    if operator in (None, "=", "!=", "<>") and re.search(r"[*?\[]", value):
        match = quel_match(column.cast("string"), value)
        return ~match if operator in ("!=", "<>") else match
    return {None: column == value, "=": column == value, "!=": column != value, "<>": column != value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}[operator]
