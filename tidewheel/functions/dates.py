"""Dates and intervals of the reference dialect."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of months and of week days (a week begins with Sunday, number 1).
MONTHS = "january february march april may june july august september october november december".split()
DAYS = "sunday monday tuesday wednesday thursday friday saturday".split()

#: Spellings of interval units.
UNITS = {
    "years": "years year yrs yr",
    "months": "months month mos mo",
    "weeks": "weeks week wks wk",
    "days": "days day",
    "hours": "hours hour hrs hr",
    "mins": "minutes minute mins min",
    "secs": "seconds second secs sec",
}
_UNIT = {word: unit for unit, words in UNITS.items() for word in words.split()}

#: Input forms of a date literal; y is a year of two digits.
FORMS = [
    "dd-MMM-yyyy", "dd/MMM/yyyy", "MMM/dd/yyyy", "MMM-dd-yyyy", "MMM dd, yyyy", "MM/dd/yyyy", "MM-dd-yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyy_MM_dd", "yyyyMMdd",
    "dd-MMM-y", "dd/MMM/y", "MMM/dd/y", "MMM-dd-y", "MM/dd/y", "MM-dd-y", "y/MM/dd", "MMddy",
]
#: The first year that two digits can mean.
FIRST_YEAR = 1950


def parse_interval(text: str) -> dict[str, float]:
    """'1 yrs 2 mos 3 days' as amounts by unit; a sign may stand before each number."""
    parts = re.findall(r"([+-]?\s*\d+(?:\.\d+)?)\s*([A-Za-z]+)", text)
    if not parts or re.sub(r"[+-]?\s*\d+(?:\.\d+)?\s*[A-Za-z]+", "", text).strip():
        raise ValueError(f"not an interval: {text!r}")
    out: dict[str, float] = {}
    for number, word in parts:
        unit = _UNIT.get(word.lower())
        if unit is None:
            raise ValueError(f"no unit of time: {word}")
        out[unit] = out.get(unit, 0) + float(number.replace(" ", ""))
    return out


def interval(text: str) -> Column:
    amounts = parse_interval(text)
    whole = {u: F.lit(int(n)) for u, n in amounts.items() if u != "secs"}
    return F.make_interval(**whole, **({"secs": F.lit(amounts["secs"]).cast("decimal(18,6)")} if "secs" in amounts else {}))


def add(column: Column, text: str) -> Column:
    """date + 'text interval'; a month later than the day allows ends at its last day."""
    return column + interval(text)


def subtract(column: Column, text: str) -> Column:
    return column - interval(text)


def parse_date(column: Column, first_year: int = FIRST_YEAR) -> Column:
    """A date literal in any of the input forms; an empty text is an empty date (NULL), other texts that fit none are NULL.

    Months may be names or abbreviations in any case. A year of two digits is the one in the hundred years from
    `first_year` on, and stands first only where the first number can be no month.
    """
    tidy = F.lower(F.trim(column))
    name = F.regexp_extract(tidy, "[a-z]+", 0)
    spelt = F.array(*map(F.lit, MONTHS))
    known = F.try_element_at(F.filter(spelt, lambda m: (m == name) | (F.left(m, F.lit(3)) == name)), F.lit(1))
    fixed = F.when(name == "", tidy).otherwise(F.replace(tidy, name, F.initcap(F.left(known, F.lit(3)))))
    fixed = F.regexp_replace(fixed, r"^(\D*)(\d)(\D)", "$10$2$3")  # a day or month of one digit
    fixed = F.regexp_replace(fixed, r"^(\d\d[-/])(\d[-/])", "$10$2")

    def read(text: Column) -> Column:
        found = []
        for form in FORMS:
            value = F.try_to_timestamp(text, F.lit(form)).cast("date") if "yyyy" in form else _two_digits(text, form, first_year)
            found.append(F.when(text.rlike(_shape(form)), value))
        return F.coalesce(*found)

    return F.element_at(F.transform(F.array(fixed), read), 1)  # the tidied text is made once for all forms


def _shape(form: str) -> str:
    """A pattern of the texts in a form."""
    parts = {"MMM": "[A-Z][a-z][a-z]", "MM": r"\d\d", "dd": r"\d\d", "yyyy": r"\d{4}", "y": r"\d\d", ".": "[.]"}
    return "^" + re.sub("MMM|MM|dd|yyyy|y|[.]", lambda m: parts[m[0]], form) + "$"


def _two_digits(text: Column, form: str, first_year: int) -> Column:
    """A date whose year has two digits, which stand first or last."""
    year = F.left(text, F.lit(2)) if form.startswith("y") else F.right(text, F.lit(2))
    number = year.cast("int")
    whole = (F.floor((F.lit(first_year - 1) - number) / 100) + 1) * 100 + number
    long = F.concat(whole.cast("string"), F.substring(text, 3, 100)) if form.startswith("y") else F.concat(F.left(text, F.length(text) - 2), whole.cast("string"))
    return F.try_to_timestamp(long, F.lit(form.replace("y", "yyyy"))).cast("date")


def parse_time(column: Column) -> Column:
    """Seconds since midnight of a time of day: hh:mm, hh:mm:ss with or without a fraction, am or pm behind it; other texts are NULL."""
    tidy = F.lower(F.trim(column))
    get = lambda k: F.regexp_extract(tidy, _TIME, k)
    hour, half = F.try_to_number(get(1), F.lit("99")).cast("int"), get(4)
    clock = F.when(half == "", hour).when(half == "am", hour % 12).otherwise(hour % 12 + 12)
    minute = F.try_to_number(get(2), F.lit("99")).cast("int")
    second = F.coalesce(F.nullif(get(3), F.lit("")).cast("double"), F.lit(0.0))
    fits = (minute < 60) & (second < 60) & F.when(half == "", hour < 24).otherwise(hour.between(1, 12))
    return F.when(tidy.rlike(_TIME) & fits, clock * 3600 + minute * 60 + second)


_TIME = r"^(\d\d?):(\d\d)(?::(\d\d(?:\.\d+)?))?\s*(am|pm)?$"


def parse_spans(column: Column) -> Column:
    """A column of text intervals ('2 yrs 3 days') as (months long, seconds double); texts that are none are NULL."""
    tidy = F.lower(F.trim(column))
    amount = {u: F.aggregate(F.regexp_extract_all(tidy, F.lit(rf"([+-]?\d+(?:\.\d+)?)\s*(?:{words.replace(' ', '|')})\b"), F.lit(1)), F.lit(0.0), lambda a, x: a + x.cast("double")) for u, words in UNITS.items()}
    every = "|".join(" ".join(UNITS.values()).split())
    fits = tidy.rlike(rf"^(?:[+-]?\d+(?:\.\d+)?\s*(?:{every})\b\s*)+$")
    months = amount["years"] * 12 + amount["months"]
    seconds = amount["weeks"] * 604800 + amount["days"] * 86400 + amount["hours"] * 3600 + amount["mins"] * 60 + amount["secs"]
    return F.when(fits, F.struct(F.round(months).cast("long").alias("months"), seconds.alias("seconds")))


def parse_as(kind: str, column: Column) -> Column:
    """An input text by the type that is asked for: date, time or interval."""
    readers = {"date": parse_date, "time": parse_time, "interval": parse_spans}
    if kind not in readers:
        raise ValueError(f"no such type: {kind}")
    return readers[kind](column)


def month_number(column: Column) -> Column:
    """A month's number from its number, name or three-letter abbreviation; NULL otherwise."""
    names = F.create_map(*(x for k, m in enumerate(MONTHS, 1) for name in sorted({m, m[:3]}) for x in (F.lit(name), F.lit(k))))
    number = F.try_element_at(names, F.lower(F.trim(column)))
    digits = F.when(F.trim(column).rlike("^(0?[1-9]|1[0-2])$"), F.trim(column)).cast("int")
    return F.coalesce(number, digits)


def day_number(column: Column) -> Column:
    """A week day's number from its name or three-letter abbreviation, Sunday 1; NULL otherwise."""
    names = F.create_map(*(x for k, m in enumerate(DAYS, 1) for name in (m, m[:3]) for x in (F.lit(name), F.lit(k))))
    return F.try_element_at(names, F.lower(F.trim(column)))


def days_in_month(column: Column) -> Column:
    return F.day(F.last_day(column))


def date_kind(column: str, intervals: str) -> Column:
    """1 absolute, 2 interval, 0 empty: the one date type as two columns."""
    return F.when(F.col(column).isNotNull(), 1).when(F.col(intervals).isNotNull(), 2).otherwise(0)


def _gmt(time: Column) -> Column:
    """The text by its parts: a formatted year beyond 9999 would begin with a plus sign, and one before 1 would count backwards."""
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    year = F.year(time)
    shown = F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    day, clock = F.concat_ws("_", two(F.month(time)), two(F.day(time))), F.concat_ws(":", two(F.hour(time)), two(F.minute(time)), two(F.second(time)))
    return F.concat(shown, F.lit("_"), day, F.lit(" "), clock, F.lit(" GMT"))


def date_gmt(column: Column, zone: str = "UTC") -> Column:
    """'yyyy_MM_dd HH:mm:ss GMT' of a local time of the zone; a year of more digits is written as it is."""
    return _gmt(F.convert_timezone(F.lit(zone), F.lit("UTC"), column))


def gmt_timestamp(seconds: Column) -> Column:
    return _gmt(F.timestamp_seconds(seconds))


def components(seconds: Column) -> Column:
    """Year, month, day, hour, minute, second of seconds since 1970 (UTC)."""
    t = F.timestamp_seconds(seconds)
    return F.struct(*(f(t).alias(n) for n, f in (("year", F.year), ("month", F.month), ("day", F.day), ("hour", F.hour), ("minute", F.minute), ("second", F.second))))


def part(name: str, column: Column) -> Column:
    """A date part by its name."""
    return F.date_part(F.lit(name), column)
