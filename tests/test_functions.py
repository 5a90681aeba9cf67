import datetime as dt
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel.functions import dates, patterns
from tidewheel.functions import scalars as S
from tidewheel.functions.registry import Registry
from tidewheel.operators import aggregates, dml, joins, ordering
from tidewheel.sources import copy
from tidewheel.streaming import changes


def values(frame, column):
    return [r[0] for r in frame.select(column).collect()]


def quel(pattern, text):
    """A plain matcher: * ? [] and a backslash."""
    if not pattern:
        return not text
    if pattern[0] == "*":
        return any(quel(pattern[1:], text[k:]) for k in range(len(text) + 1))
    if not text:
        return False
    if pattern[0] == "?":
        return quel(pattern[1:], text[1:])
    if pattern[0] == "[" and "]" in pattern:
        end = pattern.index("]")
        body, ok, k = pattern[1:end], False, 0
        while k < len(body):
            if k + 2 < len(body) and body[k + 1] == "-":
                ok |= body[k] <= text[0] <= body[k + 2]
                k += 3
            else:
                ok |= body[k] == text[0]
                k += 1
        return ok and quel(pattern[end + 1 :], text[1:])
    return pattern[0] == text[0] and quel(pattern[1:], text[1:])


@given(st.lists(st.sampled_from(["*", "?", "[a-c]", "[xz]", "a", "b", ".", "x", "$"]), max_size=6).map("".join), st.text("abcxz.$", max_size=6))
@settings(max_examples=300, deadline=None)
def test_quel_patterns(pattern, text):
    import re

    assert bool(re.search(patterns.quel_regex(pattern), text)) == quel(pattern, text)


def test_quel_pattern_in_spark(spark):
    frame = spark.createDataFrame([("Q1A",), ("Q12",), ("Q1a",), (None,)], "s string")
    assert values(frame, patterns.quel_match(F.col("s"), "Q[0-9][A-Z]")) == [True, False, False, None]


@pytest.mark.parametrize("pattern, escape, text, result", [("a%", None, "abc", True), ("a\\%", "\\", "abc", False), ("a\\%", "\\", "a%", True), ("\\[0-3\\]_", "\\", "2x", True), ("\\[0-3\\]_", "\\", "4x", False), ("100\\%", "\\", "100%", True)])
def test_like(spark, pattern, escape, text, result):
    assert values(spark.createDataFrame([(text,)], "s string"), patterns.like(F.col("s"), pattern, escape)) == [result]


def test_bad_patterns():
    with pytest.raises(ValueError):
        patterns.like_regex("abc\\", "\\")
    with pytest.raises(ValueError):
        patterns.quel_regex("[z-a]")


def test_qualification(spark):
    frame = spark.createDataFrame([(k, f"Name {k}") for k in range(5)], "k int, s string")
    assert values(frame.where(patterns.qualification(F.col("k"), ">= 3")), "k") == [3, 4]
    assert values(frame.where(patterns.qualification(F.col("s"), "*2")), "k") == [2]
    assert values(frame.where(patterns.qualification(F.col("s"), "!= '*2'")), "k") == [0, 1, 3, 4]
    assert frame.where(patterns.qualification(F.col("s"), "  ")).count() == 5


@pytest.mark.parametrize("text", ["", "abc", "Wikipedia", "é" * 40])
def test_checksum_is_adler32(spark, text):
    assert values(spark.createDataFrame([(text,)], "s string"), S.checksum(F.col("s"))) == [zlib.adler32(text.encode())]


def test_strings_and_numbers(spark):
    frame = spark.createDataFrame([("  a \t b\n", 110203, 0), (None, 20100, 5)], "s string, v int, c int")
    assert values(frame, S.squeeze(F.col("s"))) == ["a b", None]
    assert values(frame, S.version_text(F.col("v"))) == ["11.2.3", "2.1"]
    assert values(frame, S.iftrue(F.col("c"), F.col("v"))) == [None, 20100]
    assert values(frame, S.locate(F.lit("abc"), "x")) == [4, 4]
    with pytest.raises(TypeError):
        S.hash_value(F.col("s"), "long varchar")


def test_money(spark):
    frame = spark.createDataFrame([("1.005",), ("-2.345",)], "s string")
    assert [str(x) for x in values(frame, S.money(F.col("s")))] == ["1.01", "-2.35"]
    with pytest.raises(Exception, match="money out of range"):
        spark.range(1).select(S.money(F.lit("1000000000000"))).collect()


def test_intervals(spark):
    assert dates.parse_interval("1 yrs 2 mos 3 days 12 hrs 24 mins 48 secs") == {"years": 1, "months": 2, "days": 3, "hours": 12, "mins": 24, "secs": 48}
    for wrong in ("", "3", "3 parsecs", "1 day x"):
        with pytest.raises(ValueError):
            dates.parse_interval(wrong)
    frame = spark.createDataFrame([(dt.datetime(2024, 1, 31),)], "t timestamp_ntz")
    assert values(frame, dates.add(F.col("t"), "1 month")) == [dt.datetime(2024, 2, 29)]
    assert values(frame, dates.subtract(F.col("t"), "7 days")) == [dt.datetime(2024, 1, 24)]


@pytest.mark.parametrize("text", ["10-nov-1991", "10/NOV/1991", "NOV/10/1991", "11/10/1991", "1991-11-10", "1991.11.10", "1991_11_10", "19911110", " 10-Nov-1991 ", "NOV-10-1991", "11-10-91", "11/10/91", "10-NOV-91", "10/nov/91", "91/11/10", "NOVEMBER 10, 1991", "november 10, 1991", "Nov 10, 1991", "111091"])
def test_date_forms(spark, text):
    assert values(spark.createDataFrame([(text,)], "s string"), dates.parse_date(F.col("s"))) == [dt.date(1991, 11, 10)]


def test_years_of_two_digits_and_single_digits(spark):
    frame = spark.createDataFrame([("1-2-03",), ("1-2-1993",), ("jan 5, 2020",), ("12/31/50",), ("12/31/49",), ("13/31/49",)], "s string")
    got = values(frame, dates.parse_date(F.col("s")))
    assert got == [dt.date(2003, 1, 2), dt.date(1993, 1, 2), dt.date(2020, 1, 5), dt.date(1950, 12, 31), dt.date(2049, 12, 31), None]


def test_times_and_spans(spark):
    frame = spark.createDataFrame([("9:05",), ("12:00:01 am",), ("12:30 PM",), ("23:59:59.5",), ("24:00",), ("13:00 pm",), ("x",)], "s string")
    assert values(frame, dates.parse_as("time", F.col("s"))) == [32700.0, 1.0, 45000.0, 86399.5, None, None, None]
    frame = spark.createDataFrame([("2 yrs 3 mos",), ("-1 day 2 hours",), ("5",), ("3 parsecs",), ("1 wk 30 secs",)], "s string")
    assert [x and (x.months, x.seconds) for x in values(frame, dates.parse_as("interval", F.col("s")))] == [(27, 0.0), (0, -79200.0), None, None, (0, 604830.0)]
    with pytest.raises(ValueError):
        dates.parse_as("money", F.col("s"))


def test_display_formats(spark):
    frame = spark.createDataFrame([(12.345, "abcdef"), (-98765.4, "x")], "v double, s string")
    assert values(frame, S.display(F.col("v"), "f7.1")) == ["   12.3", "*******"]
    assert values(frame, S.display(F.col("v"), "i6")) == ["    12", "-98765"]
    assert values(frame, S.display(F.col("s"), "c3")) == ["abc", "x  "]
    assert values(frame, S.display(F.col("v"), "e10.2")) == ["  1.23e+01", " -9.88e+04"]
    with pytest.raises(ValueError):
        S.display(F.col("v"), "q3")


def test_dates_that_are_none(spark):
    frame = spark.createDataFrame([("",), ("31-feb-1991",), ("nonsense",), (None,)], "s string")
    assert values(frame, dates.parse_date(F.col("s"))) == [None] * 4


def test_gmt_of_far_years(spark):
    seconds = [0, -1, 253402300799, 253402300800, 518400000000, -62101036800, -62135596801, -62167219201, None]
    frame = spark.createDataFrame([(s,) for s in seconds], "s long")
    shown = ["1970_01_01 00:00:00", "1969_12_31 23:59:59", "9999_12_31 23:59:59", "10000_01_01 00:00:00", "18397_06_11 00:00:00", "0002_02_05 00:00:00", "0000_12_31 23:59:59", "-1_12_31 23:59:59"]
    expected = [f"{x} GMT" for x in shown] + [None]
    assert values(frame, dates.gmt_timestamp(F.col("s"))) == expected
    assert values(frame, dates.date_gmt(F.timestamp_seconds("s").cast("timestamp_ntz"))) == expected


def test_names_of_months_and_days(spark):
    frame = spark.createDataFrame([("feb", "mon"), ("MAY", "Sunday"), ("7", "x"), ("13", None)], "m string, d string")
    assert values(frame, dates.month_number(F.col("m"))) == [2, 5, 7, None]
    assert values(frame, dates.day_number(F.col("d"))) == [2, 1, None, None]


def test_geometry(spark):
    square = F.array(*(S.pair(F.lit(x), F.lit(y)) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))))
    row = spark.range(1).select(S.area(square), S.perimeter(square), S.inside(S.pair(F.lit(1), F.lit(1)), square), S.inside(S.pair(F.lit(5), F.lit(1)), square), S.slope(S.pair(F.lit(1), F.lit(0)), S.pair(F.lit(1), F.lit(9)))).first()
    assert tuple(row) == (16.0, 16.0, True, False, None)


def test_geometry_of_odd_paths(spark):
    p = lambda x, y: {"x": float(x), "y": float(y)}
    rows = [([p(0, 0), p(3, 4), p(3, 0)],), ([p(1, 2)],), ([],), (None,), ([p(0, 0), None, p(3, 0)],), ([p(0, 0), p(6, 0), p(6, 6), p(3, 1), p(0, 6)],)]
    frame = spark.createDataFrame(rows, "g array<struct<x:double,y:double>>")
    g = F.col("g")
    assert values(frame, S.path_length(g))[:5] == [9.0, 0.0, 0.0, 0.0, None]
    assert values(frame, S.perimeter(g))[:5] == [12.0, 0.0, 0.0, 0.0, None]
    assert values(frame, S.area(g)) == [6.0, 0.0, 0.0, 0.0, None, 21.0]
    assert values(frame, S.inside(S.pair(F.lit(2), F.lit(1)), g)) == [True, False, False, False, False, True]
    assert values(frame, S.inside(S.pair(F.lit(3), F.lit(4)), g)) == [False] * 6
    assert values(frame, S.inside(F.lit(None).cast("struct<x:double,y:double>"), g)) == [False] * 6


@pytest.mark.parametrize("function", [S.path_length, S.perimeter, S.area, lambda g: S.inside(S.pair(F.lit(1), F.lit(1)), g)])
def test_geometry_makes_its_polygon_once(spark, function):
    frame = spark.createDataFrame([], "g array<struct<x:double,y:double>>")
    assert frame.select(function(F.reverse("g")).alias("f"))._jdf.queryExecution().analyzed().toString().count("reverse(") == 1


def test_nulls_sort_high(spark):
    frame = spark.createDataFrame([(2,), (None,), (1,)], "k int")
    assert values(ordering.order_by(frame, "k"), "k") == [1, 2, None]
    assert values(ordering.order_by(frame, "k desc"), "k") == [None, 2, 1]
    assert values(ordering.order_by(frame), "k") == [1, 2, None]
    with pytest.raises(ValueError):
        ordering.form_order(frame, {"k": (301, "a")})


@pytest.mark.parametrize("others", [[], [1, 2], [1, None], [3, 3]])
@pytest.mark.parametrize("operator", ["=", "!=", "<", "<=", ">", ">="])
def test_quantified_comparisons(spark, operator, others):
    import duckdb

    mine = [1, 2, 3, None]
    frame = spark.createDataFrame([(x,) for x in mine], "k int")
    other = spark.createDataFrame([(x,) for x in others], "v int")
    for word, f in (("ANY", joins.quantified_any), ("ALL", joins.quantified_all)):
        sql = f"SELECT k FROM (SELECT unnest({mine!r}::INTEGER[]) AS k) WHERE k {operator} {word} (SELECT unnest({others!r}::INTEGER[]))".replace("None", "NULL")
        wanted = sorted((r[0] for r in duckdb.sql(sql).fetchall()), key=repr)
        assert sorted(values(f(frame, "k", operator, other, "v"), "k"), key=repr) == wanted, (word, operator, others)


def test_ambiguous_update(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    source = spark.createDataFrame([(1, "x"), (None, "y")], "k int, w string")
    out = dml.update_from(target, source, {"k": "k"}, {"v": F.upper("w")})
    assert sorted(out.collect(), key=repr) == sorted(spark.createDataFrame([(1, "X"), (2, "b"), (None, "c")], "k int, v string").collect(), key=repr)
    strange = spark.createDataFrame([(9, "x"), (9, "y")], "k int, w string")
    assert dml.update_from(target, source.union(strange), {"k": "k"}, {"v": F.upper("w")}).count() == 3  # they meet no target row
    with pytest.raises(Exception, match="ambiguous update"):
        dml.update_from(target, source.union(source), {"k": "k"}, {"v": F.col("w")}).collect()


def test_natural_join_needs_common_columns(spark):
    with pytest.raises(ValueError):
        joins.natural_join(spark.range(1).toDF("a"), spark.range(1).toDF("b"))


def test_running_sum_over_buckets(spark):
    frame = spark.createDataFrame([(k * 7 % 100, k) for k in range(100)], "k int, v long")
    got = {r.k: r.s for r in aggregates.running_sum(frame, "k", [], "v", "s", 8).collect()}
    total, want = 0, {}
    for k, v in sorted((k * 7 % 100, k) for k in range(100)):
        total += v
        want[k] = total
    assert got == want


@pytest.mark.parametrize("style", [*copy.DELIMITERS, "|"])
def test_copy_round_trip(spark, tmp_path, style):
    rows = [(1, "plain", None), (2, 'quote " comma , semi ; end', "x"), (3, "", "y")] if style in ("csv", "ssv") else [(1, "plain", None), (2, "ab", "x"), (3, "", "y")]
    frame = spark.createDataFrame(rows, "k int, s string, n string")
    fields = [copy.Field("k", "int"), copy.Field("s"), copy.Field("n", null="NONE")]
    copy.copy_into(frame, str(tmp_path / "f"), fields, style)
    assert sorted(map(tuple, copy.copy_from(spark, str(tmp_path / "f"), fields, style).collect())) == sorted(rows)


def test_copy_of_line_breaks(spark, tmp_path):
    rows = [(1, "two\nlines"), (2, "one")]
    fields = [copy.Field("k", "int"), copy.Field("s")]
    copy.copy_into(spark.createDataFrame(rows, "k int, s string"), str(tmp_path / "f"), fields, "csv")
    assert sorted(map(tuple, copy.copy_from(spark, str(tmp_path / "f"), fields, "csv", line_breaks=True).collect())) == rows


def test_copy_refuses_null_without_a_text(spark, tmp_path):
    with pytest.raises(Exception, match="has no null text"):
        copy.copy_into(spark.createDataFrame([(None,)], "s string"), str(tmp_path / "f"), [copy.Field("s")])
    with pytest.raises(ValueError):
        copy.delimiter("no such")


CHANGE = "k int, type string, priority int, changed_at int, source int, transaction int, sequence int, v string"


def test_change_errors_go_aside(spark, tmp_path):
    batch = spark.createDataFrame([(1, "I", 0, 1, 0, 1, 1, "a"), (1, "U", 0, 2, 1, 2, 2, "b"), (None, "I", 0, 3, 0, 1, 3, "c"), (2, "?", 0, 4, 0, 3, 4, "d"), (3, "I", 0, 5, 0, 4, 5, "e")], CHANGE)
    path = str(tmp_path / "out")
    for _ in range(2):  # a repeated batch replaces itself
        changes.batch_writer(path, ["k"], ["v"], "last_write", "skip_row")(batch, 0)
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "b"), (3, "e")]
    assert sorted(r.reason for r in spark.read.parquet(path + "_errors").collect()) == ["malformed"] * 2
    # the insert goes with its transaction, so the update has no row any more
    changes.batch_writer(path + "2", ["k"], ["v"], "active")(batch, 0)
    assert sorted((r.k, r.v) for r in spark.read.parquet(path + "2").collect()) == [(3, "e")]
    assert sorted(r.reason for r in spark.read.parquet(path + "2_errors").collect()) == ["collision", "malformed", "malformed", "transaction"]
    for mode in ("quiet_cdds", "quiet_database", "quiet_server"):
        with pytest.raises(changes.Quieted):
            changes.batch_writer(path + mode, ["k"], ["v"], "last_write", mode)(batch, 0)
    changes.batch_writer(path + "4", ["k"], ["v"], "last_write", "quiet_cdds")(batch.where("k = 3"), 1)
    with pytest.raises(ValueError):
        changes.resolve(None, batch, ["k"], "no mode")
    with pytest.raises(ValueError):
        changes.split_errors(batch, ["k"], "active", "no mode")


def plain_outcomes(there, rows, mode):
    """One change after another, as the modes are described: (outcomes by row number, keys and values in the end)."""
    state = {k: (source, transaction, sequence, v) for k, (_, _, source, transaction, sequence, v) in there.items()}
    out = {}
    for n, (k, kind, _, _, source, transaction, sequence, v) in sorted(enumerate(rows), key=lambda x: (x[1][3], *x[1][4:7])):
        row = state.get(k)
        repeat = mode == "benign" and row and row[:2] == (source, transaction) and (kind == "I" or kind == "U" and row[2] == sequence)
        if repeat:
            out[n] = "benign"
        elif kind == "I" and row or kind == "D" and not row or kind == "U" and not row and mode != "passive":
            out[n] = "error"
        elif kind == "U" and not row:
            out[n] = "dropped"
        else:
            out[n] = "applied"
            if kind == "D":
                del state[k]
            else:
                state[k] = (source, transaction, sequence, v)
    return out, {k: x[3] for k, x in state.items()}


def plain_resolution(there, rows, mode):
    """Keys and values after the last change of each source has met the others, and the target's row."""
    out = {}
    rank = (lambda c: c[2] or 0) if mode == "priority" else (lambda c: c[3])
    for k in {r[0] for r in rows} | there.keys():
        last = {}
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[5:7]):
            last[r[4]] = r
        best = min(last.values(), key=lambda r: (-rank(r), r[4]), default=None)
        old = there.get(k)
        if best and old and old[2] not in last:
            mine = (old[0] or 0) if mode == "priority" else old[1]
            if not (mode == "last_write" and best[1] == "D") and (rank(best), -best[4]) <= (mine, -old[2]):
                best = None
        if best:
            if best[1] != "D":
                out[k] = best[7]
        elif old:
            out[k] = old[5]
    return out


@pytest.mark.parametrize("mode", changes.DETECTING + changes.RESOLVING)
def test_collision_modes_one_change_after_another(spark, mode):
    rng = random.Random(mode)
    there = {k: (rng.choice([None, 1, 2]), rng.randrange(20), rng.randrange(4), 0, 0, f"old{k}") for k in range(0, 40, 2)}
    rows = []
    for n in range(400):
        rows.append((rng.randrange(40), rng.choice("IUD"), rng.choice([None, 0, 1, 2, 3]), rng.randrange(20), rng.randrange(3), n // 3, n, f"v{n}"))
    if mode == "benign":
        rows += [r for r in rows if rng.random() < 0.3]
    target = spark.createDataFrame([(k, *x) for k, x in there.items()], "k int, priority int, changed_at int, source int, transaction int, sequence int, v string")
    resolved = changes.resolve(target, spark.createDataFrame(rows, CHANGE).repartition(3), ["k"], mode).collect()
    assert len(resolved) == len(rows)
    final = changes.apply_resolved(target.select("k", "v"), spark.createDataFrame(resolved, CHANGE + ", outcome string"), ["k"], ["v"])
    if mode in changes.DETECTING:
        want, _ = plain_outcomes(there, rows, mode)
        assert sorted((r.sequence, r.outcome) for r in resolved) == sorted((rows[n][6], x) for n, x in want.items())
        assert {x for _, x in want.items()} == {"passive": {"applied", "error", "dropped"}, "active": {"applied", "error"}, "benign": {"applied", "error", "benign"}}[mode]
    else:
        assert {r.k: r.v for r in final.collect()} == plain_resolution(there, rows, mode)


def test_registry(spark):
    registry = Registry()
    with pytest.raises(ValueError):
        registry.add("f", None, (), "int")
    with pytest.raises(ValueError):
        registry.add("f", len, ("int",) * 5, "int")


def test_cursor_and_session_facts(spark):
    from tidewheel.operators.cursor import dbmsinfo, fetch

    batches = list(fetch(spark.range(0, 25, 1, 3), 10))
    assert [len(b) for b in batches] == [10, 10, 5] and [r.id for b in batches for r in b] == list(range(25))
    assert dbmsinfo(spark, "_VERSION") == spark.version and dbmsinfo(spark, "nothing") == ""


@pytest.mark.parametrize("name, node", [("hash_join_hint", "ShuffledHashJoin"), ("merge_join_hint", "SortMergeJoin")])
def test_hinted_joins_are_planned(spark, small, name, node):
    from tidewheel import plans

    assert node in plans.QUERIES[name](spark, small)._jdf.queryExecution().sparkPlan().toString()


def test_cut_off_records(spark, tmp_path):
    (tmp_path / "f").write_text("1\na\n2\n")
    with pytest.raises(Exception, match="fewer than 2 lines"):
        copy.copy_from(spark, str(tmp_path / "f"), [copy.Field("k", "int"), copy.Field("s")], "nl").collect()
    with pytest.raises(Exception, match="line break"):
        copy.copy_into(spark.createDataFrame([("a\nb",)], "s string"), str(tmp_path / "g"), [copy.Field("s")], "nl")


def test_runs_leave_nothing_behind(spark, small):
    import os

    from tidewheel import plans, scratch

    with scratch.run(spark) as folder:
        assert plans.QUERIES["copy_roundtrip_tab"](spark, small).count() > 0
        place = folder.removeprefix("file:").replace("//", "/")
        assert os.listdir(place)
    assert not os.path.exists(place)
