"""Line deduplication with a suffix array over line ids (operator 1).

A run is a sequence of consecutive lines of one document; it counts as repeated if
the same lines also stand at an earlier place, and if it has `min_words` words. Every
line that lies in such a run is deleted there; the first copy stays. Places are
ordered by document id, then line number.

* Line ids are 128-bit hashes of the lines' bytes. The first ranks order them.
* Prefix doubling: the rank of the first 2k lines at a place comes from the rank
  of its first k lines and that of the k lines after them. Ranks are given to the
  distinct pairs, range-partitioned and sorted, so they order the suffixes as a
  suffix array does; equal ranks are an LCP interval of that depth. Places whose
  interval has one member have no repeat that long and leave the table, so it
  shrinks with each round. Doubling ends with the longest run that can decide a line.
* A maximal repeated run with enough words is exactly the union of its shortest
  runs with enough words, taken forward from each of its lines and backward from
  each. Such a run of n lines is named by two overlapping ranks of depth
  2**j <= n; its LCP interval (depth n) has the earlier copies.

Each round writes its table to the shared folder. Hot lines are pre-aggregated
before the shuffle, and joined from written tables, so that adaptive execution
splits a skewed partition.

Defined cases: a null text stays null and has no lines; an empty text is one empty
line; a null id orders first; documents of one id are told apart by their text, and
rows equal in both are one document (each row gets the same result); blank lines have
no words and go with the run around them; empty tables give no rows; all columns
of documents are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.bytescan import NON_BLANK, Words, apart, slices, spread
from tidewheel.llm.shared import Scratch

MIN_WORDS = 10
PLACE = ["d", "t", "i"]
LINES = "d long, t long, i int, a long, b long, sizes array<int>"


def deciding_runs(words: np.ndarray, first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, number of lines) of the shortest runs with enough words, forward and backward from each line.

    `words` is the number of words of each line, and document d has the lines first[d] .. first[d + 1] - 1.
    """
    n = len(words)
    upto = np.concatenate([[0], np.cumsum(words)])
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    line = np.arange(n)
    stop = np.searchsorted(upto, upto[:-1] + min_words, "left")
    forward = stop <= first[owner + 1]
    start = np.searchsorted(upto, upto[1:] - min_words, "right") - 1
    backward = (start >= 0) & (start >= first[owner])
    pairs = np.concatenate([np.stack([line, stop - line])[:, forward], np.stack([start, line + 1 - start])[:, backward]], axis=1)
    pairs = np.unique(pairs, axis=1)
    return pairs[0], pairs[1]


def lines(docs: DataFrame, min_words: int) -> DataFrame:
    """One row per line of `d`, `t`, `text`: its place, its id and the sizes of the deciding runs that start there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, ends in slices(batch, "text"):
                own, at = apart(raw, ends, lower=False)
                stop = np.flatnonzero(own == 10)
                start = np.concatenate([[0], stop[:-1] + 1])
                first = np.searchsorted(stop, at)
                words = np.bincount(Words(raw, ends, NON_BLANK, lines=True).line, minlength=len(stop))
                view = memoryview(own)
                ids = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(start.tolist(), stop.tolist())]), ">i8").astype(np.int64).reshape(-1, 2)
                doc = np.repeat(np.arange(part.num_rows), np.diff(first))
                begin, size = deciding_runs(words, first, min_words)
                sizes = pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, np.arange(len(stop) + 1)), pa.int32()), pa.array(size, pa.int32()))
                index = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(index), part.column(1).take(index), pa.array(np.arange(len(doc)) - first[doc], pa.int32()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), sizes],
                    names=["d", "t", "i", "a", "b", "sizes"],
                )

    return docs.mapInArrow(run, LINES)


def _ranked(pairs: DataFrame, x: str, y: str, scratch: Scratch, label: str) -> DataFrame:
    """Repeated pairs (x, y) with a rank that orders them, and the first place of each."""
    groups = pairs.groupBy(x, y).agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")).where("n > 1")
    ordered = groups.repartitionByRange(x, y).sortWithinPartitions(x, y)
    return scratch.keep(ordered.select(F.col(x).alias("x_"), F.col(y).alias("y_"), F.monotonically_increasing_id().alias("rank"), "first"), label)


def _later():
    return F.struct(*PLACE) != F.col("first")


def _beside(left: DataFrame, right: DataFrame, shift) -> DataFrame:
    """left with the rank that `right` has `shift` lines further on, as `ahead`."""
    ahead = right.select(F.col("d").alias("d_"), F.col("t").alias("t_"), F.col("i").alias("i_"), F.col("rank").alias("ahead"))
    return left.join(ahead, (F.col("d") == F.col("d_")) & (F.col("t") == F.col("t_")) & (F.col("i") + shift == F.col("i_"))).drop("d_", "t_", "i_")


def later_runs(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """d, t, i, size: the deciding runs of `docs` (d, t, text) that also stand at an earlier place."""
    all_lines = scratch.keep(lines(docs, min_words), "lines")
    groups = _ranked(all_lines, "a", "b", scratch, "rank-1")
    level = scratch.keep(
        all_lines.join(groups, (all_lines.a == groups.x_) & (all_lines.b == groups.y_)).select(*PLACE, "rank", _later().alias("later"), "sizes").dropDuplicates(PLACE), "level-1"
    )
    scratch.drop(all_lines, groups)
    wanted = level.select(*PLACE, F.explode("sizes").alias("size"))
    longest = wanted.agg(F.max("size")).first()[0] or 0
    out = level.where("later and array_contains(sizes, 1)").select(*PLACE, F.lit(1).alias("size"))
    depth = 1
    while depth <= longest:
        if depth > 1:
            half = depth // 2
            pairs = scratch.keep(_beside(level.select(*PLACE, "rank"), level, F.lit(half)).withColumnRenamed("rank", "x"), f"pairs-{depth}")
            groups = _ranked(pairs, "x", "ahead", scratch, f"rank-{depth}")
            level = scratch.keep(pairs.join(groups, (pairs.x == groups.x_) & (pairs.ahead == groups.y_)).select(*PLACE, "rank"), f"level-{depth}")
            scratch.drop(pairs, groups)
            if level.isEmpty():
                break
        between = wanted.where((F.col("size") >= max(2, depth)) & (F.col("size") < 2 * depth))
        if depth > 1 or longest > 1:
            named = level.select(*PLACE, "rank").join(between, PLACE)
            named = scratch.keep(_beside(named, level, F.col("size") - depth), f"runs-{depth}")
            first = scratch.keep(named.groupBy("size", "rank", "ahead").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("size").alias("s_"), F.col("rank").alias("x_"), F.col("ahead").alias("y_"), "first"), f"first-{depth}")
            joined = named.join(first, (named.size == first.s_) & (named["rank"] == first.x_) & (named.ahead == first.y_))
            out = out.unionByName(joined.where(_later()).select(*PLACE, "size"))
        depth *= 2
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, removed_col: str | None = "removed", lines_col: str | None = None) -> DataFrame:
    """The documents with later copies of repeated runs deleted from `text_col`.

    `removed_col` gets the numbers of the deleted lines (from 0), `lines_col` the number of lines before.
    """
    if min_words < 1:
        raise ValueError("min_words is at least 1")
    scratch = Scratch(docs.sparkSession, "line-dedup")
    # a null id counts as the smallest there is
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text_col).alias("t")]
    texts = docs.select(*key, F.col(text_col).cast("string").alias("text")).where("text is not null")
    found = later_runs(texts, scratch, min_words)
    runs = scratch.keep(found.groupBy("d", "t").agg(F.collect_set(F.struct("i", "size")).alias("runs")), "runs")
    own = docs.select(F.struct(*docs.columns).alias("row"), *key)
    # by merging at any size: a broadcast of small runs holds much more than their files, and its end moves all texts at once
    joined = own.join(runs.hint("merge"), ["d", "t"], "left").select("row.*", F.col("runs").alias(_free(docs.columns)))
    return joined.mapInArrow(_without(docs.columns, text_col, removed_col, lines_col), _schema(docs, removed_col, lines_col))


def _free(names: list[str]) -> str:
    name = "runs"
    while name in names:
        name += "_"
    return name


def _schema(docs: DataFrame, removed_col: str | None, lines_col: str | None) -> T.StructType:
    more = [T.StructField(removed_col, T.ArrayType(T.IntegerType()))] if removed_col else []
    more += [T.StructField(lines_col, T.LongType())] if lines_col else []
    return T.StructType([*docs.schema.fields, *more])


def _without(columns: list[str], text_col: str, removed_col: str | None, lines_col: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, ends in slices(batch, text_col):
                runs = part.column(part.num_columns - 1)
                counts = np.diff(np.searchsorted(np.flatnonzero(raw == 10), ends)) + 1
                at = part.schema.get_field_index(text_col)
                texts, removed = part.column(at), [[] for _ in range(part.num_rows)]
                touched = np.flatnonzero(runs.is_valid().to_numpy(zero_copy_only=False))
                if len(touched):
                    new = texts.to_pylist()
                    for d in touched.tolist():
                        own = new[d].split("\n")
                        gone = np.zeros(len(own), bool)
                        pairs = np.array([(x["i"], x["size"]) for x in runs[d].as_py()])
                        gone[spread(pairs[:, 0], pairs[:, 1])] = True
                        removed[d] = np.flatnonzero(gone).tolist()
                        new[d] = "\n".join(x for x, g in zip(own, gone) if not g)
                    texts = pa.array(new, texts.type)
                columns_out = [texts if k == at else part.column(k) for k in range(len(columns))]
                names = list(columns)
                if removed_col:
                    columns_out.append(pa.array(removed, pa.list_(pa.int32())))
                    names.append(removed_col)
                if lines_col:
                    null = part.column(at).is_null().to_numpy(zero_copy_only=False)
                    columns_out.append(pa.array(np.where(null, 0, counts).astype(np.int64)))
                    names.append(lines_col)
                yield pa.RecordBatch.from_arrays(columns_out, names=names)

    return run
