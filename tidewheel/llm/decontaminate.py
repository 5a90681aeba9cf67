"""Benchmark decontamination (operator 7).

The windows of the benchmark items (n consecutive words; an item of fewer words is
one window) are a broadcast hash set. Tasks scan all windows of their documents
against it; a hit counts once its bytes equal the item's. Spans of hit words are
returned, cut out, or their documents dropped.

The benchmark is not assumed to be small: the size of its distinct items is measured, and
beyond `broadcast_bytes` they are dealt into blocks by a hash of the item. Then one block
after another is brought to the driver, broadcast, and scanned for in a pass of its own; a
pass writes the spans and items of the texts that it hits, by the text's digest, and its
block is freed before the next. Last, documents are joined with what all passes wrote.

Defined cases: null texts have no words and hit nothing, as have null or wordless
items; a null item id is the empty string; rows of equal item ids are one item;
repeated documents each have their own row; empty tables give no hits or no rows;
columns of documents are kept as they are, whatever their names: what is found is the
last column, named `hit`, or with as many `_` behind it as make the name a new one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.bytescan import ALNUM, SpanHash, TextSet, Words, buffers, runs, slices, spread
from tidewheel.llm.shared import Scratch

#: Bytes of item texts in a broadcast block; its windows take some ten times as much in each worker.
BROADCAST_BYTES = 8 << 20

HIT_TYPE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("stop", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
HIT_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])


class WindowSet:
    """All windows of some items as spans of the items' words, and the items that have each: arrays only."""

    def __init__(self, items: list[tuple[str, str]], n: int) -> None:
        raw, ends = buffers(pa.array([t for _, t in items], pa.string()))
        words = Words(raw, ends, ALNUM)
        self.names = [name for name, _ in items]
        count = np.diff(words.number)
        size = np.minimum(count, n)
        self.by_size: dict[int, tuple[TextSet, np.ndarray, np.ndarray]] = {}
        for width in np.unique(size[size > 0]).tolist():
            some = np.flatnonzero(size == width)
            windows = count[some] - width + 1
            first = spread(words.number[some], windows)
            start = words.start[first]
            texts = TextSet(words.text, start, words.end[first + width - 1] - start)
            pairs = np.unique(np.stack([texts.of, np.repeat(some, windows)]), axis=1)
            self.by_size[width] = (texts, np.searchsorted(pairs[0], np.arange(len(texts.start) + 1)), pairs[1])


def hits(words: Words, windows: WindowSet) -> tuple[np.ndarray, list[tuple[int, str]]]:
    """(which words lie inside a window's occurrence, (document, item) pairs)."""
    covered = np.zeros(len(words) + 1, np.int32)
    pairs: set[tuple[int, str]] = set()
    if not len(words) or not windows.by_size:
        return covered[:-1] > 0, []
    span_hash, document = SpanHash(words.text), words.document()
    for size, (texts, owner_at, owners) in windows.by_size.items():
        if len(words) < size:
            continue
        start, end = words.start[: len(words) - size + 1], words.end[size - 1 :]
        at, which = texts.find(words.text, start, end, span_hash(start, end))
        own = document[at] == document[at + size - 1]
        at, which = at[own], which[own]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + size, -1)
        for d, k in np.unique(np.stack([document[at].astype(np.int64), which]), axis=1).T.tolist():
            pairs.update((d, windows.names[x]) for x in owners[owner_at[k] : owner_at[k + 1]].tolist())
    return np.cumsum(covered[:-1]) > 0, sorted(pairs)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, broadcast_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Blocks of (item, text), one of them on the driver at a time; a lone item beyond `broadcast_bytes` is a block."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // broadcast_bytes))
    for k in range(blocks):
        yield [tuple(r) for r in (rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)).collect()]


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, broadcast_bytes: int = BROADCAST_BYTES, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if None) and, last, a column with the number of words, spans of hit words and items found."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    hit = free_name(keep)
    fields = [*(docs.schema[c] for c in keep), T.StructField(hit, HIT_TYPE)]
    blocks = _blocks(benchmark, item_col, item_text_col, broadcast_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        shared = spark.sparkContext.broadcast(WindowSet(first, n))
        return docs.mapInArrow(_scanner(shared, text_col, keep, None), T.StructType(fields))
    scratch = Scratch(spark, "decontaminate")
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.sha2(F.col(text_col).cast("string"), 256).alias("digest"))
    found: DataFrame | None = None
    for items in chain([first, second], blocks):
        shared = spark.sparkContext.broadcast(WindowSet(items, n))
        hits_ = texts.mapInArrow(_scanner(shared, "text", ["digest"], None), T.StructType([T.StructField("digest", T.StringType()), T.StructField("hit", HIT_TYPE)]))
        passed = scratch.keep(hits_.where(F.size("hit.items") > 0).groupBy("digest").agg(F.first("hit").alias("hit")), "pass")
        found = passed if found is None else found.unionByName(passed)
        shared.destroy()
    together = scratch.keep(found.groupBy("digest").agg(F.flatten(F.collect_list("hit.spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("hit.items"))).alias("items")), "found")
    names = [free_name(docs.columns, c) for c in ("digest", "spans", "items")]
    joined = docs.withColumn(names[0], F.sha2(F.col(text_col).cast("string"), 256)).join(together.toDF(*names), names[0], "left").select(*docs.columns, *names[1:])
    return joined.mapInArrow(_scanner(None, text_col, keep, names[1:]), T.StructType(fields))


def _scanner(shared, text_col: str, names: list[str], known: list[str] | None):
    """Scan for a broadcast block, or, with the names of columns that have spans and items, take those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, ends in slices(batch, text_col):
                column = lambda c: rows.column(rows.schema.get_field_index(c))
                words = Words(raw, ends, ALNUM)
                items: list[list[str]] = [[] for _ in range(rows.num_rows)]
                if known:
                    covered = np.zeros(len(words), bool)
                    for d, (spans, found) in enumerate(zip(column(known[0]).to_pylist(), column(known[1]).to_pylist())):
                        items[d] = sorted(found or [])
                        for x in spans or []:
                            covered[words.number[d] + x["first"] : words.number[d] + x["stop"]] = True
                else:
                    covered, pairs = hits(words, shared.value)
                    for d, item in pairs:
                        items[d].append(item)
                first, stop = runs(covered, words.number)
                owner = np.searchsorted(words.number, first, "right") - 1
                base = words.number[owner]
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows.num_rows + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(first - base), pa.array(stop - base)], names=["first", "stop"]))
                hit = pa.StructArray.from_arrays([pa.array(np.diff(words.number)), spans, pa.array(items, pa.list_(pa.string()))], fields=list(HIT_ARROW))
                yield pa.RecordBatch.from_arrays([*map(column, names), hit], names=[*names, free_name(names)])

    return run


def n_hit(hit_col: str = "hit") -> Column:
    return F.aggregate(F.col(f"{hit_col}.spans"), F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"])


def free_name(names: list[str], name: str = "hit") -> str:
    while name in names:
        name += "_"
    return name


def drop_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that share no window with the benchmark, with the columns of docs."""
    scanned = scan(docs, benchmark, **options)
    name = scanned.columns[-1]
    return scanned.where(F.size(f"{name}.spans") == 0).drop(name)


def cut_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All documents, without the spans of hit words; what stands between two words goes with the second."""
    scanned = scan(docs, benchmark, text_col=text_col, **options)
    name, names = scanned.columns[-1], docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, ends in slices(batch, text_col):
                words = Words(raw, ends, ALNUM)
                texts = rows.column(rows.schema.get_field_index(text_col)).to_pylist()
                for d, hit in enumerate(rows.column(rows.schema.get_field_index(name)).to_pylist()):
                    if hit["spans"]:
                        a, own = words.number[d], raw[ends[d] : ends[d + 1]].tobytes()
                        place = np.append(words.begin[a : words.number[d + 1]] - ends[d], len(own))
                        out, at = [], 0
                        for x in hit["spans"]:
                            out.append(own[at : place[x["first"]]])
                            at = place[x["stop"]]
                        texts[d] = b"".join([*out, own[at:]]).decode("utf-8", "replace")
                columns = [pa.array(texts, pa.string()) if c == text_col else rows.column(rows.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return scanned.mapInArrow(run, docs.schema)
