"""Approximate nearest neighbours with an inverted multi-index (operator 5).

The two halves of a vector are quantised by codebooks of their own; a cell is a pair
of centroids. A query visits cells in ascending order of the summed squared distances
of its halves to the pair, which a heap gives one by one, until the visited cells hold
`candidates` entries; their entries are reranked by exact distance.

* The codebooks are fitted on a bounded sample: the `sample` entries of smallest hash.
  Every vector is indexed.
* Equal vectors are one entry, which keeps its k + 1 smallest ids: no more can be
  among anyone's k nearest. Equal queries are searched once.
* Cells are dealt to buckets of about `bucket_entries` entries, and a large cell to
  several, so no task's share grows with the input. A query goes to each bucket that
  holds a part of its cells, once, with the list of those cells. Each bucket returns
  its k + 1 nearest, and those are merged.
* The cell counts on the driver are bounded by the square of `max_centroids`.

How many entries a query visits follows from the data: the sample's own neighbours are
sought exactly, and `candidates` is the share of entries that has to be visited to find
`recall` of them, times all entries. Clustered vectors need few; vectors without structure
need half of all or more (see the README for recall against brute force).

Cells are made from vectors that are centred and scaled, with what lies far out brought
near, so that any finite components can be told apart; a cell decides only who is visited.
Distances are exact, on the original vectors: a matrix product narrows the choice, by no
more than its proven rounding error allows.

Defined cases: vectors that are null, of another than the table's commonest length (the
shorter, on a tie), all zero, or with null or non-finite components are neither
indexed nor queries; null ids take no part; rows of equal id and vector are one;
ties in distance go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.shared import Scratch

BUCKET_ENTRIES, SAMPLE, MAX_CENTROIDS = 4096, 20_000, 1024
#: Recall to reach on the sample, and how many of its entries are sought to measure it.
RECALL, PROBES = 0.95, 400
#: Where components beyond the sample's usual size are brought to, in units of that size.
FAR = 64.0


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v of the rows that may take part, whatever the length of their vectors."""
    v = F.col("v")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(ok)


def commonest_length(rows: DataFrame) -> int:
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return size.n if size else 0


def entries(rows: DataFrame, ids_kept: int) -> DataFrame:
    """Distinct vectors with their smallest ids; the window's limit is applied before its shuffle too."""
    smallest = rows.distinct().withColumn("k", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("k") <= ids_kept)
    return smallest.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from k evenly spaced points."""
    centroids = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(rounds):
        nearest = squared(points, centroids).argmin(axis=1)
        count = np.bincount(nearest, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, nearest, points)
        centroids[count > 0] = total[count > 0] / count[count > 0, None]
    return centroids


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)


def halves(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (vectors.shape[1] + 1) // 2
    return vectors[:, :cut], vectors[:, cut:]


def traverse(left: np.ndarray, right: np.ndarray, count: np.ndarray, wanted: int) -> list[int]:
    """Cells in ascending order of left[i] + right[j] until they hold `wanted` entries; empty ones are passed over."""
    order_l, order_r = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    ls, rs = left[order_l].tolist(), right[order_r].tolist()
    ol, orr, width = order_l.tolist(), order_r.tolist(), len(rs)
    heap = [(ls[0] + rs[0], 0, 0)]
    out: list[int] = []
    seen = 0
    while heap and seen < wanted:
        _, i, j = heapq.heappop(heap)
        cell = ol[i] * width + orr[j]
        if n := count[cell]:
            out.append(cell)
            seen += n
        if j + 1 < width:
            heapq.heappush(heap, (ls[i] + rs[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(ls):
            heapq.heappush(heap, (ls[i + 1] + rs[0], i + 1, 0))
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


class Frame:
    """Where vectors lie for the cells: centred on the sample's medians, in units of their usual distance from them."""

    def __init__(self, sample: np.ndarray) -> None:
        self.unit = unit_of(sample)
        scaled = sample * self.unit
        self.centre = np.median(scaled, axis=0)
        off = np.abs(scaled - self.centre)
        usual = np.median(off[off > 0]) if (off > 0).any() else 1.0
        self.usual = max(usual, 1e-150)

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip((vectors * self.unit - self.centre) / self.usual, -FAR, FAR)


def unit_of(vectors: np.ndarray) -> float:
    """A power of two that brings the largest component below 1, and the numbers around it into range."""
    largest = float(np.abs(vectors).max()) if vectors.size else 1.0
    return 2.0 ** min(-np.frexp(largest)[1], 1000)


def exact(base: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; scaled by a power of two where squares leave its range."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        d = base - query
        out = np.sqrt((d * d).sum(axis=1))
        odd = np.flatnonzero(~np.isfinite(out) | ((out < 1e-140) & (d != 0).any(axis=1)))
        for i in odd.tolist():
            part, back = (d[i], 1.0) if np.isfinite(d[i]).all() else (base[i] / 16 - query / 16, 16.0)
            unit = unit_of(part)
            out[i] = np.sqrt(((part * unit) ** 2).sum()) / unit * back
    return out


def nearest(queries: np.ndarray, base: np.ndarray, ids: list[np.ndarray], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the k smallest (distance, id), by exact distance.

    A product of centred vectors narrows the choice: an entry stays unless its rough squared distance less the rounding
    error that it can have exceeds the k-th smallest with its own error added.
    """
    out = []
    unit = min(unit_of(base), unit_of(queries))
    centre = np.median(base * unit, axis=0)
    near_base = base * unit - centre
    size_base = np.sqrt((near_base * near_base).sum(axis=1))
    share = 8 * (base.shape[1] + 8) * np.finfo(float).eps
    for lo in range(0, len(queries), 256):
        part = queries[lo : lo + 256] * unit - centre
        size_part = np.sqrt((part * part).sum(axis=1))
        for q, size, row in zip(queries[lo : lo + 256], size_part, squared(part, near_base)):
            close = np.arange(len(row))
            if len(row) > k:
                error = share * (size + size_base) ** 2 + 1e-290
                limit = np.partition(row + error, k - 1)[k - 1]
                close = np.flatnonzero(row - error <= limit)
            distances = exact(base[close], q)
            count = np.fromiter((len(ids[x]) for x in close), np.int64, len(close))
            distance, names = np.repeat(distances, count), np.concatenate([ids[x] for x in close])
            best = np.lexsort((names, distance))[:k]
            out.append((names[best], distance[best]))
    return out


def share_to_visit(sample: np.ndarray, left: np.ndarray, right: np.ndarray, k: int, recall: float, probes: int = PROBES) -> float:
    """The share of entries that queries visit before they have met `recall` of their k nearest, on the sample."""
    if len(sample) < 2:
        return 1.0
    a, b = halves(sample)
    to_left, to_right = squared(a, left), squared(b, right)
    cell_left, cell_right = to_left.argmin(axis=1), to_right.argmin(axis=1)
    k = min(k, len(sample) - 1)
    ranks = []
    for i in range(0, len(sample), -(-len(sample) // probes)):
        distance = squared(sample[i : i + 1], sample)[0]
        distance[i] = np.inf
        order = to_left[i][cell_left] + to_right[i][cell_right]
        ahead = np.sort(np.delete(order, i))
        ranks.append(np.searchsorted(ahead, order[np.argpartition(distance, k - 1)[:k]], "right"))
    return float(np.quantile(np.concatenate(ranks), recall, method="higher")) / (len(sample) - 1)


def search(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, candidates: int | None = None, recall: float = RECALL, sample: int = SAMPLE, bucket_entries: int = BUCKET_ENTRIES, max_centroids: int = MAX_CENTROIDS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries` its k nearest rows of `rows` with another id."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "multi-index")
    good = usable(rows, id_col, vector_col)
    size = commonest_length(good)
    good = good.where(F.size("v") == size)
    asked = scratch.keep(usable(queries, id_col, vector_col).where(F.size("v") == size).distinct(), "asked")
    table = scratch.keep(entries(good, k + 1), "entries")
    n = table.count()
    if n == 0:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    width = max(1, min(max_centroids, round((n / 8) ** 0.5)))
    fitted = table.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).toArrow()
    fitted = matrix(fitted.column(0).combine_chunks())
    frame = Frame(fitted)
    fitted = frame(fitted)
    left, right = (codebook(x, width) for x in halves(fitted))
    wanted = candidates or int(share_to_visit(fitted, left, right, k, recall) * n) + k + 1
    cells = scratch.keep(_assign(table, frame, left, right), "cells")
    count = np.zeros(len(left) * len(right), np.int64)
    for r in cells.groupBy("cell").count().collect():  # at most max_centroids ** 2 rows
        count[r["cell"]] = r["count"]
    # a cell's entries go to `spread` consecutive buckets, beginning at `home`
    pieces = -(-count // bucket_entries)
    home = (np.cumsum(count) - count) // bucket_entries
    places = spark.createDataFrame(pd.DataFrame({"cell_": np.flatnonzero(count), "home": home[count > 0], "pieces": pieces[count > 0]}))
    dealt = cells.join(F.broadcast(places), F.col("cell") == F.col("cell_")).select((F.col("home") + F.pmod(F.xxhash64("v"), F.col("pieces"))).alias("bucket"), "cell", "v", "ids")
    distinct = scratch.keep(asked.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    visits = distinct.mapInArrow(_visits(frame, left, right, count, home, pieces, wanted), "bucket long, q long, v array<double>, cells array<int>")
    found = dealt.groupBy("bucket").cogroup(visits.groupBy("bucket")).applyInArrow(_rerank(k + 1), "q long, vec_id long, score double")
    best = found.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("k") <= k + 1)
    best = scratch.keep(best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near")), "near")
    known = scratch.keep(distinct.join(best, "q").select(F.col("v").alias("v_"), "near"), "answers")
    each = asked.join(known, F.col("v") == F.col("v_"))
    other = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    return each.select(F.col("vec_id").alias("query_id"), F.posexplode(other)).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))


def _assign(table: DataFrame, frame: Frame, left: np.ndarray, right: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = halves(frame(matrix(batch.column(0))))
                cell = squared(a, left).argmin(axis=1) * len(right) + squared(b, right).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(0), batch.column(1)], names=["cell", "v", "ids"])

    return table.select("v", "ids").mapInArrow(run, "cell int, v array<double>, ids array<long>")


def _visits(frame: Frame, left: np.ndarray, right: np.ndarray, count: np.ndarray, home: np.ndarray, pieces: np.ndarray, wanted: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = count.tolist()
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                a, b = halves(frame(matrix(part.column(0))))
                rows, buckets, lists = [], [], []
                for i, (x, y) in enumerate(zip(squared(a, left), squared(b, right))):
                    cells = np.array(traverse(x, y, sizes, wanted), np.int64)
                    own = np.repeat(cells, pieces[cells])
                    step = np.arange(len(own)) - np.repeat(np.cumsum(pieces[cells]) - pieces[cells], pieces[cells])
                    bucket = home[own] + step
                    order = np.argsort(bucket, kind="stable")
                    at, begin = np.unique(bucket[order], return_index=True)
                    rows += [i] * len(at)
                    buckets += at.tolist()
                    lists += np.split(own[order].astype(np.int32), begin[1:])
                take = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), part.column(1).take(take), part.column(0).take(take), pa.array(lists, pa.list_(pa.int32()))], names=["bucket", "q", "v", "cells"])

    return run


def _rerank(k: int):
    schema = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(key, dealt: pa.Table, visits: pa.Table) -> pa.Table:
        if not dealt.num_rows or not visits.num_rows:
            return schema.empty_table()
        base, asked = (matrix(t.column("v").combine_chunks()) for t in (dealt, visits))
        cell = dealt.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        cell, base = cell[order], base[order]
        lists = dealt.column("ids").combine_chunks()
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        ids = [flat[at[i] : at[i + 1]] for i in order]
        q, names, scores = [], [], []
        for name, vector, cells in zip(visits.column("q").to_pylist(), asked, visits.column("cells").to_pylist()):
            inside = np.isin(cell, cells)
            own = np.flatnonzero(inside)
            if len(own):
                x, d = nearest(vector[None, :], base[own], [ids[i] for i in own], k)[0]
                q.append(np.full(len(x), name))
                names.append(x)
                scores.append(d)
        if not q:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in (q, names, scores)], schema=schema)

    return run
