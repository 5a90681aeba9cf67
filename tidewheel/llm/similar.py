"""All documents of Jaccard similarity 0.8 or more, by SimHash and an exact prefix-filter join (pipeline stage).

A document is the set of its five-word shingles (64-bit hashes; fewer words are one
shingle). Two documents are linked if their sets' Jaccard similarity is 0.8 or more;
documents linked over any number of links are one component. No link is lost:

* Shingles have one fixed order, in which those seen twice or more in half of the
  documents come last; a count moves the cost, and any order gives the same links. In
  that order, two linked sets share one of the n - ceil(0.8 n) + 1 first shingles
  (prefix filter), so each of these is a key.
* First, SimHash links (radius 2), and a few members of each crowded key (pivots) with all others, give
  candidates, a number in proportion to the rows. Most of a large group is one component from then on.
* Then all other pairs of a key are candidates, unless already in one component, or
  excluded by their sizes or by the shingle's places in both (positional filter). A
  key of more than `block` members is cut into blocks, each pair a group of its own.
* A candidate's sketches are compared first: a sketch has the parity of a set's shingles
  in buckets of their hash ("odd sketch"), so two sketches have no more different bits than
  the sets differ in shingles; pairs whose sketches differ by more are no links. In a key
  of more than `crowd` members the sketches come along with the members and are compared
  in the block, so that only pairs that may be links leave it. So do the shingles before the
  key's own in each member's order: of all keys that a pair shares, only the first gives it.
* Every other candidate counts only by its similarity, taken from the whole sets.

Members of one key that are half alike are compared by their sketches alone, block by
block: split over tasks, and no rows, but n * n / 2 comparisons for n such members.

Defined cases: null texts and texts without words are one set with one empty shingle;
equal texts are one entry; ids as in simhash; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import simhash
from tidewheel.llm.bytescan import NON_BLANK, Words, slices, spread
from tidewheel.llm.components import components
from tidewheel.llm.shared import Scratch

#: Words in a shingle; similarity as a fraction.
SHINGLE, OVER, UNDER = 5, 4, 5
#: One document of so many is counted to find shingles that are not rare, of which the most frequent come last in the order.
SAMPLE, SEEN, FREQUENT = 2, 2, 1 << 20
PIVOTS = 2
#: Keys of more members have pivots first; texts up to this number are sought by broadcast (8 bytes each).
CROWD, BROADCAST_TEXTS = 64, 1_000_000
#: Shingles of a block's members on average, each half a byte of their sketches at most.
BLOCK_SHINGLES = 1 << 26


def shingles_of(words: Words, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, document of each), ascending by document, then hash."""
    return distinct_of(*simhash.shingle_hashes(words, shingle))


def distinct_of(h: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """shingles_of, of the hashes of all shingles."""
    none = np.flatnonzero(shingles == 0)
    h, owner = np.concatenate([h, np.zeros(len(none), np.uint64)]), np.concatenate([np.repeat(np.arange(len(shingles)), shingles), none])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def sketches(h: np.ndarray, owner: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Parities of each document's hashes in buckets of their low bits, 2 to 4 buckets a hash (64 at least)."""
    size = 1 << np.ceil(np.log2(np.maximum(n / 32, 1))).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    bucket = 64 * begin[owner] + (h & (64 * size[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(bucket, minlength=64 * int(begin[-1])) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[8 * a : 8 * b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]


class Sketches:
    """A column of sketches, compared by row numbers; the longer of two is folded to the length of the other."""

    def __init__(self, column: pa.Array | pa.ChunkedArray) -> None:
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy() // 8
        self.words = np.frombuffer(b"".join(x for x in column.to_pylist() if x), np.uint64)
        self.at, self.size = np.cumsum(sizes) - sizes, sizes

    def apart(self, x: np.ndarray, y: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """Numbers that the sets of rows x and y differ by at least."""
        x, y = np.where(self.size[x] >= self.size[y], x, y), np.where(self.size[x] >= self.size[y], y, x)
        wide, narrow = self.size[x], self.size[y]
        out = np.zeros(len(x), np.int64)
        for w, v in np.unique(np.stack([wide, narrow], 1), axis=0).tolist() if len(x) else []:
            rows = np.flatnonzero((wide == w) & (narrow == v))
            for some in np.split(rows, range(max(1, most // w), len(rows), max(1, most // w))) if v else []:
                a = self.words[self.at[x[some], None] + np.arange(w)].reshape(-1, w // v, v)
                b = self.words[self.at[y[some], None] + np.arange(v)]
                out[some] = np.bitwise_count(np.bitwise_xor.reduce(a, axis=1) ^ b).sum(axis=1, dtype=np.int64)
        return out


def apart(x: bytes, y: bytes) -> int:
    """A number that two sets differ by at least, from their sketches."""
    return int(Sketches(pa.array([x, y], pa.binary())).apart(np.array([0]), np.array([1]))[0])


def _text(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.xxhash64(text).alias("t"), text.alias("text"))


def _frequent(docs: DataFrame, text_col: str) -> np.ndarray:
    """Halves of hashes seen in at least SEEN sampled documents, rarest first; the order only, never the result, depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, ends in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(_half(shingles_of(Words(raw, ends, NON_BLANK))[0]).view(np.int32))], names=["h"])

    some = _text(docs, text_col).where(F.pmod(F.xxhash64("t"), F.lit(SAMPLE)) == 0)
    counted = some.mapInArrow(run, "h int").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
    top = counted.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    return top.column("h").to_numpy()[::-1].view(np.uint32).copy()


def _half(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def _prefixes(docs: DataFrame, frequent: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t, fp (of the shingles), n (size of the set), prefix and sketch, for all rows."""
    by_hash = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[by_hash], by_hash.astype(np.int32) + 1))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = shared.value
        for batch in batches:
            for part, raw, ends in slices(batch, "text"):
                every, shingles = simhash.shingle_hashes(Words(raw, ends, NON_BLANK), SHINGLE)
                fp = simhash.majority(every, shingles)
                h, owner = distinct_of(every, shingles)
                rank = np.zeros(len(h), np.int64)
                if len(keys):
                    own = _half(h)
                    place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    rank = np.where(keys[place] == own, ranks[place], 0)
                n = np.bincount(owner, minlength=part.num_rows)
                sketch = pa.array(sketches(h, owner, n), pa.binary())
                h = h[np.lexsort((h, rank, owner))]
                begin, size = np.cumsum(n) - n, n - (OVER * n + UNDER - 1) // UNDER + 1
                prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(h[spread(begin, size)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp.view(np.int64)), pa.array(n), prefix, sketch], names=["doc_id", "t", "fp", "n", "prefix", "sketch"])

    return rows.mapInArrow(run, "doc_id long, t long, fp long, n long, prefix array<long>, sketch binary")


def _sets(docs: DataFrame, pairs: DataFrame, scratch: Scratch, text_col: str) -> DataFrame:
    """t and the sorted shingle hashes, as bytes, of all texts in `pairs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, ends in slices(batch, "text"):
                h, owner = shingles_of(Words(raw, ends, NON_BLANK))
                at = np.searchsorted(owner, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["t", "found"])

    nodes = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    rows = _text(docs, text_col)
    if nodes.count() <= BROADCAST_TEXTS:
        nodes = F.broadcast(nodes)
    return scratch.keep(rows.join(nodes, rows.t == nodes.node, "left_semi").mapInArrow(run, "t long, found binary").groupBy("t").agg(F.first("found").alias("found")), "sets")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return UNDER * common >= OVER * (len(both) - common)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        ok = [alike(np.frombuffer(x[k].as_buffer(), np.uint64), np.frombuffer(y[k].as_buffer(), np.uint64)) for k in range(batch.num_rows)]
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sketches allow the similarity: sets of n and m may differ by a ninth of n + m."""
    for batch in batches:
        most = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) // (OVER + UNDER)
        both = Sketches(pa.chunked_array([batch.column(4), batch.column(5)]))
        rows = np.arange(batch.num_rows)
        yield batch.select([0, 1]).filter(pa.array(both.apart(rows, rows + batch.num_rows) <= most))


def _labels(pairs: DataFrame, sketched: DataFrame, docs: DataFrame, scratch: Scratch, text_col: str, found: DataFrame | None = None) -> DataFrame:
    """Components of the pairs (a, b) whose sets are alike, and of those found before, which stand in as stars.

    Sketches and sets of b travel with their pairs, so a may be a hot key.
    """
    left, right = (sketched.select(F.col("t").alias(f"{c}_"), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "ab")
    wide = pairs.join(right, F.col("b") == F.col("b_")).join(left, F.col("a") == F.col("a_")).select("a", "b", "n_a", "n_b", "s_a", "s_b")
    pairs = scratch.keep(wide.mapInArrow(_possible, "a long, b long"), "possible")
    sets = _sets(docs, pairs, scratch, text_col)
    right = pairs.join(sets, pairs.b == sets.t).select("a", "b", F.col("found").alias("y"))
    right = scratch.keep(right, "pairs-with-sets")
    left = sets.select(F.col("t").alias("t_"), F.col("found").alias("x"))
    links = right.join(left, right.a == left.t_).select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long")
    if found is not None:
        links = links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
    out = scratch.keep(components(links, scratch), "components")
    scratch.drop(right, sets)
    return out


def fits(n: np.ndarray, m: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles that share those at places p and q can be alike."""
    most = np.minimum(p, q) + 1 + np.minimum(n - p, m - q) - 1
    return (UNDER * np.minimum(n, m) >= OVER * np.maximum(n, m)) & ((OVER + UNDER) * most >= OVER * (n + m))


def _met_before(heads: pa.ChunkedArray, x: np.ndarray, y: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """Whether the lists of rows x and y have a value in common."""
    size = pc.fill_null(pc.list_value_length(heads), 0).to_numpy()
    begin, value = np.cumsum(size) - size, pc.list_flatten(heads).to_numpy()
    out, cost = np.zeros(len(x), bool), np.cumsum(size[x] + size[y])
    cuts = np.searchsorted(cost, np.arange(most, cost[-1] + 1, most)) if len(x) else []
    for some in np.split(np.arange(len(x)), cuts):
        pair = np.concatenate([np.repeat(some, size[x[some]]), np.repeat(some, size[y[some]])])
        both = value[np.concatenate([spread(begin[x[some]], size[x[some]]), spread(begin[y[some]], size[y[some]])])]
        order = np.lexsort((both, pair))
        both, pair = both[order], pair[order]
        out[pair[1:][(both[1:] == both[:-1]) & (pair[1:] == pair[:-1])]] = True
    return out


def _pairs(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b) of whole groups, which arrive sorted by key, i, j and n.

    Members of one component are no candidates, nor are pairs whose sketches, if they came along, are too far apart,
    or that an earlier key gives, by the shingles (head) that came along.
    """
    for t in _groups(batches):
        key, i, j, side, node, n, place, label = (t.column(c).to_numpy() for c in ("key", "i", "j", "side", "t", "n", "place", "label"))
        sketched = Sketches(t.column("sketch"))
        head = np.ones(t.num_rows, bool)
        head[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        stop = np.append(np.flatnonzero(head)[1:], t.num_rows)[np.cumsum(head) - 1]
        live, step, out, held = np.arange(t.num_rows), 1, [], 0
        while len(live):
            live = live[live + step < stop[live]]
            live = live[UNDER * n[live] >= OVER * n[live + step]]  # sizes ascend: no later one fits either
            x, y = live, live + step
            use = (label[x] != label[y]) & ((i[x] == j[x]) | (side[x] != side[y])) & fits(n[x], n[y], place[x], place[y])
            x, y = x[use], y[use]
            near = sketched.apart(x, y) <= (n[x] + n[y]) // (OVER + UNDER)
            x, y = x[near], y[near]
            first = ~_met_before(t.column("head"), x, y)
            x, y = node[x[first]], node[y[first]]
            out.append((np.minimum(x, y), np.maximum(x, y)))
            held += len(x)
            step += 1
            if held >= most or (not len(live) and held):
                a, b = (np.concatenate(z) for z in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                out, held = [], 0


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for name in ("key", "i", "j"):
            x = batch.column(batch.schema.get_field_index(name)).to_numpy()
            new[1:] |= x[1:] != x[:-1]
            new[0] |= bool(held) and held[-1].column(held[-1].schema.get_field_index(name))[-1].as_py() != x[0]
        at = np.flatnonzero(new)
        if len(at):
            whole = [*held, batch.slice(0, int(at[-1]))]
            yield pa.Table.from_batches(whole)
            held = [batch.slice(int(at[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, rows.t == found.node, "left").withColumn("label", F.coalesce("component", "t")).drop("node", "component")


def similar_links(docs: DataFrame, prints: DataFrame, scratch: Scratch, text_col: str = "text", block: int = 4096, pivots: int = PIVOTS, crowd: int = CROWD) -> DataFrame:
    """(node, component) of all texts (t) that are linked to another; `prints` as _prefixes gives them."""
    nodes = scratch.keep(prints.groupBy("t").agg(*(F.first(c).alias(c) for c in ("fp", "n", "prefix", "sketch"))), "texts")
    sketched = nodes.select("t", "n", "sketch")
    distinct = scratch.keep(nodes.groupBy("fp").agg(F.min("t").alias("first")), "distinct")
    one, two = (distinct.select(F.col("fp").alias(f"fp{k}"), F.col("first").alias(c)) for k, c in ((1, "a"), (2, "b")))
    near = simhash.links(distinct.select("fp"), scratch).select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()
    near = near.join(one, F.col("x") == F.col("fp1")).join(two, F.col("y") == F.col("fp2")).select("a", "b")
    equal = nodes.join(distinct.select(F.col("fp").alias("fp_"), F.col("first").alias("a")), F.col("fp") == F.col("fp_")).where("a <> t").select("a", F.col("t").alias("b"))

    keyed = nodes.select("t", "n", F.posexplode("prefix").alias("place", "key"))
    sizes = scratch.keep(keyed.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).where("members > 1"), "keys")
    member = scratch.keep(keyed.join(sizes, "key").select("key", "t", "n", "place", "members", "shingles"), "members")
    scratch.drop(sizes)
    first = near.unionByName(equal)
    if pivots:
        crowded = member.where(F.col("members") > crowd)
        least = [F.min(F.struct(F.xxhash64("t", F.lit(seed)).alias("h"), F.col("t").alias("a"), F.col("n").alias("m"), F.col("place").alias("q"))) for seed in range(pivots)]
        pivot = crowded.groupBy("key").agg(F.array(*least).alias("p")).select(F.col("key").alias("key_"), F.explode("p").alias("p"))
        pivot = scratch.keep(pivot.select("key_", "p.a", "p.m", "p.q"), "pivots")
        most = F.least("place", "q") + F.least(F.col("n") - F.col("place"), F.col("m") - F.col("q"))
        near_size = (UNDER * F.least("n", "m") >= OVER * F.greatest("n", "m")) & ((OVER + UNDER) * most >= OVER * (F.col("n") + F.col("m")))
        first = first.unionByName(crowded.join(pivot, F.col("key") == F.col("key_")).where((F.col("t") != F.col("a")) & near_size).select("a", F.col("t").alias("b")))
    first = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = _labels(scratch.keep(first, "first-pairs"), sketched, docs, scratch, text_col)

    now = scratch.keep(_labelled(member, found), "labelled")
    mixed = scratch.keep(now.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select(F.col("key").alias("key_")), "mixed")
    now = scratch.keep(now.join(mixed, F.col("key") == F.col("key_"), "left_semi"), "mixed-members")
    few = now.where(F.col("members") <= crowd).withColumns({"sketch": F.lit(None).cast("binary"), "head": F.lit(None).cast("array<long>")})
    many = scratch.keep(now.where(F.col("members") > crowd), "crowded-members")  # its size is known, so texts are shuffled for many members only
    many = many.join(nodes.select(F.col("t").alias("t_"), "sketch", "prefix"), F.col("t") == F.col("t_"))
    many = many.withColumn("head", F.slice("prefix", 1, F.col("place"))).drop("t_", "prefix")
    blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("t"), blocks).cast("int")
    dealt = few.unionByName(many).select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "t", "n", "place", "label", "sketch", "head")
    pairs = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "t").mapInArrow(_pairs, "a long, b long").distinct()
    return _labels(scratch.keep(pairs, "pairs"), sketched, docs, scratch, text_col, found)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, with all columns of docs: the row that simhash.keep_one keeps."""
    scratch = Scratch(docs.sparkSession, "similar")
    prints = scratch.keep(_prefixes(docs, _frequent(docs, text_col), id_col, text_col), "prefixes")
    found = similar_links(docs, prints, scratch, text_col, **options)
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "t")
    least = scratch.keep(prints.groupBy("t").agg(F.min(row).alias("least")), "least")
    first = scratch.keep(_labelled(least, found).groupBy("label").agg(F.min("least").alias("first")), "first")
    return simhash.keep_rows(docs, prints, first, scratch, id_col, text_col)
