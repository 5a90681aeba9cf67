"""SimHash near-duplicates by bit-sliced comparison (operator 2).

A fingerprint has bit i where over half of the XXH64 hashes of the text's word
shingles have it. Fingerprints that differ in `radius` bits at most are linked, and
documents of linked fingerprints, over any number of links, are one component.

* Documents with the same fingerprint are one entry from then on.
* Candidates: the 64 bits are cut into `parts` equal parts. Two fingerprints within
  the radius agree in parts - radius of them at least, so each choice of that many
  parts is a key, and all linked pairs share some key. No link is lost.
* A key's entries are compared bit-sliced: plane p holds bit p of 64 entries in each
  word; the differing bits of a plane are added to carry-save counters (ones, twos,
  more), 64 distances at a time, and words are left out once all of their distances
  exceed the radius.
* A key with more entries than `block` is cut into blocks; each pair of blocks is
  compared in a task of its own. Every task gives a spanning forest of its links,
  fewer rows than entries, never all pairs. Comparing a key of n different
  fingerprints still takes n * n / 2 bit-sliced distances: split, but quadratic.

Defined cases: a null text has no words, and a text without words has fingerprint 0,
which links like any other; fewer words than a shingle are one shingle; a null id is
kept, with its component's smallest known id (null, if it has none); repeated rows
are rows of one component; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.bytescan import NON_BLANK, Words, slices, spread
from tidewheel.llm.components import components
from tidewheel.llm.shared import Scratch

#: The five primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64(text: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many spans of one buffer; spans of one length are hashed together."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))
    four = np.ndarray((len(text) + 1,), "<u4", padded, strides=(1,))
    order = np.argsort(length.astype(np.uint32 if len(length) and length.max() >= 1 << 16 else np.uint16), kind="stable")
    out = np.empty(len(start), np.uint64)
    sizes, begin = np.unique(length[order], return_index=True)
    for size, rows in zip(sizes.tolist(), np.split(order, begin[1:])):
        out[rows] = _one_length(padded, eight, four, start[rows], size, np.uint64(seed))
    return out


def _one_length(text, eight, four, at, n: int, seed) -> np.ndarray:
    with np.errstate(over="ignore"):
        i = 0
        if n >= 32:
            lanes = [np.full(len(at), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            while i + 32 <= n:
                for k in range(4):
                    lanes[k] = _turn(lanes[k] + eight[at + i + 8 * k] * P2, 31) * P1
                i += 32
            h = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
            for x in lanes:
                h = (h ^ (_turn(x * P2, 31) * P1)) * P1 + P4
        else:
            h = np.full(len(at), seed + P5, np.uint64)
        h = h + np.uint64(n)
        while i + 8 <= n:
            h = _turn(h ^ (_turn(eight[at + i] * P2, 31) * P1), 27) * P1 + P4
            i += 8
        if i + 4 <= n:
            h = _turn(h ^ (four[at + i].astype(np.uint64) * P1), 23) * P2 + P3
            i += 4
        while i < n:
            h = _turn(h ^ (text[at + i].astype(np.uint64) * P5), 11) * P1
            i += 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def shingle_hashes(words: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, repeats included, document by document; number of shingles of each document)."""
    count = np.diff(words.number)
    shingles = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    first = spread(words.number[:-1], shingles)
    if not len(first):
        return np.zeros(0, np.uint64), shingles
    size = np.repeat(np.minimum(count, shingle), shingles)
    start = words.start[first]
    return xxh64(words.text, start, words.end[first + size - 1] - start), shingles


def fingerprints_of(words: Words, shingle: int) -> np.ndarray:
    """One fingerprint for each document of a slice."""
    return majority(*shingle_hashes(words, shingle))


def majority(h: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """For each document the bits that over half of its hashes have."""
    out = np.zeros(len(shingles), np.uint64)
    if not len(h):
        return out
    some = np.flatnonzero(shingles)
    begin = (np.cumsum(shingles) - shingles)[some]
    ones = np.zeros((len(some), 64), np.int64)
    step = 1 << 17  # hashes at a time, each as 64 bytes
    for lo in range(0, len(h), step):
        bits = np.unpackbits(h[lo : lo + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        a = int(np.searchsorted(begin, lo, "right")) - 1
        b = int(np.searchsorted(begin, lo + len(bits), "left"))
        cuts = np.maximum(begin[a:b] - lo, 0)
        upto = np.append(cuts[1:], len(bits))
        for d, x, y in zip(range(a, b), cuts.tolist(), upto.tolist()):
            ones[d] += _column_sums(bits[x:y])
    bits = (2 * ones > shingles[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of 64 columns of single bits; bytes are added eight columns to a word, at most 255 rows at a time."""
    words = bits.view(np.uint64)
    total = np.zeros(64, np.int64)
    for lo in range(0, len(words), 255):
        total += words[lo : lo + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return total


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id; t, a hash of the text; and fp, the fingerprint as a (signed) long."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, ends in slices(batch, "text", 2 << 20):
                fp = fingerprints_of(Words(raw, ends, NON_BLANK), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "t", "fp"])

    return rows.mapInArrow(run, "doc_id long, t long, fp long")


def planes(fp: np.ndarray) -> np.ndarray:
    """(64, words): bit j of word w of plane p is bit p of fingerprint 64 w + j."""
    padded = np.zeros(-(-len(fp) // 64) * 64, np.uint64)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _near(difference, shape: tuple[int, ...], radius: int) -> np.ndarray:
    """Lanes whose distance is in the radius (0 to 3). difference(p, alive) gives plane p's differing bits of the alive words."""
    alive = np.arange(int(np.prod(shape)))
    ones, twos, more = (np.zeros(len(alive), np.uint64) for _ in range(3))

    def beyond(a, b, c):
        return c | (a | b if radius == 0 else b if radius == 1 else a & b if radius == 2 else np.zeros_like(a))

    for p in range(64):
        d = difference(p, alive)
        carry = ones & d
        ones ^= d
        more |= twos & carry
        twos ^= carry
        if p % 8 == 7:
            stay = beyond(ones, twos, more) != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not stay.all():  # abandon the words whose 64 distances all exceed the radius
                alive, ones, twos, more = alive[stay], ones[stay], twos[stay], more[stay]
                if not len(alive):
                    break
    out = np.zeros(int(np.prod(shape)), np.uint64)
    out[alive] = ~beyond(ones, twos, more)
    return out.reshape(shape)


def _lanes(near: np.ndarray) -> np.ndarray:
    return np.unpackbits(near.view(np.uint8).reshape(*near.shape, 8), axis=-1, bitorder="little").reshape(*near.shape[:-1], -1)


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether a[i] and b[i] are within the radius, for two lists side by side."""
    pa_, pb = planes(a), planes(b)
    near = _near(lambda p, w: pa_[p, w] ^ pb[p, w], (pa_.shape[1],), radius)
    return _lanes(near)[: len(a)] > 0


def near_block(queries: np.ndarray, base: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for all queries[i] and base[j] within the radius, tile by tile."""
    flat = planes(base)
    words = flat.shape[1]
    step = max(1, (1 << 18) // words)
    for lo in range(0, len(queries), step):
        q = queries[lo : lo + step]
        flip = [np.where((q >> np.uint64(p)) & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)) for p in range(64)]
        near = _near(lambda p, w: flat[p, w % words] ^ flip[p][w // words], (len(q), words), radius)
        i, j = np.nonzero(_lanes(near)[:, : len(base)])
        yield i + lo, j


class Forest:
    """Smallest member of each set, kept while links come in."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


KEYED = "choice int, key long, i int, j int, side int, fp long"
LINKS = "a long, b long"
SMALL = 64


def _compare(radius: int):
    """Groups arrive sorted and whole; small ones are compared side by side, many at once."""

    def groups(batches):
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None or not held.num_rows else pa.concat_tables([held, now])
            head = _heads(held)
            if len(head) > 1:
                yield held.slice(0, int(head[-1]))
                held = held.slice(int(head[-1]))
        if held is not None and held.num_rows:
            yield held

    def _heads(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        if t.num_rows:
            new[0] = True
        for name in ("choice", "key", "i", "j"):
            x = t.column(name).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    def forest(fp: np.ndarray, side: np.ndarray, mixed: bool) -> tuple[np.ndarray, np.ndarray]:
        f = Forest(len(fp))
        if mixed:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        else:
            left = right = np.arange(len(fp))
        for x, y in near_block(fp[left], fp[right], radius):
            f.link(left[x], right[y])
        own = np.flatnonzero(f.root != np.arange(len(fp)))
        return fp[own], fp[f.root[own]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            head = _heads(t)
            size = np.diff(np.append(head, t.num_rows))
            fp = t.column("fp").to_numpy().view(np.uint64)
            side, i, j = (t.column(c).to_numpy() for c in ("side", "i", "j"))
            out: list[tuple[np.ndarray, np.ndarray]] = []
            small = (size <= SMALL) & (i[head] == j[head])
            for n in np.unique(size[small]).tolist():
                if n < 2:
                    continue
                x, y = np.triu_indices(n, 1)
                per = max(1, (1 << 18) // len(x))
                at = head[small & (size == n)]
                for lo in range(0, len(at), per):
                    some = at[lo : lo + per, None]
                    a, b = (some + x).ravel(), (some + y).ravel()
                    near = near_pairs(fp[a], fp[b], radius)
                    a, b = a[near], b[near]
                    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
                    f = Forest(len(nodes))
                    f.link(code[: len(a)], code[len(a) :])
                    own = np.flatnonzero(f.root != np.arange(len(nodes)))
                    out.append((fp[nodes[own]], fp[nodes[f.root[own]]]))
            for k in np.flatnonzero(~small).tolist():
                rows = slice(head[k], head[k] + size[k])
                out.append(forest(fp[rows], side[rows], bool(i[head[k]] != j[head[k]])))
            if out:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def links(distinct: DataFrame, scratch: Scratch, radius: int = 2, parts: int = 4, block: int = 4096) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints (fp) within the radius, directly or in steps."""
    if not 0 <= radius <= 3 or radius >= parts:
        raise ValueError("radius is 0 to 3 and below parts")
    width = 64 // parts
    keys = []
    for n, choice in enumerate(itertools.combinations(range(parts), parts - radius)):
        mask = sum(((1 << width) - 1) << (width * p) for p in choice)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(n).alias("choice"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("key")))
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.choice", "k.key", "fp")
    sizes = scratch.keep(keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    member = scratch.keep(keyed.join(sizes, ["choice", "key"]), "members")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = member.select("choice", "key", "fp", own.alias("own"), other.alias("other")).select(
        "choice", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp"
    )
    grouped = dealt.repartition("choice", "key", "i", "j").sortWithinPartitions("choice", "key", "i", "j", "fp")
    return grouped.mapInArrow(_compare(radius), LINKS)


def _components(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fingerprints of all rows; label of each distinct fingerprint; first row of each label).

    The first row has the smallest id (null last), then the smallest text hash.
    """
    prints = scratch.keep(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "t")
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min(row).alias("least")), "distinct")
    found = scratch.keep(components(links(distinct, scratch, radius), scratch), "components")
    labelled = scratch.keep(distinct.join(found, distinct.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("label"), "least"), "labels")
    first = scratch.keep(labelled.groupBy("label").agg(F.min("least").alias("first")).select(F.col("label").alias("label_"), "first"), "first")
    return prints, labelled, first


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every document."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints, labelled, first = _components(docs, scratch, id_col, text_col, shingle, radius)
    by_print = labelled.join(first, F.col("label") == F.col("label_")).select(F.col("fp").alias("fp_"), F.col("first.doc_id").alias("component_id"))
    by_print = scratch.keep(by_print, "by-print")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(by_print, prints.fp == by_print.fp_).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One document of each component, with all columns of docs: the row of smallest id (null last), then of smallest text hash.

    Rows equal in id and text are one document, of which one row stays.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints, _, first = _components(docs, scratch, id_col, text_col, shingle, radius)
    return keep_rows(docs, prints, first, scratch, id_col, text_col)


def keep_rows(docs: DataFrame, prints: DataFrame, first: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose doc_id and t stand in `first`, once each; `prints` has doc_id and t of all rows."""
    rows = first.select(F.col("first.doc_id").alias("id_"), F.col("first.t").alias("t_"))
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("t") == F.col("t_"))
    times = scratch.keep(prints.join(rows, same).groupBy("id_", "t_").agg(F.count("*").alias("times_")), "times")
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"))
    kept = own.join(times, same)
    once = kept.where("times_ = 1").select("row.*")
    if times.where("times_ > 1").isEmpty():
        return once
    again = kept.where("times_ > 1").dropDuplicates(["doc_id", "t"]).select("row.*")
    return once.unionByName(again)
