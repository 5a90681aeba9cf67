"""Token-id archives compressed by Re-Pair grammars (operator 3).

An archive is a folder of Parquet files whose rows are blocks. A block holds the
ids of consecutive documents, in ascending document order over blocks and files,
as a grammar: `stream` is a sequence of symbols; a symbol below `terminals` is an
id, and symbol `terminals + r` is rule r, which stands for the two symbols in
`rules[2r]`, `rules[2r + 1]`. `expansion[r]` is the number of ids that rule r
stands for, so a reader finds any position by summing lengths and expands only
what it needs. Parquet as the container keeps Spark's commit protocol (lost and
repeated tasks leave no half-written block) and works on every store Spark writes.

Re-Pair replaces the most frequent pair, again and again. Here a round counts all
adjacent pairs of a block and replaces up to `pairs_per_round` of the most frequent
ones at once, left to right without overlap, until no pair occurs `min_count`
times or the symbols are used up (2 ** 16 in all, if the ids fit in them). A block is
compressed by itself, in the task that encodes its documents.

Defined cases: a null text has the ids of an empty one (the end id only); a null
document id sorts first; rows with equal ids keep an order given by their text's
hash; repeated rows are written as often as they come; an empty table gives an
empty archive; columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm.bytescan import slices, spread
from tidewheel.llm.encoding import ENCODE_BYTES, encoder
from tidewheel.llm.shared import Scratch

BLOCK_IDS = 1 << 19
SYMBOLS = 1 << 16
PAIRS_PER_ROUND, MIN_COUNT = 4096, 8

BLOCK_SCHEMA = "part int, block int, part_start long, doc_ids array<long>, lengths array<int>, terminals int, n_ids long, rules binary, expansion binary, stream binary"
BLOCK_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("terminals", pa.int32()), ("n_ids", pa.int64()), ("rules", pa.binary()), ("expansion", pa.binary()), ("stream", pa.binary())])


def compress(ids: np.ndarray, terminals: int, pairs_per_round: int = PAIRS_PER_ROUND, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules as pairs of symbols, ids that each rule stands for, stream)."""
    wide = np.uint64 if terminals >= SYMBOLS else np.uint32
    shift = wide(32 if wide is np.uint64 else 16)
    limit = (1 << 31) if wide is np.uint64 else SYMBOLS
    seq = ids.astype(wide)
    lengths = [np.ones(terminals, np.int64)]
    rules: list[np.ndarray] = []
    used = terminals
    hashed = 20
    while True:
        room = min(pairs_per_round, limit - used)
        if len(seq) < 2 or room <= 0:
            break
        code = (seq[:-1] << shift) | seq[1:]
        ordered = np.sort(code)
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.append(edge, len(ordered)))
        frequent = np.flatnonzero(count >= min_count)
        if len(frequent) == 0:
            break
        if len(frequent) > room:
            frequent = frequent[np.argsort(-count[frequent], kind="stable")[:room]]
        else:
            frequent = frequent[np.argsort(-count[frequent], kind="stable")]
        chosen = ordered[edge[frequent]]
        slot = _slot(chosen, hashed)
        table = np.zeros(1 << hashed, np.int32)
        table[slot[::-1]] = np.arange(len(chosen), 0, -1, dtype=np.int32)
        kept = table[slot] == np.arange(1, len(chosen) + 1)  # of pairs that share a slot, the most frequent
        rank = np.cumsum(kept) - 1
        rule = table[_slot(code, hashed)] - 1
        hit = np.flatnonzero((rule >= 0) & (chosen[rule] == code))
        if len(hit) == 0:
            break
        fresh = np.concatenate([[True], np.diff(hit) > 1])
        within = np.arange(len(hit)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        hit = hit[within % 2 == 0]
        seq[hit] = (used + rank[rule[hit]]).astype(wide)
        stay = np.ones(len(seq), bool)
        stay[hit + 1] = False
        seq = seq[stay]
        chosen = chosen[kept]
        mask = wide((1 << int(shift)) - 1)
        pair = np.stack([chosen >> shift, chosen & mask], axis=1).astype(np.int64)
        known = np.concatenate(lengths)
        lengths.append(known[pair[:, 0]] + known[pair[:, 1]])
        rules.append(pair)
        used += len(pair)
    size = np.uint16 if limit == SYMBOLS else np.uint32
    flat = np.concatenate(rules).astype(size) if rules else np.zeros((0, 2), size)
    return flat, np.concatenate([*lengths[1:], np.zeros(0, np.int64)]).astype(np.uint32), seq.astype(size)


def _slot(code: np.ndarray, bits: int) -> np.ndarray:
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Grammar:
    """One block, open for reading."""

    def __init__(self, terminals: int, rules: bytes, expansion: bytes, stream: bytes) -> None:
        size = np.uint16 if terminals < SYMBOLS else np.uint32
        self.terminals = terminals
        self.rules = np.frombuffer(rules, size).reshape(-1, 2).astype(np.int64)
        self.length = np.frombuffer(expansion, np.uint32).astype(np.int64)
        self.stream = np.frombuffer(stream, size).astype(np.int64)
        flat = self._unfold(np.arange(len(self.rules)) + terminals)
        self.flat, self.at = flat, np.cumsum(self.length) - self.length
        self.upto: np.ndarray | None = None

    def _unfold(self, symbols: np.ndarray) -> np.ndarray:
        while len(symbols) and (big := symbols >= self.terminals).any():
            size = 1 + big.astype(np.int64)
            at = np.cumsum(size) - size
            out = np.repeat(symbols, size)
            pair = self.rules[symbols[big] - self.terminals]
            out[at[big]], out[at[big] + 1] = pair[:, 0], pair[:, 1]
            symbols = out
        return symbols.astype(np.uint32)

    def _lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        big = symbols >= self.terminals
        out[big] = self.length[symbols[big] - self.terminals]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        big = symbols >= self.terminals
        if not big.any():
            return symbols.astype(np.uint32)
        source = np.concatenate([self.flat, symbols[~big].astype(np.uint32)])
        begin = np.empty(len(symbols), np.int64)
        begin[big] = self.at[symbols[big] - self.terminals]
        begin[~big] = len(self.flat) + np.arange(int((~big).sum()))
        return source[spread(begin, self._lengths(symbols))]

    def all(self) -> np.ndarray:
        return self.expand(self.stream)

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids at start .. stop - 1; only the symbols that cover them are expanded."""
        if self.upto is None:
            self.upto = np.concatenate([[0], np.cumsum(self._lengths(self.stream))])
        if start >= stop:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.upto, start, "right")) - 1
        b = int(np.searchsorted(self.upto, stop, "left"))
        return self.expand(self.stream[a:b])[start - self.upto[a] : stop - self.upto[a]]


def write_archive(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, block_ids: int = BLOCK_IDS, pairs_per_round: int = PAIRS_PER_ROUND, min_count: int = MIN_COUNT) -> None:
    """Encode every text, append `end_id`, and write the blocks in ascending order of `id_col`."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        terminals = max(encode.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        part = TaskContext.get().partitionId()
        number, before, held = 0, 0, 0
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        names: list[pa.Array] = []

        def block() -> pa.RecordBatch:
            rules, expansion, stream = compress(np.concatenate(ids), terminals, pairs_per_round, min_count)
            each = np.concatenate(lengths)
            row = [[part], [number], [before], [pa.concat_arrays(names).to_pylist()], [each.astype(np.int32)], [terminals], [held], [rules.tobytes()], [expansion.tobytes()], [stream.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, BLOCK_ARROW)], schema=BLOCK_ARROW)

        for batch in batches:
            for rows, raw, ends in slices(batch, "text", min(8 * block_ids, ENCODE_BYTES)):
                flat, each = encode(raw, ends)
                upto = np.cumsum(each)
                ids.append(np.insert(flat, upto, np.uint32(end_id)))
                lengths.append(each + 1)
                names.append(rows.column(0))
                held += len(ids[-1])
                if held >= block_ids:
                    yield block()
                    number, before, held = number + 1, before + held, 0
                    ids, lengths, names = [], [], []
        if held:
            yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]  # with the text's hash, a repeated id is no hot partition
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, part, start within the part, n_tokens and its ids as little-endian uint32 bytes."""

    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, part, each, first, flat in _opened(batches):
            at = np.concatenate([[0], np.cumsum(each)])
            ids = flat.astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(np.full(len(each), part, np.int32)), pa.array(first + at[:-1]), pa.array(each), pa.array([ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], schema=schema)

    return spark.read.schema(BLOCK_SCHEMA).parquet(path).mapInArrow(documents, "doc_id long, part int, start long, n_tokens long, ids binary")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in batch.schema.names}
            grammar = Grammar(row["terminals"].as_py(), row["rules"].as_py(), row["expansion"].as_py(), row["stream"].as_py())
            yield row["doc_ids"].values, row["part"].as_py(), row["lengths"].values.to_numpy(zero_copy_only=False).astype(np.int64), row["part_start"].as_py(), grammar.all()


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, all taken from the files."""

    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, part, each, first, flat in _opened(batches):
            at = np.concatenate([[0], np.cumsum(each)])
            raw = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(np.full(len(each), part, np.int32)), pa.array(first + at[:-1]), pa.array(each), pa.array(crc, pa.int64())], schema=schema)

    archive = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    rows = archive.mapInArrow(digests, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    return _from_start(archive, rows)


def _from_start(archive: DataFrame, rows: DataFrame) -> DataFrame:
    """Add to each start what stands in the parts before; there is one row for each part."""
    parts = archive.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(parts.select("part", before.alias("before")), "part").withColumn("start", F.col("start") + F.col("before")).drop("part", "before")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write an archive in the shared folder and return what reading it gives."""
    spark = docs.sparkSession
    path = Scratch(spark, "token-archive").path("blocks")
    write_archive(docs, path, tokenizer, **options)
    return read_digests(spark, path)
