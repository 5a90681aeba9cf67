"""Harmonic packing of token ids into sequences of fixed capacity (operator 9).

A document fills as many whole sequences as it can; what remains, of length r, belongs to
the reciprocal class k = capacity // r, that is capacity / (k + 1) < r <= capacity / k. A
bin of class k takes exactly k remainders, so its place is known without a search, and
each task fills the bins of all classes by itself, with no shuffle.

k remainders of class k leave up to capacity / (k + 1) of a bin free. As documents may be
cut, the beginning of the task's next document fills that gap, so bins are full: a bin has
k + 1 pieces at most, but for documents shorter than the gap, which go in whole. At the end
of a task the remainders of unfinished bins fill further sequences, cut where one is full,
and what is left then ends in sequences of powers of two, which need no padding.
A document has one piece for each sequence it fills, one for its remainder, and one for a
gap that it fills.

Defined cases: a null text is an empty one and has the end id only; an empty table
gives no pieces; repeated rows and equal ids are packed as often as they come;
columns other than the id and the text are not read; a document of any length is
cut into as many full sequences as it fills.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.bytescan import slices
from tidewheel.llm.encoding import ENCODE_BYTES, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])


class Bins:
    """The open bins of one task. A piece is (name of the document, ids, where they start in it, number of all its ids)."""

    def __init__(self, capacity: int, base: int) -> None:
        self.capacity, self.next = capacity, base
        self.waiting: dict[int, list[tuple]] = {}
        self.gapped: list[tuple] = []  # a bin with all its remainders, waiting for the beginning of the next document
        self.room = 0

    def add(self, name: int | None, ids: np.ndarray) -> Iterator[tuple]:
        """Take a document; give (name, start, ids, ids of the document, sequence, offset) of the pieces whose bins are full now."""
        n, at = len(ids), 0
        if self.room and n:
            at = min(self.room, n)
            self.gapped.append((name, ids[:at].copy(), 0, n))
            self.room -= at
            if not self.room:
                yield from self._placed(self.gapped)
        while n - at >= self.capacity:
            yield from self._placed([(name, ids[at : at + self.capacity], at, n)])
            at += self.capacity
        if at < n:
            k = self.capacity // (n - at)
            bin_ = self.waiting.setdefault(k, [])
            bin_.append((name, ids[at:].copy(), at, n))
            if len(bin_) == k:
                del self.waiting[k]
                room = self.capacity - sum(len(x[1]) for x in bin_)
                if room:
                    self.gapped, self.room = bin_, room
                else:
                    yield from self._placed(bin_)

    def close(self) -> Iterator[tuple]:
        """The remainders of unfinished bins, in full sequences and then in powers of two."""
        rest = [*(self.gapped if self.room else []), *(x for k in sorted(self.waiting) for x in self.waiting[k])]
        left = sum(len(x[1]) for x in rest)
        bin_, room = [], 0
        for name, ids, start, n in rest:
            at = 0
            while at < len(ids):
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                    left -= room
                take = min(room, len(ids) - at)
                bin_.append((name, ids[at : at + take], start + at, n))
                at, room = at + take, room - take
                if not room:
                    yield from self._placed(bin_)
                    bin_ = []

    def _placed(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for name, ids, start, n in pieces:
            yield name, start, ids, n, self.next, offset
            offset += len(ids)
        self.next += 1


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `capacity` is a power of two. With `with_ids` each piece also carries its ids as
    little-endian uint32 bytes, from which a loader builds sequences by sequence_id
    and offset. A sequence_id is unique; its high bits name the task.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity is a power of two")
    schema = ARROW.append(pa.field("ids", pa.binary())) if with_ids else ARROW

    def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
        name, start, ids, n, sequence, offset = zip(*pieces) if pieces else [()] * 6
        length = [len(x) for x in ids]
        columns = [pa.array(c, pa.int64()) for c in (name, start, length, [zlib.crc32(x) for x in ids], n, sequence, offset)]
        if with_ids:
            columns.append(pa.array([x.tobytes() for x in ids], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for part, raw, ends in slices(batch, "text", ENCODE_BYTES):
                flat, each = encode(raw, ends)
                ids = np.insert(flat, np.cumsum(each), np.uint32(end_id)).astype("<u4")
                at = np.concatenate([[0], np.cumsum(each + 1)]).tolist()
                yield batch_of([piece for name, a, b in zip(part.column(0).to_pylist(), at[:-1], at[1:]) for piece in bins.add(name, ids[a:b])])
        yield batch_of(list(bins.close()))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))
