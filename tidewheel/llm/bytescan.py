"""Vectorised scans of UTF-8 text that lies in Arrow buffers.

Everything here works on one bounded slice of a task's Arrow batch: the bytes of
many documents side by side plus the offsets at which each document starts.
A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A slice holds so many bytes of text, unless one document alone is longer.
SLICE_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are runs of bytes outside these ranges, after lower-casing A-Z.
ALNUM = np.ones(256, dtype=bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
NON_BLANK = np.ones(256, dtype=bool)
NON_BLANK[0x09:0x0E] = NON_BLANK[0x20] = False


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of at most `limit` bytes of `column`, each with its buffers."""
    at = batch.schema.get_field_index(column)
    raw, ends = buffers(batch.column(at))
    row, n = 0, batch.num_rows
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield batch.slice(row, stop - row), raw[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def runs(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run crosses a document's end."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(n, bool)
    first[0] = inside[0]
    np.greater(inside[1:], inside[:-1], out=first[1:])
    last = np.empty(n, bool)
    last[-1] = inside[-1]
    np.greater(inside[:-1], inside[1:], out=last[:-1])
    cut = ends[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    both = cut[inside[cut] & inside[cut - 1]]
    first[both] = True
    last[both - 1] = True
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def apart(raw: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The (lower-cased) bytes with one line feed after each document, and where each document starts then."""
    docs = len(ends) - 1
    at = ends + np.arange(docs + 1)
    out = np.full(len(raw) + docs, 10, np.uint8)
    own = np.ones(len(out), bool)
    own[at[1:] - 1] = False
    out[own] = LOWER[raw] if lower else raw
    return out, at


class Words:
    """The words of a slice, copied into one buffer with one blank after each.

    `text` is that buffer, word i stands at text[start[i]:end[i]], and the words of
    document d are number[d] up to number[d + 1]. `line[i]` is the number of line
    feeds before word i in the slice, counting one after each document.
    """

    def __init__(self, raw: np.ndarray, ends: np.ndarray, kind: np.ndarray, lines: bool = False) -> None:
        low, at = apart(raw, ends)
        inside = kind[low]
        edge = np.empty(len(low), bool)
        if len(low):
            edge[0] = inside[0]
            np.greater(inside[1:], inside[:-1], out=edge[1:])
        begin = np.flatnonzero(edge)
        if len(low):
            edge[0] = False
            np.less(inside[1:], inside[:-1], out=edge[1:])
        stop = np.flatnonzero(edge)
        self.number = np.searchsorted(begin, at).astype(np.int64)
        if lines:
            feeds = np.flatnonzero(low == 10)
            self.line = np.searchsorted(feeds, begin)
            self.first_line = np.searchsorted(feeds, at)
        low[stop] = 32
        inside[stop] = True
        self.text = low[inside]
        self.end = np.cumsum(stop - begin + 1) - 1
        self.start = self.end - (stop - begin)
        self.begin = begin - np.repeat(np.arange(len(at) - 1), np.diff(self.number))  # in the slice's own bytes

    def __len__(self) -> int:
        return len(self.start)

    def document(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.number) - 1, dtype=np.int32), np.diff(self.number))


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All indices start[i] .. start[i] + length[i] - 1, one run after another."""
    total = int(length.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(total, dtype=np.int64)


#: Powers kept for later slices; longer ones, for a text longer than a slice, are made anew.
_KEPT_POWERS = 1 << 23
_kept: list[tuple[np.ndarray, np.ndarray]] = []
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers (`size` or more) of an odd base and of its inverse modulo 2**64."""
    if _kept and len(_kept[0][0]) >= size:
        return _kept[0]
    size = 1 << max(20, size.bit_length())
    base = 0x9E3779B97F4A7C15
    out = []
    for factor in (base, pow(base, -1, 1 << 64)):
        powers = np.empty(size, np.uint64)
        powers[0] = 1
        done = 1
        while done < size:
            step = np.uint64(pow(factor, done, 1 << 64))
            n = min(done, size - done)
            powers[done : done + n] = powers[:n] * step
            done += n
        out.append(powers)
    if size <= _KEPT_POWERS:
        _kept[:] = [(out[0], out[1])]
    return out[0], out[1]


class SpanHash:
    """64-bit hashes of any spans of one buffer, in constant time each; equal spans have equal hashes."""

    def __init__(self, text: np.ndarray) -> None:
        powers, self._inverse = _powers(len(text) + 1)
        self._sum = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(_VALUES[text] * powers[: len(text)], out=self._sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._sum[end] - self._sum[start]) * self._inverse[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h


class TextSet:
    """Distinct texts, found by hash and confirmed byte by byte.

    The texts are spans of one buffer, which may overlap and repeat; `of[i]` is the number of span i's text.
    """

    BITS = 20

    def __init__(self, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        self.text = text
        hashed = SpanHash(text)(start, start + length)
        self.of = np.full(len(start), -1, np.int64)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        firsts: list[np.ndarray] = []
        left, count = np.arange(len(start)), 0
        while len(left):  # a second table only if different texts share a hash
            keys, first, group = np.unique(hashed[left], return_index=True, return_inverse=True)
            own = left[first][group]
            same = length[left] == length[own]
            same[same] = same_spans(text, start[left[same]], text, start[own[same]], length[own[same]])
            self.of[left[same]] = count + group[same]
            self.tables.append((keys, count + np.arange(len(keys))))
            firsts.append(left[first])
            left, count = left[~same], count + len(keys)
        chosen = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
        self.start, self.length = start[chosen], length[chosen]
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[hashed >> np.uint64(64 - self.BITS)] = True

    @classmethod
    def of_texts(cls, texts: list[bytes]) -> TextSet:
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        return cls(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(length) - length, length)

    def find(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the spans are in the set, ascending; which text each of them is)."""
        maybe = np.flatnonzero(self.seen[hashed >> np.uint64(64 - self.BITS)])
        at, which = [], []
        for keys, index in self.tables:
            place = np.minimum(np.searchsorted(keys, hashed[maybe]), len(keys) - 1)
            hit = keys[place] == hashed[maybe]
            spot, own = maybe[hit], index[place[hit]]
            same = end[spot] - start[spot] == self.length[own]
            spot, own = spot[same], own[same]
            same = same_spans(text, start[spot], self.text, self.start[own], self.length[own])
            at.append(spot[same])
            which.append(own[same])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, which = np.concatenate(at), np.concatenate(which)
        order = np.argsort(at, kind="stable")
        return at[order], which[order]


def same_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray, step: int = 1 << 22) -> np.ndarray:
    """Whether a[a_start[i]:][:length[i]] equals b[b_start[i]:][:length[i]], byte by byte."""
    out = np.ones(len(length), bool)
    total = np.cumsum(length)
    row = 0
    while row < len(length):
        stop = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + step, "right")))
        n = length[row:stop]
        differ = a[spread(a_start[row:stop], n)] != b[spread(b_start[row:stop], n)]
        if differ.any():
            owner = np.repeat(np.arange(row, stop), n)
            out[owner[differ]] = False
        row = stop
    return out
