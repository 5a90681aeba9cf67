"""Token ids of whole texts, by the tokenizers library, once per distinct chunk.

A chunk begins where white space follows something else, or where an ASCII letter
is followed by an ASCII sign or digit. No token of the byte-level pre-tokenizer
crosses such a border and none looks back over it, so the ids of a text are the
ids of its chunks one after another; each distinct chunk is encoded once and kept
for the worker's later batches.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from tidewheel.llm.bytescan import spread

#: White space of one byte, and the first bytes of longer UTF-8 white space
#: (U+0085, U+00A0; U+1680, U+2000 and on, U+3000).
BLANK = np.zeros(256, bool)
BLANK[0x09:0x0E] = BLANK[0x20] = True
WIDE_2 = np.zeros(256, bool)
WIDE_2[0xC2] = True
WIDE_3 = np.zeros(256, bool)
WIDE_3[0xE1:0xE4] = True

LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
SIGN = np.zeros(256, bool)
SIGN[0x21:0x80] = True
SIGN &= ~LETTER

#: Chunks of more bytes are encoded anew each time; more chunks than this empty the cache.
CACHED_BYTES, CACHED_CHUNKS = 40, 500_000

#: Text to encode at once.
ENCODE_BYTES = 2 << 20


class Encoder:
    """Encodes documents that lie side by side in one buffer."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        sign = SIGN.copy()
        for token in self.tokenizer.get_added_tokens_decoder().values():  # a chunk's border must not cut one
            content = np.frombuffer(token.content.encode(), np.uint8)
            if BLANK[content].any():
                raise ValueError("added tokens with white space are not supported")
            sign[content[1:][LETTER[content[:-1]]]] = False
        self.kind = BLANK + 2 * LETTER.astype(np.uint8) + 4 * sign.astype(np.uint8)
        # the byte-level alphabet: how a pre-token's bytes are spelt; visible Latin-1 bytes are themselves, the others U+0100 and on
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.spelling = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in visible)}
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.entries = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros((1 << 14) + 1, np.int64)

    def _encode(self, chunks: list[bytes]) -> list[list[int]]:
        """A chunk that is one Latin word, with a blank before it or not, is one pre-token and goes to the model at once."""
        texts = [x.decode("utf-8", "replace") for x in chunks]
        ids: list[list[int] | None] = [None] * len(texts)
        tokenize, spell = self.tokenizer.model.tokenize, self.spelling
        rest = []
        for k, text in enumerate(texts):
            if text[text[0] == " " :].isalpha():
                if text.isascii():
                    ids[k] = [t.id for t in tokenize(text.replace(" ", "\u0120"))]
                    continue
                if max(text) < "\u0250":
                    ids[k] = [t.id for t in tokenize(chunks[k].decode("latin-1").translate(spell))]
                    continue
            rest.append(k)
        for k, x in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            ids[k] = x.ids
        return ids

    def _add(self, chunks: list[bytes]) -> np.ndarray:
        """Encode chunks and keep their ids; gives their entries."""
        ids = self._encode(chunks)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        n, used = self.entries, self.at[self.entries]
        total = int(lengths.sum())
        while used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(ids) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[used : used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.at[n + 1 : n + 1 + len(ids)] = used + np.cumsum(lengths)
        self.entries += len(ids)
        self.known.update((x, n + k) for k, x in enumerate(chunks) if len(x) <= CACHED_BYTES)
        return np.arange(n, n + len(ids))

    def __call__(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, number of ids of each)."""
        n, docs = len(raw), len(ends) - 1
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(docs, np.int64)
        kind = self.kind[raw]  # bits: 1 white space, 2 letter, 4 sign
        cut = np.zeros(n, np.uint8)
        cut[1:] = (kind[1:] & ~kind[:-1] & 1) | ((kind[:-1] << 1) & kind[1:] & 4)
        edge = np.flatnonzero(cut)
        edge = edge[raw[edge - 1] >= 0x80]
        wide = WIDE_2[raw[np.maximum(edge - 2, 0)]] | WIDE_3[raw[np.maximum(edge - 3, 0)]]
        cut[edge[wide]] = 0  # what stands before may be white space too
        cut[ends[:-1][ends[:-1] < ends[1:]]] = 1
        start = np.flatnonzero(cut)
        bounds = np.append(start, n).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        entry = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(entry < 0)
        if len(missing) and self.entries + len(missing) > CACHED_CHUNKS:
            self.clear()
            missing = np.arange(len(distinct))
        if len(missing):
            entry[missing] = self._add([distinct[k] for k in missing.tolist()])
        entry = entry[coded.indices.to_numpy(zero_copy_only=False)]
        begin = self.at[entry]
        length = self.at[entry + 1] - begin
        ids = self.flat[spread(begin, length)]
        upto = np.concatenate([[0], np.cumsum(length)])
        each = np.diff(upto[np.searchsorted(start, ends)])
        return ids, each


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)
