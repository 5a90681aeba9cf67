"""Chat formatting by columnar byte assembly (operator 6).

A turn becomes `<|im_start|>role LF text<|im_end|> LF`. The lengths of all segments of
a batch of turns give offsets by one cumulative sum; headers, roles and texts are
scattered by index arrays into one preallocated buffer, which is the data buffer of
the Arrow strings that the task returns, one for each conversation.

Texts cannot forge control strings: in them `<`, any number of backslashes and `|`
gets one backslash more, and reading takes one away. In roles, backslash and line
feed are written as two characters besides. Loss spans are the places of assistant
texts in the formatted string, in characters.

Turns of a conversation are brought together by a shuffle on its id and sorted by
turn (then role and text, for repeated turns). A conversation is one string of the
result: one task holds it, and beyond 2 GiB, more than a row can have, it is an error. Short
conversations are formatted by slices of `slice_bytes`.

Defined cases: null role or text is empty; a null turn comes first; a row with a null
conversation id is a conversation of its own, with a null id; repeated rows are turns as
often as they come; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.bytescan import buffers, spread

#: The template's control strings.
START, END = b"<|im_start|>", b"<|im_end|>\n"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)

#: Bytes of a string, at most.
LARGEST = (1 << 31) - 1

FORMATTED = "conv_id long, formatted string, n_turns long, loss_spans array<struct<start:long,stop:long>>"
SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"<(\\*)\|", r"<$1\\|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(F.coalesce(role.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def within_a_row(size: int, name: object) -> None:
    if size > LARGEST:
        raise ValueError(f"conversation {name} is longer than a row can be")


def assemble(roles: tuple[np.ndarray, np.ndarray], texts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all formatted turns, where each turn starts, where its text starts) for n turns."""
    (role, role_at), (text, text_at) = roles, texts
    role_size, text_size = np.diff(role_at), np.diff(text_at)
    size = len(START) + role_size + 1 + text_size + len(END)
    turn = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(turn[-1]), np.uint8)
    at = turn[:-1]
    out[at[:, None] + np.arange(len(START))] = np.frombuffer(START, np.uint8)
    at = at + len(START)
    out[spread(at, role_size)] = role
    at = at + role_size
    out[at] = 10
    text_start = at + 1
    out[spread(text_start, text_size)] = text
    out[(text_start + text_size)[:, None] + np.arange(len(END))] = np.frombuffer(END, np.uint8)
    return out, turn, text_start


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant", slice_bytes: int = 16 << 20) -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns, loss_spans."""
    turns = rows.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(turn_col).cast("long").alias("turn"),
        escaped_role(F.col(role_col)).alias("role"),
        escaped(F.col(text_col)).alias("text"),
        (F.coalesce(F.col(role_col).cast("string"), F.lit("")) == loss_role).alias("loss"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one conversation
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = _heads(batch)
            if held and _same(held[-1], batch):
                stop = int(heads[1]) if len(heads) > 1 else batch.num_rows
                held.append(batch.slice(0, stop))
                batch, heads = batch.slice(stop), heads[1:] - stop
            if len(heads):
                if held:
                    yield _formatted(pa.concat_batches(held), np.zeros(1, np.int64))
                yield from _sliced(batch.slice(0, int(heads[-1])), heads[:-1])
                held = [batch.slice(int(heads[-1]))]
        if held:
            yield _formatted(pa.concat_batches(held), np.zeros(1, np.int64))

    def _heads(batch: pa.RecordBatch) -> np.ndarray:
        null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]) | null[1:] | null[:-1]) + 1])

    def _same(before: pa.RecordBatch, batch: pa.RecordBatch) -> bool:
        a, b = before.column(0)[-1], batch.column(0)[0]
        return a.is_valid and b.is_valid and a == b

    def _sliced(batch: pa.RecordBatch, heads: np.ndarray) -> Iterator[pa.RecordBatch]:
        upto = np.cumsum(np.diff(buffers(batch.column(3))[1]) + np.diff(buffers(batch.column(2))[1]))
        bounds = np.append(heads, batch.num_rows)
        size = np.append(0, upto)[bounds]
        first = 0
        while first < len(heads):
            stop = max(first + 1, int(np.searchsorted(size, size[first] + slice_bytes, "right")) - 1)
            yield _formatted(batch.slice(int(bounds[first]), int(bounds[stop] - bounds[first])), heads[first:stop] - heads[first])
            first = stop

    def _formatted(batch: pa.RecordBatch, heads: np.ndarray) -> pa.RecordBatch:
        text = buffers(batch.column(3))
        out, turn, text_start = assemble(buffers(batch.column(2)), text)
        within_a_row(int(turn[-1]), batch.column(0)[0])
        bounds = np.append(heads, batch.num_rows)
        strings = pa.Array.from_buffers(pa.string(), len(heads), [None, pa.py_buffer(turn[bounds].astype(np.int32)), pa.py_buffer(out)])
        chars = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
        loss = np.flatnonzero(batch.column(4).to_numpy(zero_copy_only=False))
        base = chars[turn[heads[np.searchsorted(heads, loss, "right") - 1]]]
        begin, stop = text_start[loss], text_start[loss] + np.diff(text[1])[loss]
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(loss, bounds), pa.int32()), pa.StructArray.from_arrays([pa.array(chars[begin] - base), pa.array(chars[stop] - base)], fields=list(SPAN)))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(heads)), strings, pa.array(np.diff(bounds)), spans], names=["conv_id", "formatted", "n_turns", "loss_spans"])

    alone = F.when(F.col("id").isNull(), F.xxhash64("turn", "role", "text"))
    return turns.repartition("id", alone).sortWithinPartitions("id", "turn", "role", "text").mapInArrow(run, FORMATTED)


def read_chats(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, parsed from `formatted` and `loss_spans` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns, at, whole = 0, 0, hashlib.sha256()
                while m := TURN.match(text, at):
                    whole.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                    turns, at = turns + 1, m.end()
                if at != len(text):
                    raise ValueError("a formatted conversation does not parse")
                loss = "".join(unescape(text[x["start"] : x["stop"]]) for x in spans)
                out.append((turns, whole.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
