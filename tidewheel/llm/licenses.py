"""License scan by an exact set-similarity join (operator 4).

Texts are cut into blocks of words: a template of up to L words (L a power of two, at
least 16) is sought in the blocks of 2 L words that begin at every L-th word, so each place
of L words lies wholly in one, however its lines are broken. Blocks are joined with the
license templates whose containment |template & block| / |template| reaches the
threshold; both are sets of words. The join is exact:

* tokens are ordered by their frequency in all documents, rarest first (one pass
  that counts the templates' tokens, pre-aggregated in each task);
* prefix filter: a block that reaches o = ceil(threshold * |T|) common tokens has one
  of T's |T| - o + 1 rarest tokens;
* length filter: it has o words at least;
* positional filter: after the first common prefix token, at most as many common
  tokens follow as both have tokens behind it in the order.

Blocks that pass are compared in full. Two kinds of template are confirmed further, as
sets of a few words say little: short notices (under `short` different words) count at
a containment of 1 and with their words standing one after another, and licenses with
like texts have words that must be there, or must not. The templates and their order, some
hundred words fixed in license_notices, go to all tasks with the code; blocks are never shuffled.

Places of base phrases (words standing consecutively) are found in the same scan.

Defined cases: a null text counts as empty and has a row with no words; empty tables
give no rows (and any order of tokens); repeated documents each have a row; ties in
frequency are ordered by the token; only the id and the text are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.bytescan import ALNUM, SpanHash, TextSet, Words, slices, spread
from tidewheel.llm.license_notices import FOREIGN, NEEDED, NOTICES, PHRASES

#: Words of a block: at least this many, for templates of up to half as many.
LEAST_BLOCK = 32
SHORT = 12


def words_of(text: str) -> list[str]:
    """The words of an ASCII text, as tasks cut them."""
    return re.findall("[0-9a-z]+", text.lower())


OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<word:long,template:int,label:string,containment:double>>"
MATCH = pa.struct([("word", pa.int64()), ("template", pa.int32()), ("label", pa.string()), ("containment", pa.float64())])


class Vocabulary:
    """The words of templates, phrases and conditions; ranks order them by frequency, rarest first."""

    def __init__(self, templates: list[tuple[str, str]], texts: list[str]) -> None:
        self.words = sorted({w for t in [*(t for _, t in templates), *texts] for w in words_of(t)})
        self.index = {w: k for k, w in enumerate(self.words)}

    def tokens(self, words: Words, texts: TextSet) -> np.ndarray:
        """The vocabulary word at each word, or -1."""
        out = np.full(len(words), -1, np.int32)
        if len(words):
            at, which = texts.find(words.text, words.start, words.end, SpanHash(words.text)(words.start, words.end))
            out[at] = np.argsort(texts.of)[which]  # a text's number is the place of its hash
        return out

    def texts(self) -> TextSet:
        return TextSet.of_texts([w.encode() for w in self.words])


def token_order(docs: DataFrame, vocabulary: Vocabulary) -> list[int]:
    """Vocabulary words by ascending frequency in all of the `text` column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(len(vocabulary.words), np.int64), vocabulary.texts()
        for batch in batches:
            for _, raw, ends in slices(batch, "text"):
                token = vocabulary.tokens(Words(raw, ends, ALNUM), texts)
                total += np.bincount(token[token >= 0], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["token", "n"])

    counted = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    n = {r.token: r.n for r in counted.collect()}  # one row for each word of the templates
    return sorted(range(len(vocabulary.words)), key=lambda t: (n.get(t, 0), vocabulary.words[t]))


class Templates:
    """Templates as sets of ranks, with their prefixes; those of one block length together."""

    def __init__(self, templates: list[tuple[str, str]], vocabulary: Vocabulary, order: list[int], threshold: float, short: int, needed: dict[str, list[str]], foreign: dict[str, list[str]]) -> None:
        rank = {t: r for r, t in enumerate(order)}
        self.rank = np.array([rank[t] for t in range(len(order))], np.int32)
        self.labels = [label for label, _ in templates]
        self.member = np.zeros((len(templates), len(order)), bool)
        self.least = np.zeros(len(templates), np.int64)
        self.sequence: list[np.ndarray | None] = []
        self.needed: list[list[int]] = []
        self.foreign: list[list[int]] = []
        self.by_step: dict[int, dict[int, list[int]]] = {}  # words between blocks -> rank of a prefix token -> templates
        ranks_of = lambda words: [rank[vocabulary.index[w]] for w in words]
        for k, (label, text) in enumerate(templates):
            sequence = ranks_of(words_of(text))
            ranks = sorted(set(sequence))
            exact = len(ranks) < short
            self.member[k, ranks] = True
            self.least[k] = len(ranks) if exact else math.ceil(threshold * len(ranks) - 1e-9)
            self.sequence.append(np.array(sequence) if exact else None)
            self.needed.append([] if exact else ranks_of(needed.get(label, [])))
            self.foreign.append([] if exact else ranks_of(foreign.get(label, [])))
            prefix = self.by_step.setdefault(block_step(len(sequence)), {})
            for r in ranks[: len(ranks) - int(self.least[k]) + 1]:
                prefix.setdefault(r, []).append(k)
        self.size = self.member.sum(axis=1)

    def confirmed(self, k: int, has: np.ndarray, rank: np.ndarray) -> bool:
        """What a template asks for besides its containment, of a block's set and sequence of ranks."""
        if self.sequence[k] is not None:
            windows = np.lib.stride_tricks.sliding_window_view(rank, len(self.sequence[k]))
            return bool((windows == self.sequence[k]).all(axis=1).any())
        return bool(has[self.needed[k]].all() and not has[self.foreign[k]].any())


def block_step(words: int) -> int:
    """How many words apart the blocks begin in which a template of so many words is sought; they are twice as long."""
    return max(LEAST_BLOCK // 2, 1 << (words - 1).bit_length())


def matches(words: Words, rank: np.ndarray, t: Templates) -> list[tuple[int, int, int, float]]:
    """(document, first word of the block in it, template, containment) of all pairs that reach the threshold."""
    out = []
    count = np.diff(words.number)
    for step, prefix in t.by_step.items():
        is_prefix = np.zeros(len(t.rank) + 1, bool)  # the last one is for words outside of the vocabulary, of rank -1
        is_prefix[list(prefix)] = True
        at = np.flatnonzero(is_prefix[rank])
        if not len(at):
            continue
        first = np.concatenate([[0], np.cumsum(-(-count // step))])  # of each document's blocks
        document = np.searchsorted(words.number, at, "right") - 1
        block = (at - words.number[document]) // step
        both = np.concatenate([np.stack([first[document] + block, rank[at]]), np.stack([first[document] + block - 1, rank[at]])[:, block > 0]], axis=1)
        both = np.unique(both, axis=1)
        pairs = np.unique(np.array([(b, k) for b, r in both.T.tolist() for k in prefix[r]], np.int64).reshape(-1, 2), axis=0)
        document = np.searchsorted(first, pairs[:, 0], "right") - 1
        word = (pairs[:, 0] - first[document]) * step
        a = words.number[document] + word
        b = np.minimum(a + 2 * step, words.number[document + 1])
        ok = b - a >= t.least[pairs[:, 1]]  # length filter
        k_all, a, b, document, word = pairs[ok, 1], a[ok], b[ok], document[ok], word[ok]
        for lo in range(0, len(k_all), 2048):
            part = slice(lo, lo + 2048)
            n = b[part] - a[part]
            has = np.zeros((len(n), len(t.rank)), bool)
            own, r = np.repeat(np.arange(len(n)), n), rank[spread(a[part], n)]
            has[own[r >= 0], r[r >= 0]] = True
            k = k_all[part]
            common = has & t.member[k]
            lead = common.argmax(axis=1)
            each = np.arange(len(n))
            behind = np.minimum(t.size[k] - np.cumsum(t.member[k], axis=1)[each, lead], has.sum(axis=1) - np.cumsum(has, axis=1)[each, lead])
            alive = common.any(axis=1) & (1 + behind >= t.least[k])  # positional filter
            overlap = common.sum(axis=1)
            for i in np.flatnonzero(alive & (overlap >= t.least[k])).tolist():
                if t.confirmed(int(k[i]), has[i], rank[a[lo + i] : b[lo + i]]):
                    out.append((int(document[lo + i]), int(word[lo + i]), int(k[i]), float(overlap[i] / t.size[k[i]])))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = NOTICES, phrases: dict[str, str] = PHRASES, threshold: float = 0.8, short: int = SHORT, needed: dict[str, list[str]] = NEEDED, foreign: dict[str, list[str]] = FOREIGN) -> DataFrame:
    """One row per document: its words, base places, labels, best containment, and all matching blocks."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    vocabulary = Vocabulary(templates, [*phrases, *(w for x in (needed, foreign) for words in x.values() for w in words)])
    joined = Templates(templates, vocabulary, token_order(rows, vocabulary), threshold, short, needed, foreign)
    wanted = [([int(joined.rank[vocabulary.index[w]]) for w in p.split()], label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = vocabulary.texts()
        for batch in batches:
            for part, raw, ends in slices(batch, "text"):
                words = Words(raw, ends, ALNUM)
                token = vocabulary.tokens(words, texts)
                rank = np.where(token >= 0, joined.rank[token], -1)
                n = part.num_rows
                base, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
                base_labels: list[set[str]] = [set() for _ in range(n)]
                labels: list[set[str]] = [set() for _ in range(n)]
                score, found = np.zeros(n), [[] for _ in range(n)]
                for phrase, label in wanted:
                    at = np.flatnonzero(rank == phrase[0])
                    at = at[at + len(phrase) <= len(rank)]
                    for k, r in enumerate(phrase):
                        at = at[rank[at + k] == r]
                    d = np.searchsorted(words.number, at, "right") - 1
                    inside = at + len(phrase) <= words.number[d + 1]
                    for d, i in zip(d[inside].tolist(), (at - words.number[d])[inside].tolist()):
                        first[d] = i if base[d] == 0 else min(first[d], i)
                        last[d] = max(last[d], i)
                        base[d] += 1
                        base_labels[d].add(label)
                        score[d] = 1.0
                for d, word, k, share in matches(words, rank, joined):
                    labels[d].add(joined.labels[k])
                    score[d] = max(score[d], share)
                    found[d].append({"word": word, "template": k, "label": joined.labels[k], "containment": share})
                none = base == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(words.number)),
                        pa.array(base),
                        pa.array(first, pa.int64(), mask=none),
                        pa.array(last, pa.int64(), mask=none),
                        pa.array([",".join(sorted(x)) for x in base_labels], pa.string()),
                        pa.array([",".join(sorted(x | y)) for x, y in zip(base_labels, labels)], pa.string()),
                        pa.array(score),
                        pa.array(found, pa.list_(MATCH)),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
                )

    return rows.mapInArrow(run, OUT)
