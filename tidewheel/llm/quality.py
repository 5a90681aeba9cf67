"""Ordinal quality classifier: a cumulative-link model on hashed text (operator 10).

Ratings are grades 0 < 1 < ... < K - 1. One score f(x) = w . x, shared by all grades,
and ordered thresholds t_0 < ... < t_{K-2} give P(grade <= g) = sigmoid(t_g - f(x)),
and so the expected grade and the tail probability P(grade >= good) that selects.

Features are the presence of: words, their first 4 and 5 bytes, every six bytes that
begin with a non-ASCII character of a long word (scripts without blanks), runs of signs,
and coarse shape (share of distinct words, of signs, length); each is a 64-bit hash of
all of its bytes. Features that stand in `min_docs` of the fitted documents, and not in
nearly all of them, have a weight; scoring looks hashes up in a table, so other words
cannot collide with them.

The model is fitted on at most `max_fit` rated documents, those of smallest hash of their
id: the only bound, and one on rows. Tasks hash whole texts and count in how many of the
documents a feature stands; only features that get a weight reach the driver, as numbers.
There, proximal gradient steps with an L1 penalty, which leaves words that say nothing at
zero, run until the penalised likelihood no longer falls. All documents are scored, in one
scan without a shuffle.

Defined cases: null texts are empty and scored like any text; ratings that are null,
or whose document is missing, are not fitted; repeated ratings and documents
are fitted once; without ratings, or with one grade only, every document gets the same score
and is kept; empty tables give no rows; all columns of documents are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.bytescan import ALNUM, NON_BLANK, SpanHash, Words, slices
from tidewheel.llm.shared import Scratch

#: Bound of what is fitted, in rated documents.
MAX_FIT = 8_000
#: Text whose features are taken at once, unless one document is longer.
FEATURE_BYTES = 1 << 19
#: Words of more bytes have features of parts that begin with a non-ASCII character.
LONG_WORD, PART = 15, 6
SIGNS = NON_BLANK & ~ALNUM
SIGNS[0x41:0x5B] = False


def features(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct feature hashes of all documents of a slice, where each document's begin)."""
    docs = len(ends) - 1
    found, owner = [], []
    words, signs = Words(raw, ends, ALNUM), Words(raw, ends, SIGNS)
    for part, kind in ((words, 1), (signs, 2)):
        if not len(part):
            continue
        document, span_hash, size = part.document(), SpanHash(part.text), part.end - part.start
        found.append(_salted(span_hash(part.start, part.end), kind))
        owner.append(document)
        if kind == 1:
            for first in (4, 5):
                long = size > first
                found.append(_salted(span_hash(part.start[long], part.start[long] + first), 10 + first))
                owner.append(document[long])
            lead = np.flatnonzero(part.text >= 0xC0)
            word = np.searchsorted(part.start, lead, "right") - 1
            lead, word = lead[size[word] > LONG_WORD], word[size[word] > LONG_WORD]
            found.append(_salted(span_hash(lead, np.minimum(lead + PART, part.end[word])), 30))
            owner.append(document[word])
    found_all = np.concatenate(found) if found else np.zeros(0, np.uint64)
    owner_all = np.concatenate(owner) if owner else np.zeros(0, np.int32)
    found_all, owner_all = _distinct(found_all, owner_all)
    n_words, n_signs = np.diff(words.number), np.diff(signs.number)
    alike = np.zeros(docs)
    if len(words):
        h, d = _distinct(SpanHash(words.text)(words.start, words.end), words.document())
        alike = np.bincount(d, minlength=docs)
    share = [np.floor(10 * alike / np.maximum(n_words, 1)), np.minimum(np.floor(10 * n_signs / np.maximum(n_words, 1)), 10), np.minimum(np.floor(2 * np.log2(n_words + 1)), 16)]
    for k, x in enumerate(share):
        found_all = np.concatenate([found_all, _salted(x.astype(np.uint64), 20 + k)])
        owner_all = np.concatenate([owner_all, np.arange(docs, dtype=np.int32)])
    order = np.argsort(owner_all, kind="stable")
    return found_all[order], np.searchsorted(owner_all[order], np.arange(docs + 1))


def _salted(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(31))


def _distinct(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, document) pairs; documents ascend."""
    if not len(h):
        return h, owner
    order = np.argsort(h ^ (owner.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))  # equal pairs stand together
    h, owner = h[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
    return h[new], owner[new]


@dataclass
class Model:
    keys: np.ndarray  # ascending feature hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    BITS = 22

    def __post_init__(self) -> None:
        self.slot = np.full(1 << self.BITS, -1, np.int32)
        if len(self.keys):
            place = (self.keys >> np.uint64(64 - self.BITS)).astype(np.int64)
            self.slot[place] = np.arange(len(self.keys), dtype=np.int32)
            self.crowded = np.zeros(1 << self.BITS, bool)
            self.crowded[place[self.slot[place] != np.arange(len(self.keys))]] = True

    def score(self, found: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(at) - 1)
        place = (found >> np.uint64(64 - self.BITS)).astype(np.int64)
        entry = self.slot[place]
        value = np.where((entry >= 0) & (self.keys[entry] == found), self.weights[entry], 0.0)
        more = np.flatnonzero(self.crowded[place])  # slots of several keys are searched
        spot = np.minimum(np.searchsorted(self.keys, found[more]), len(self.keys) - 1)
        value[more] = np.where(self.keys[spot] == found[more], self.weights[spot], 0.0)
        upto = np.concatenate([[0.0], np.cumsum(value)])
        return upto[at[1:]] - upto[at[:-1]]

    def tails(self, f: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g = 1 .. K - 1."""
        return _sigmoid(f[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(column: np.ndarray, at: np.ndarray, n_features: int, grades: np.ndarray, n_grades: int, penalty: float = 3e-4, tolerance: float = 3e-5, grow: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ascending thresholds) of least mean negative log likelihood + penalty * sum of |weights|.

    Document d has the features column[at[d]:at[d + 1]]. Most weights are zero at the optimum, so the problem is solved
    on a working set; the features outside whose slope exceeds the penalty, the steepest `grow` first, join it until
    there are none (the optimum's own condition).
    """
    n = len(grades)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
    share = np.bincount(grades, minlength=n_grades)[:n_grades] + 0.5
    below = np.cumsum(share)[:-1] / share.sum()
    weights, thresholds = np.zeros(n_features), np.log(below / (1 - below))
    working = np.zeros(n_features, bool)
    while True:
        _, pull, _ = _likelihood(np.bincount(row, weights=weights[column], minlength=n), thresholds, grades, True)
        slope = np.abs(np.bincount(column, weights=pull[row], minlength=n_features)) / n
        more = np.flatnonzero(~working & (slope > penalty * 1.01))
        if not len(more):
            return weights, thresholds
        working[more[np.argsort(-slope[more], kind="stable")[:grow]]] = True
        chosen, number = np.flatnonzero(working), np.cumsum(working) - 1
        use = working[column]
        weights[chosen], thresholds = _descend(number[column[use]], row[use], weights[chosen], thresholds, grades, penalty, tolerance)


def _likelihood(f: np.ndarray, thresholds: np.ndarray, grades: np.ndarray, slopes: bool = False):
    """(mean negative log likelihood of the grades; slopes of its sum in each f, and in each threshold); infinite where impossible."""
    edge = np.concatenate([[-np.inf], thresholds, [np.inf]])
    high, low = _sigmoid(edge[grades + 1] - f), _sigmoid(edge[grades] - f)
    gap = high - low
    if (np.diff(thresholds) <= 0).any() or (gap <= 0).any():
        return np.inf, None, None
    value = -np.log(gap).mean()
    if not slopes:
        return value, None, None
    up, down = high * (1 - high) / gap, low * (1 - low) / gap
    moves = [down[grades == g + 1].sum() - up[grades == g].sum() for g in range(len(thresholds))]
    return value, 1 - high - low, np.array(moves)


def _descend(column: np.ndarray, row: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, grades: np.ndarray, penalty: float, tolerance: float, max_rounds: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal gradient steps from (weights, thresholds).

    Their length is found by backtracking, and momentum starts anew where the objective rises. They end once it has
    fallen by less than `tolerance` of itself in ten rounds.
    """
    n, k = len(grades), len(weights)
    # features of one document share its curvature; a common scale of the steps is found from there
    per_row = np.bincount(row, minlength=n) + 2.0
    curve = np.concatenate([np.bincount(column, weights=per_row[row], minlength=k), np.full(len(thresholds), per_row.sum() / 2)]) / (4 * n) + 1e-9
    limit = np.concatenate([np.full(k, penalty), np.zeros(len(thresholds))])

    def likelihood(x: np.ndarray, slopes: bool = False):
        value, pull, moves = _likelihood(np.bincount(row, weights=x[column], minlength=n), x[k:], grades, slopes)
        return value, np.concatenate([np.bincount(column, weights=pull[row], minlength=k), moves]) / n if pull is not None else None

    x = np.concatenate([weights, thresholds])
    best = likelihood(x)[0] + limit @ np.abs(x)
    y, t, scale, values = x, 1.0, 1 / 32, [best]
    for _ in range(max_rounds):
        value, slope = likelihood(y, True)
        if slope is None:
            y, t = x, 1.0
            value, slope = likelihood(y, True)
        while True:
            new = y - slope / (scale * curve)
            new = np.sign(new) * np.maximum(np.abs(new) - limit / (scale * curve), 0)
            move = new - y
            there = likelihood(new)[0]
            if there <= value + slope @ move + 0.5 * scale * (curve @ (move * move)) + 1e-13:
                break
            scale *= 2
        objective = there + limit @ np.abs(new)
        if objective > values[-1]:
            if t == 1.0:
                break  # not even a plain step descends: as low as numbers go
            y, t = x, 1.0
            continue
        values.append(objective)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
        scale *= 0.95
        if len(values) > 10 and values[-11] - values[-1] < tolerance * abs(values[-1]):
            break
    return x[:k], x[k:]


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", max_fit: int = MAX_FIT, min_docs: int = 3, **options) -> Model:
    """Fit on at most `max_fit` ratings (id_col, grade_col) that have a document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    chosen = ratings.select(F.col(id_col).cast("long").alias("rated"), F.col(grade_col).cast("int").alias("grade")).where(F.col("rated").isNotNull() & F.col("grade").between(0, n_grades - 1)).distinct()
    chosen = chosen.orderBy(F.xxhash64("rated"), "rated", "grade").limit(max_fit)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("t"))
    rated = rows.join(F.broadcast(chosen), F.col("id") == F.col("rated"))
    wanted = rated.select(F.col("id").alias("id_"), "grade", F.col("t").alias("t_")).distinct().orderBy(F.xxhash64("id_"), "id_", "grade", "t_").limit(max_fit)
    wanted = scratch.keep(wanted, "wanted")
    fitted = rows.join(F.broadcast(wanted), (F.col("id") == F.col("id_")) & (F.col("t") == F.col("t_"))).dropDuplicates(["id", "t", "grade"]).select("id", "grade", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, ends in slices(batch, "text", FEATURE_BYTES):
                found, at = features(raw, ends)
                blobs = pa.array([found[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), blobs], names=["id", "grade", "found"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = np.unique(_hashes(batch.column(0)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    known = scratch.keep(fitted.mapInArrow(hashed, "id long, grade int, found binary"), "features")
    n_docs = known.count()
    common = known.select("found").mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where((F.col("n") >= min_docs) & (F.col("n") <= 0.98 * n_docs))
    keys = np.sort(common.select("key").toArrow().column("key").to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast(keys)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _hashes(batch.column(2))
            owner = np.repeat(np.arange(batch.num_rows), pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False) // 8)
            place = np.minimum(np.searchsorted(shared.value, found), len(shared.value) - 1)
            use = shared.value[place] == found
            at = np.searchsorted(owner[use], np.arange(batch.num_rows + 1))
            numbers = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(place[use], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), numbers], names=["id", "grade", "numbers"])

    if len(keys) and known.select("grade").distinct().count() > 1:
        got = known.mapInArrow(numbered, "id long, grade int, numbers array<int>").toArrow().sort_by([("id", "ascending"), ("grade", "ascending")])
        lists = got.column("numbers").combine_chunks()
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        weights, thresholds = fit(lists.flatten().to_numpy(), at, len(keys), got.column("grade").to_numpy(), n_grades, **options)
    else:
        weights, thresholds = np.zeros(len(keys)), np.full(max(n_grades - 1, 1), -30.0)
    shared.unpersist()
    scratch.drop(wanted, known)
    return Model(keys[weights != 0], weights[weights != 0], thresholds)


def _hashes(column: pa.Array) -> np.ndarray:
    """All hashes of a column of hashes as bytes."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint64) if len(column) else np.zeros(0, np.uint64)


def score(docs: DataFrame, model: Model, text_col: str = "text", good: int | None = None, names: tuple[str, str] = ("expected_grade", "tail"), keep: list[str] | None = None, at_least: float | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if None) with the expected grade and P(grade >= good).

    With `at_least`, only documents whose tail probability reaches it, without the two new columns.
    """
    good = len(model.thresholds) if good is None else good
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, ends in slices(batch, text_col, FEATURE_BYTES):
                tails = shared.value.tails(shared.value.score(*features(raw, ends)))
                columns = [part.column(part.schema.get_field_index(c)) for c in keep]
                if at_least is None:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, good - 1])], names=[*keep, *names])
                else:
                    yield pa.RecordBatch.from_arrays(columns, names=keep).filter(pa.array(tails[:, good - 1] >= at_least))

    fields = [docs.schema[c] for c in keep]
    if at_least is None:
        fields += [T.StructField(c, T.DoubleType()) for c in names]
    return docs.mapInArrow(run, T.StructType(fields))


def grades_of(labels: DataFrame) -> DataFrame:
    """Grades from the quality (0/1) and toxic (0/1) marks: 0 toxic, 1 poor, 2 good."""
    return labels.where("quality is not null and toxic is not null").select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade"))
