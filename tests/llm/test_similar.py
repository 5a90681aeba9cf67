"""The pipeline's near-duplicate stage against all pairs of documents."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tidewheel.llm import similar

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sets_of(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}


def plain_keep(rows):
    """Smallest id of each component of all pairs of similarity 0.8 or more."""
    rows = sorted(rows)
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = set()
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                linked.add((rows[j][0], rows[i][0]))
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {rows[k][0] for k in range(len(rows)) if find(k) == k}, linked


def near_copies():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, at = [(0, None), (1, ""), (2, "two words"), (3, "two words"), (4, "Two  words ok")], 5
    for size in (12, 40, 100, 300):
        for copies in (2, 3, 25):
            base = [word() for _ in range(size)]
            for _ in range(copies):
                text = list(base)
                for _ in range(rng.randrange(1, 2 + size // 30)):
                    text[rng.randrange(size)] = word()
                rows.append((at, " ".join(text)))
                at += 1
    rng.shuffle(rows)
    return rows


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, size, dtype=np.uint64)) for size in (1, 2, 31, 33, 63, 65, 200, 900, 2000)]
    for own in list(sets):
        for part in (3, 9, 40):
            other = own.copy()
            other[: len(own) // part] = rng.integers(0, 2**63, len(own) // part, dtype=np.uint64)
            sets.append(np.unique(other[: max(len(own) - rng.integers(3), 1)]))
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    column = pa.array([*similar.sketches(np.concatenate(sets), owner, np.bincount(owner)), None], pa.binary())
    x, y = np.triu_indices(len(sets))
    for most in (1, 64, 1 << 20):
        found = similar.Sketches(column).apart(x, y, most)
        real = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(x, y)])
        assert (found <= real).all()
        near = (real > 20) & (9 * real < 2 * np.array([len(sets[a]) + len(sets[b]) for a, b in zip(x, y)]))
        assert near.any() and (found[near] > 0.6 * real[near]).all()
    assert similar.Sketches(column).apart(np.array([0]), np.array([len(sets)])).tolist() == [0]


@pytest.mark.parametrize("options", [{"crowd": 2}, {"block": 3, "pivots": 0}])
def test_near_copies_against_all_pairs(spark, options):
    rows = near_copies()
    want, linked = plain_keep(rows)
    assert len(linked) > 60 and len(want) < len(rows) - 20
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS).repartition(5)
    assert sorted(r.doc_id for r in similar.keep_one(docs, **options).collect()) == sorted(want)


def test_stage_drops_near_copies_beyond_two_bits(spark, small):
    base = [f"word{k}" for k in range(200)]
    near, far = list(base), list(base)
    for k in (30, 90, 150):
        near[k] = "other"
    for k in range(10, 200, 12):
        far[k] = "else"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    assert plain_keep(rows)[0] == {1, 3}
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)
    assert {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, small).collect()} == {1, 3}
