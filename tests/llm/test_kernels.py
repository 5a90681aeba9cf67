"""Vectorised kernels against plain versions."""

import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewheel.llm import bytescan, encoding, inverted_multi_index, packing, quality, simhash, similar, token_archive
from tidewheel.llm.line_dedup import deciding_runs

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
texts = st.lists(st.text(alphabet="aB9 é'\n\t.,|<>endoftx 　日ñ", max_size=40), max_size=6)


@given(texts)
@settings(max_examples=200, deadline=None)
def test_words(found):
    raw, ends = bytescan.buffers(pa.array(found, pa.string()))
    for kind, pattern in ((bytescan.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (bytescan.NON_BLANK, r"[^\x20\x09-\x0D]+")):
        words = bytescan.Words(raw, ends, kind, lines=True)
        plain = [re.findall(pattern, t.translate(LOW)) for t in found]
        got = [bytes(words.text[a:b]).decode() for a, b in zip(words.start, words.end)]
        assert got == [w for x in plain for w in x]
        assert np.diff(words.number).tolist() == [len(x) for x in plain]
        assert all(bytes(raw[b : b + e - s]).decode().translate(LOW) == w for b, s, e, w in zip(words.begin, words.start, words.end, got))
        assert np.diff(words.first_line).tolist() == [t.count("\n") + 1 for t in found]


def test_buffers_of_slices_and_nulls():
    column = pa.array(["skip", "ab", None, "c"])
    raw, ends = bytescan.buffers(column.slice(1))
    assert bytes(raw) == b"abc" and ends.tolist() == [0, 2, 2, 3]
    assert bytescan.buffers(pa.array([], pa.string()))[1].tolist() == [0]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10, "", "y" * 3, "z" * 50, None])], names=["text"])
    assert [(p.num_rows, len(r)) for p, r, _ in bytescan.slices(batch, "text", 12)] == [(2, 10), (1, 3), (2, 50)] or sum(len(r) for _, r, _ in bytescan.slices(batch, "text", 12)) == 63


def test_text_set_confirms_bytes():
    texts = [b"one", b"two", b"three", b"two"]
    found = bytescan.TextSet.of_texts(texts)
    number = {t: k for t, k in zip(texts, found.of.tolist())}
    assert found.of[1] == found.of[3] and sorted(number.values()) == [0, 1, 2]
    text = np.frombuffer(b"two onex three", np.uint8)
    start, end = np.array([0, 4, 4, 9]), np.array([3, 7, 8, 14])
    at, which = found.find(text, start, end, bytescan.SpanHash(text)(start, end))
    assert at.tolist() == [0, 1, 3] and which.tolist() == [number[b"two"], number[b"one"], number[b"three"]]


def test_text_set_tells_texts_of_one_hash_apart(monkeypatch):
    class Same(bytescan.SpanHash):
        def __call__(self, start, end):
            return np.full(len(start), 7, np.uint64)

    monkeypatch.setattr(bytescan, "SpanHash", Same)
    found = bytescan.TextSet.of_texts([b"ab", b"cd", b"efg", b"cd"])
    assert len(found.tables) == 3 and found.of[1] == found.of[3] and len(set(found.of.tolist())) == 3
    text = np.frombuffer(b"cd xx efg", np.uint8)
    start, end = np.array([0, 3, 6]), np.array([2, 5, 9])
    at, which = found.find(text, start, end, np.full(3, 7, np.uint64))
    assert at.tolist() == [0, 2] and which.tolist() == [found.of[1], found.of[2]]


@pytest.fixture(scope="module")
def coder():
    return encoding.encoder(public_tokenizers.path("byte_bpe_50k.json"))


@given(texts)
@settings(max_examples=300, deadline=None)
def test_encoding_is_the_tokenizers(found):
    coder = encoding.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, each = coder(*bytescan.buffers(pa.array(found, pa.string())))
    plain = [x.ids for x in coder.tokenizer.encode_batch(found, add_special_tokens=False)]
    assert ids.tolist() == [t for x in plain for t in x] and each.tolist() == [len(x) for x in plain]


def test_encoding_after_the_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(encoding, "CACHED_CHUNKS", 5)
    coder = encoding.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("one two three four", "two three five six seven", "one eight nine ten " + "x" * 100, "<|endoftext|> a|b <|endoftext|>"):
        ids, _ = coder(*bytescan.buffers(pa.array([text])))
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 9), max_size=400), st.integers(1, 40))
@settings(max_examples=100, deadline=None)
def test_grammar_round_trip(ids, repeats):
    seq = np.array(ids * repeats, np.uint32)
    rules, expansion, stream = token_archive.compress(seq, 10, min_count=2)
    grammar = token_archive.Grammar(10, rules.tobytes(), expansion.tobytes(), stream.tobytes())
    assert np.array_equal(grammar.all(), seq)
    for a, b in ((0, len(seq)), (len(seq) // 3, len(seq) // 2), (len(seq), len(seq)), (0, min(1, len(seq)))):
        assert np.array_equal(grammar.read(a, b), seq[a:b])
    if len(ids) > 20 and repeats > 10:
        assert len(stream) < len(seq) / 2


def test_grammar_of_a_large_vocabulary():
    seq = np.array([70_000, 90_000] * 50, np.uint32)
    grammar = token_archive.Grammar(100_000, *(x.tobytes() for x in token_archive.compress(seq, 100_000)))
    assert np.array_equal(grammar.all(), seq) and len(grammar.stream) < 20


@given(st.lists(st.integers(0, 3), min_size=50, max_size=600), st.integers(2, 9), st.integers(1, 64))
@settings(max_examples=60, deadline=None)
def test_no_frequent_pair_is_left(ids, min_count, per_round):
    _, _, stream = token_archive.compress(np.array(ids * 4, np.uint32), 4, per_round, min_count)
    _, counts = np.unique(np.stack([stream[:-1], stream[1:]]), axis=1, return_counts=True)
    assert len(counts) == 0 or counts.max() < min_count


@given(st.lists(st.integers(0, 5000), max_size=60), st.sampled_from([1, 2, 64, 1024]))
@settings(max_examples=100, deadline=None)
def test_pieces_fill_sequences(lengths, capacity):
    bins, rows = packing.Bins(capacity, 0), []
    for k, n in enumerate(lengths):
        rows += bins.add(k, np.arange(n, dtype="<u4"))
    rows += bins.close()
    covered, sequences = {}, {}
    for doc, start, ids, n, sequence, offset in rows:
        assert n == lengths[doc] and ids.tolist() == list(range(start, start + len(ids))) and len(ids)
        covered.setdefault(doc, []).append((start, len(ids)))
        sequences.setdefault(sequence, []).append((offset, len(ids)))
    for doc, pieces in covered.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == lengths[doc]
    assert len(covered) == sum(n > 0 for n in lengths)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == capacity or at & (at - 1) == 0  # nothing is padded


def test_an_empty_document_has_no_piece():
    bins = packing.Bins(1024, 0)
    rows = [x for k, n in enumerate((513, 0, 511)) for x in bins.add(k, np.arange(n, dtype="<u4"))] + list(bins.close())
    assert [(doc, start, len(ids), sequence, offset) for doc, start, ids, _, sequence, offset in rows] == [(0, 0, 513, 0, 0), (2, 0, 511, 0, 513)]


def test_pieces_are_few():
    lengths = np.random.default_rng(4).integers(1, 1500, 5000)
    bins = packing.Bins(1024, 0)
    rows = [x for n in lengths for x in bins.add(0, np.zeros(n, "<u4"))] + list(bins.close())
    sequences = len({x[4] for x in rows})
    assert sequences <= lengths.sum() / 1024 + 12
    assert len(rows) <= len(lengths) + 2 * sequences


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(6)
    for n in (1, 5, 40, 300, 5000):
        for other in (n, n + n // 5, 3 * n):
            pool = rng.integers(0, 1 << 63, 2 * (n + other), dtype=np.uint64) * np.uint64(2)
            a, b = (np.unique(rng.choice(pool, k)) for k in (n, other))
            x, y = (similar.sketches(h, np.zeros(len(h), np.int64), np.array([len(h)]))[0] for h in (a, b))
            assert similar.apart(x, y) == similar.apart(y, x) <= len(np.setxor1d(a, b))
            assert similar.apart(x, x) == 0


def plain_objective(x, rows, k, grades, penalty):
    total = 0.0
    for own, g in zip(rows, grades):
        f = x[own].sum()
        edge = [-np.inf, *x[k:], np.inf]
        total -= np.log(1 / (1 + np.exp(f - edge[g + 1])) - 1 / (1 + np.exp(f - edge[g])))
    return total / len(grades) + penalty * np.abs(x[:k]).sum()


@pytest.mark.parametrize("seed, n_grades", [(1, 3), (2, 2), (3, 5)])
def test_ordinal_fit_is_the_least(seed, n_grades):
    """No point around the fit is lower, and plain steps from elsewhere end at the same value."""
    rng = np.random.default_rng(seed)
    k, penalty = 12, 0.01
    rows = [np.flatnonzero(rng.random(k) < 0.3) for _ in range(150)]
    truth = rng.normal(size=k) * (rng.random(k) < 0.6)
    grades = np.clip(np.round([truth[r].sum() + rng.logistic() + 1 for r in rows]), 0, n_grades - 1).astype(int)
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    weights, thresholds = quality.fit(np.concatenate(rows), at, k, grades, n_grades, penalty, tolerance=1e-12, grow=3)
    assert (np.diff(thresholds) > 0).all()
    best = np.concatenate([weights, thresholds])
    least = plain_objective(best, rows, k, grades, penalty)
    for _ in range(200):
        assert plain_objective(best + rng.normal(size=len(best)) * rng.choice([1e-3, 1e-2, 0.1]) * (np.arange(len(best)) == rng.integers(len(best))), rows, k, grades, penalty) > least - 1e-6
    x = np.concatenate([np.zeros(k), np.linspace(-1, 1, n_grades - 1) if n_grades > 2 else [0.0]])
    for _ in range(4000):  # proximal steps from elsewhere
        step = 0.4
        slope = _slopes(x, rows, k, grades)
        x = x - step * slope
        x[:k] = np.sign(x[:k]) * np.maximum(np.abs(x[:k]) - step * penalty, 0)
    assert abs(plain_objective(x, rows, k, grades, penalty) - least) < 2e-3


def _slopes(x, rows, k, grades):
    edge = np.concatenate([[-np.inf], x[k:], [np.inf]])
    f = np.array([x[r].sum() for r in rows])
    high, low = 1 / (1 + np.exp(f - edge[grades + 1])), 1 / (1 + np.exp(f - edge[grades]))
    out = np.zeros(len(x))
    for r, s in zip(rows, 1 - high - low):
        out[r] += s
    for g in range(len(x) - k):
        out[k + g] += (low * (1 - low) / (high - low))[grades == g + 1].sum() - (high * (1 - high) / (high - low))[grades == g].sum()
    return out / len(rows)


def test_features_see_whole_words():
    start = "x" * 100
    one, two = (set(quality.features(*bytescan.buffers(pa.array([t])))[0].tolist()) for t in (start + "a", start + "b"))
    assert len(one - two) == len(two - one) == 1
    kana, other = ("日本語の長い文章です" * 3 + x for x in ("甲乙", "丙丁"))
    one, two = (set(quality.features(*bytescan.buffers(pa.array([t])))[0].tolist()) for t in (kana, other))
    assert len(one - two) >= 3 and len(one & two) > 8


def test_exact_distances_at_any_size():
    rng = np.random.default_rng(8)
    for size in (1e-200, 1e-3, 8e6, 1e200):
        base = (rng.normal(size=(50, 6)) + 1) * size
        got = inverted_multi_index.exact(base, base[0])
        want = [math.dist(b, base[0]) for b in base]  # the standard library scales
        assert np.allclose(got, want, rtol=1e-13, atol=0)


@given(st.lists(st.binary(max_size=90), min_size=1, max_size=20))
@settings(max_examples=100, deadline=None)
def test_xxh64(parts):
    text = np.frombuffer(b"".join(parts), np.uint8)
    length = np.array([len(x) for x in parts])
    assert simhash.xxh64(text, np.cumsum(length) - length, length).tolist() == [xxhash.xxh64_intdigest(x, 42) for x in parts]


@given(texts)
@settings(max_examples=100, deadline=None)
def test_fingerprints(found):
    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW))
        parts = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    words = bytescan.Words(*bytescan.buffers(pa.array(found, pa.string())), bytescan.NON_BLANK)
    assert simhash.fingerprints_of(words, 3).tolist() == [plain(t) for t in found]


def test_fingerprint_of_a_long_text():
    words = [f"w{k % 977}" for k in range(150_000)]
    found = bytescan.Words(*bytescan.buffers(pa.array(["a b", " ".join(words), "c"])), bytescan.NON_BLANK)
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(len(words) - 2)]
    bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    assert int(simhash.fingerprints_of(found, 3)[1]) == sum(1 << b for b in range(64) if 2 * bits[b] > len(h))


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 64, 333, dtype=np.uint64)
    near = base.copy()
    for k in range(len(near)):
        for b in rng.choice(64, k % 6, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    distance = lambda a, b: np.bitwise_count(a ^ b)
    assert np.array_equal(simhash.near_pairs(base, near, radius), distance(base, near) <= radius)
    pairs = {(i, j) for x, y in simhash.near_block(near, base, radius) for i, j in zip(x.tolist(), y.tolist())}
    assert pairs == set(zip(*map(np.ndarray.tolist, np.nonzero(distance(near[:, None], base[None, :]) <= radius))))


@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=8), min_size=1, max_size=4), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_deciding_runs(docs, least):
    words = np.array([w for d in docs for w in d])
    first = np.cumsum([0] + [len(d) for d in docs])
    want = set()
    for a, b in zip(first[:-1], first[1:]):
        for i in range(a, b):
            forward = [e for e in range(i, b) if words[i : e + 1].sum() >= least]
            if forward:
                want.add((i, forward[0] - i + 1))
            backward = [s for s in range(a, i + 1) if words[s : i + 1].sum() >= least]
            if backward:
                want.add((backward[-1], i - backward[-1] + 1))
    assert set(zip(*(x.tolist() for x in deciding_runs(words, first, least)))) == want


def test_crc_is_of_little_endian_ids():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\1\0\0\0\2\0\0\0")
