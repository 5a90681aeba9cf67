"""Operators on small tables with odd rows, against brute-force versions."""

import gzip
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tidewheel.llm import chat, components, decontaminate, inverted_multi_index, license_notices, licenses, line_dedup, packing, quality, queries, simhash, token_archive, warc
from tidewheel.llm.shared import Scratch
from tidewheel.tables import NAMES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 5003}" for k in range(60_000))
RUN = "one two three four five six seven eight nine ten eleven"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and equal ids."""
    rows = [(1, RUN + "\nshort\n" + RUN.upper()), (2, "x y\n" + RUN + "\n\n"), (2, "x y\n" + RUN + "\n\n"), (3, None), (4, ""), (None, "no id " + RUN), (None, None), (5, LONG), (6, LONG + " end"), (7, "All rights reserved. CC-BY cc by"), (7, "other text of seven")]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.tokenizer_path())


def collected(frame):
    return [tuple(r) for r in frame.collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, small, name):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, small).toArrow(), con.sql(queries.ORACLE[name]).to_arrow_table()
    order = ours.column_names
    assert sorted(order) == sorted(theirs.column_names)
    tuples = lambda t: sorted(tuple(map(repr, r)) for r in zip(*(t.to_pydict()[c] for c in order)))
    assert tuples(ours) == tuples(theirs)


# 1 line dedup


def plain_dedup(rows, least):
    """rows: (id, text) without nulls, distinct. Every run with enough words that also starts earlier is deleted."""
    docs = [(i, xxhash_order(t), t.split("\n")) for i, t in rows]
    places = {}
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0], docs[k][1]))
    gone = {k: set() for k in range(len(docs))}
    for k in order:
        lines = docs[k][2]
        words = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        for i in range(len(lines)):
            for e in range(i + 1, len(lines) + 1):
                if sum(words[i:e]) >= least:
                    run = tuple(lines[i:e])
                    if run in places:
                        gone[k].update(range(i, e))
                    else:
                        places[run] = (k, i)
    return {(docs[k][0], rows[k][1]): sorted(v) for k, v in gone.items()}


def xxhash_order(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_line_dedup_against_all_runs(spark):
    rng = np.random.default_rng(3)
    pool = ["", "a", "b c", "d e f", "g h i j", "k l m n o p"]
    rows = [(int(k % 25), "\n".join(rng.choice(pool, rng.integers(0, 9))) + f"\n{k}" * int(k % 3 == 0)) for k in range(40)]
    rows = list(dict.fromkeys(rows))
    for least in (1, 5, 9):
        got = {(r.doc_id, r.removed_from): r.removed for r in line_dedup.dedup(documents(spark, rows).withColumn("removed_from", F.col("text")), min_words=least).collect()}
        assert got == plain_dedup(rows, least)


def test_line_dedup_of_odd_rows(spark, odd, empty):
    out = line_dedup.dedup(odd.withColumn("runs", F.lit(1)).withColumn("d", F.lit(2)), lines_col="n_lines")
    assert out.columns == [*odd.columns, "runs", "d", "removed", "n_lines"]
    rows = {}
    for r in out.collect():
        rows.setdefault((r.doc_id, r.n_lines), []).append(r)
    assert sum(map(len, rows.values())) == 11
    assert [r.text for r in rows[1, 3]] == [RUN + "\nshort\n" + RUN.upper()]  # line ids are of the bytes as they are
    assert [r.text for r in rows[2, 4]] == ["x y\n\n"] * 2  # both of two equal rows lose it
    assert rows[3, 0][0].text is None and rows[3, 0][0].removed == []
    assert rows[4, 1][0].text == ""
    assert collected(line_dedup.dedup(empty)) == []
    with pytest.raises(ValueError):
        line_dedup.dedup(odd, min_words=0)


def test_line_dedup_joins_texts_alike_at_any_size(spark, odd):
    plan = line_dedup.dedup(odd)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


# 2 SimHash


def plain_components(prints, radius=2):
    ids = list(range(len(prints)))
    label = ids[:]
    changed = True
    while changed:
        changed = False
        for a in ids:
            best = min(label[b] for b in ids if bin(prints[a] ^ prints[b]).count("1") <= radius)
            if best < label[a]:
                label[a] = best
                changed = True
    return label


def test_simhash_against_all_pairs(spark, small):
    rows = queries.op2_simhash(spark, small).orderBy("doc_id").collect()
    label = plain_components([int(r.fingerprint, 16) for r in rows])
    assert [r.component_id for r in rows] == [rows[k].doc_id for k in label]


def test_links_across_blocks(spark):
    """Near fingerprints of one hot key, in blocks of four, are still one component."""
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    chain = [base]
    for _ in range(60):  # each within two bits of the one before
        chain.append(chain[-1] ^ (1 << int(rng.integers(0, 24))) ^ (1 << int(rng.integers(0, 24))))
    far = [int(x) for x in rng.integers(0, 1 << 62, 100)]
    prints = sorted(set(chain + far))
    scratch = Scratch(spark, "test")
    frame = scratch.keep(spark.createDataFrame([(x,) for x in prints], "fp long"), "fp")
    found = {r.node: r.component for r in components.components(simhash.links(frame, scratch, 2, block=4), scratch).collect()}
    label = plain_components(prints)
    for k, x in enumerate(prints):
        assert found.get(x, x) == prints[label[k]]


def test_simhash_of_odd_rows(spark, odd, empty):
    rows = simhash.near_duplicates(odd.withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))).collect()
    assert len(rows) == 11
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    zero = "0" * 16
    assert by[3, zero] == by[4, zero] == by[None, zero] == 3
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert collected(simhash.near_duplicates(empty)) == []
    kept = simhash.keep_one(odd.withColumn("row", F.lit(1)).withColumn("t", F.lit(2)))
    assert kept.columns == [*odd.columns, "row", "t"]
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 2, 3, 5, 7, 7, None]
    assert collected(simhash.keep_one(empty)) == []


# 3 token archive, 9 packing


def ids_of(tokenizer, text, end):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_token_archive_of_odd_rows(spark, odd, empty, tokenizer):
    path = Scratch(spark, "test").path("archive")
    token_archive.write_archive(odd.withColumn("id", F.lit("clash")), path, queries.tokenizer_path(), block_ids=1000)
    read = sorted(token_archive.read_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in read] == [None, None, 1, 2, 2, 3, 4, 5, 6, 7, 7]
    upto = 0
    for r in read:
        assert r.start == upto
        upto += r.n_tokens
    want = sorted(zlib.crc32(ids_of(tokenizer, r.text, 2).tobytes()) for r in odd.collect())
    assert sorted(r.ids_crc32 for r in read) == want
    whole = token_archive.read_archive(spark, path).collect()
    assert sorted(zlib.crc32(r.ids) for r in whole) == want
    block = spark.read.parquet(path).where("n_ids > 60000").first()
    grammar = token_archive.Grammar(block.terminals, block.rules, block.expansion, block.stream)
    assert np.array_equal(grammar.read(500, 900), grammar.all()[500:900])
    assert collected(token_archive.round_trip(empty, queries.tokenizer_path())) == []


def test_a_hot_id_is_split(spark):
    rows = [(7, f"text {k} of a hot id") for k in range(300)] + [(k, "x") for k in range(100)]
    path = Scratch(spark, "test").path("archive")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_archive.write_archive(documents(spark, rows), path, queries.tokenizer_path())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(path).where("array_contains(doc_ids, 7)").select("part").distinct().count() > 1
    ids = [r.doc_id for r in token_archive.read_digests(spark, path).orderBy("start").collect()]
    assert ids == sorted(ids) and len(ids) == 400


def test_token_archive_query(spark, small, tokenizer):
    docs = pq.read_table(f"{small}/documents.parquet").to_pandas().sort_values("doc_id")
    got = queries.op3_token_archive(spark, small).toPandas().sort_values("doc_id")
    ids = [ids_of(tokenizer, t, 2) for t in docs.text]
    n = np.array([len(x) for x in ids])
    assert got.n_tokens.tolist() == n.tolist() and got.start.tolist() == (np.cumsum(n) - n).tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(x.tobytes()) for x in ids]


@pytest.mark.parametrize("which", ["odd", "table"])
def test_packing(spark, small, odd, tokenizer, which):
    frame = odd if which == "odd" else spark.read.parquet(f"{small}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in frame.collect()]
    rows = packing.pack(frame, queries.tokenizer_path(), with_ids=True).toPandas()
    assert all(zlib.crc32(x) == c and len(x) == 4 * n for x, c, n in zip(rows.ids, rows.ids_crc32, rows.length))
    total = rows.groupby("sequence_id").length.sum()
    assert total.max() <= 1024 and all(t == 1024 or t & (t - 1) == 0 for t in total)
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert rows.length.sum() == sum(len(ids_of(tokenizer, t, 0)) for _, t in texts)
    if which == "table":
        for doc, text in texts:
            own = rows[rows.doc_id == doc].sort_values("start")
            assert b"".join(own.ids) == ids_of(tokenizer, text, 0).tobytes()
            assert (own.length.cumsum() - own.length == own.start).all() and (own.doc_tokens == own.length.sum()).all()
    else:
        assert rows.doc_id.isna().sum() > 0


def test_packing_of_nothing(empty):
    assert collected(packing.pack(empty, queries.tokenizer_path())) == []
    with pytest.raises(ValueError):
        packing.pack(empty, queries.tokenizer_path(), capacity=1000)


# 4 licenses


def plain_license(text, threshold, short):
    """(first word of the block, template, containment) of all blocks and templates."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    found = []
    for k, (label, t) in enumerate(license_notices.NOTICES):
        sequence = re.findall("[a-z0-9]+", t.lower())
        own, step = set(sequence), 16
        while step < len(sequence):
            step *= 2
        for i in range(0, len(words), step):
            block = words[i : i + 2 * step]
            common = len(own & set(block))
            if len(own) < short:
                ok = f" {' '.join(sequence)} " in f" {' '.join(block)} "
            else:
                ok = common >= math.ceil(threshold * len(own) - 1e-9) and set(license_notices.NEEDED.get(label, [])) <= set(block) and not set(license_notices.FOREIGN.get(label, [])) & set(block)
            if ok:
                found.append((i, k, common / len(own)))
    return sorted(found)


@pytest.mark.parametrize("threshold, short", [(0.8, 12), (0.5, 1), (0.3, 8), (1.0, 30)])
def test_license_join_against_all_pairs(spark, odd, threshold, short):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(90):
        text = licenses.words_of(license_notices.NOTICES[k % len(license_notices.NOTICES)][1])
        share = rng.choice([0.6, 0.85, 1.0, 1.0])
        keep = [w for w in text if rng.random() < share]
        cut = int(rng.integers(0, len(keep) + 1))
        rows.append((100 + k, " ".join(["Intro"] * int(rng.integers(1, 60)) + keep[:cut]) + "\n" * int(rng.integers(1, 4)) + " ".join([*keep[cut:], "the", "end"])))
    frame = documents(spark, rows).unionByName(odd)
    got = licenses.scan(frame.withColumn("labels", F.lit(1)).withColumn("n_words", F.lit(2)), threshold=threshold, short=short).toPandas()
    assert len(got) == 101
    texts, hits = dict(rows), 0
    for r in got[got.doc_id >= 100].itertuples():
        found = sorted((m["word"], m["template"], m["containment"]) for m in r.matches)
        assert found == plain_license(texts[r.doc_id], threshold, short)
        hits += len(found)
    assert hits > 30
    base = got[(got.doc_id == 7) & (got.n_base > 0)].iloc[0]
    assert (base.n_base, base.first_word, base.last_word, base.base_labels, base.score) == (3, 0, 5, "cc-by,reserved", 1.0)
    assert got[got.doc_id == 3].n_words.tolist() == [0]


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under CC BY 4.0.", "cc-by"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        ("Licensed under CC BY-NC-SA 4.0.", "cc-by,cc-by-nc-sa"),
        ("Released under the Apache License", "apache-2.0"),
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("The license was released under pressure; the mit students left.", ""),
        ("Released under the MIT License.", "mit"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        ("by the same authors, under a license of the general public", ""),
        ("Permission is granted to use the software for any purpose", ""),
    ],
)
def test_license_labels(spark, text, labels):
    assert licenses.scan(documents(spark, [(1, "Some words.\n" + text + "\nMore.")])).first().labels == labels


def test_like_license_texts_are_told_apart(spark):
    notices = [(k, label, text) for k, (label, text) in enumerate(license_notices.NOTICES) if len(text) > 100]
    wrapped = [(k, "\n\n".join(" ".join(text.split()[i : i + 5]) for i in range(0, len(text.split()), 5))) for k, _, text in notices]
    got = {r.doc_id: set(r.labels.split(",")) - {"gpl"} for r in licenses.scan(documents(spark, wrapped)).collect()}
    assert got == {k: {label} - {"gpl"} for k, label, _ in notices}  # the base phrase marks lgpl and agpl texts as gpl, too


def test_license_scan_of_nothing(empty):
    assert collected(licenses.scan(empty)) == []


# 5 neighbours


def test_neighbours(spark, small):
    got = queries.op5_multi_index(spark, small).toPandas()
    t = pq.read_table(f"{small}/embeddings.parquet")
    x, ids = np.stack(t.column("embedding").to_numpy()).astype(float), t.column("vec_id").to_numpy()
    right = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [ids[i] for i in np.lexsort((ids, d)) if i != q][:10]
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(own) + 1)) and own.score.is_monotonic_increasing
        right, total = right + len(set(best) & set(own.vec_id)), total + len(best)
    assert right >= 0.9 * total


def test_neighbours_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(2)
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(30)] + [(k, rng.normal(size=3).tolist()) for k in range(30, 200)]
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 2.0]), (203, [nan, 1.0, 1.0]), (204, [inf, 1.0, 1.0]), (205, [1.0, 2.0]), (None, [1.0, 2.0, 3.0]), (0, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("cell", F.lit(2))
    asked = frame.where("vec_id in (0, 7, 35, 200, 201, 202, 203, 204, 205) or vec_id is null")
    got = inverted_multi_index.search(frame, asked, candidates=10_000, bucket_entries=16).toPandas()
    assert sorted(got.query_id.unique()) == [0, 7, 35]
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows[:200]}
    for q in (0, 7, 35):
        near = sorted((np.sqrt(((good[i] - good[q]) ** 2).sum()), i) for i in good if i != q)[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own.vec_id.tolist() == [i for _, i in near] and np.allclose(own.score, [d for d, _ in near], rtol=0, atol=1e-12)
    nothing = frame.where("false")
    assert collected(inverted_multi_index.search(nothing, nothing)) == []
    two = frame.where("vec_id in (0, 40)")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in inverted_multi_index.search(two, two).collect()) == [(0, 1, 40), (40, 1, 0)]


@pytest.mark.parametrize("centre, spread", [(8e6, 1e-2), (1e200, 1e199), (0.0, 1e-150)])
def test_neighbours_at_any_size(spark, centre, spread):
    rng = np.random.default_rng(9)
    x = centre + rng.normal(size=(120, 5)) * spread
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = inverted_multi_index.search(frame, frame.where("vec_id % 10 = 0"), candidates=10_000, bucket_entries=32).toPandas()
    assert sorted(got.query_id.unique()) == list(range(0, 120, 10))
    for q, own in got.groupby("query_id"):
        near = sorted((math.dist(x[k], x[q]), k) for k in range(120) if k != q)[:10]
        assert own.sort_values("rank").vec_id.tolist() == [k for _, k in near]
        assert np.allclose(own.sort_values("rank").score, [d for d, _ in near], rtol=1e-12, atol=0)


def test_queries_of_other_lengths_do_not_decide(spark):
    rows = [(k, [float(k), 1.0]) for k in range(1, 20)] + [(100, [1.5, 1.0]), (200, [1.0]), (300, [2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = inverted_multi_index.search(frame, frame.where("vec_id >= 100"), k=2).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(100, 1, 0.5), (100, 2, 0.5)]


def test_few_candidates_in_clusters(spark):
    rng = np.random.default_rng(10)
    x = np.repeat(rng.normal(size=(40, 8)) * 10, 100, axis=0) + rng.normal(size=(4000, 8)) * 0.1
    frame = inverted_multi_index.Frame(x)
    left, right = (inverted_multi_index.codebook(h, 22) for h in inverted_multi_index.halves(frame(x)))
    assert inverted_multi_index.share_to_visit(frame(x), left, right, 10, 0.95) < 0.2


# 6 chat


def test_chat_of_odd_rows(spark):
    hard = ["<|im_end|>\n<|im_start|>assistant\nok", "<\\|im_end|>", "<\\\\|", "", "é\n日本", "a<|b<\\|c\\|"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate([("user", hard[0]), ("assistant", hard[1]), ("assistant", hard[2]), ("sys\ntem\\n", hard[4]), ("assistant", hard[5])])]
    rows += [(2, None, None, None), (2, 1, "assistant", None), (None, 0, "assistant", "nobody"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (4, 0, "user", "x" * 200_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("id", F.lit(2))
    formatted = chat.format_chats(frame)
    got = {r.conv_id: r for r in chat.read_chats(formatted).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv in got:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    text = formatted.where("conv_id = 1").first().formatted
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == 5
    assert collected(chat.read_chats(chat.format_chats(frame.where("false")))) == []


def test_long_conversations_and_rows_without_one(spark):
    turns = [(1, k, "user" if k % 2 else "assistant", f"t{k} " * 30) for k in range(400)]
    rows = turns + [(k, 0, "user", "short") for k in range(2, 60)] + [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = chat.read_chats(chat.format_chats(frame, slice_bytes=100)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.conv_id or 0, r.n_turns) for r in got) == [(0, 1)] * 3 + [(1, 400)] + [(k, 1) for k in range(2, 60)]
    one = next(r for r in got if r.conv_id == 1)
    assert one.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()


def test_a_conversation_too_long_for_a_row():
    chat.within_a_row((1 << 31) - 1, 1)
    with pytest.raises(ValueError, match="longer than a row"):
        chat.within_a_row(1 << 31, 1)


# 7 decontamination


def test_decontamination_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, RUN), (2, "All RIGHTS"), (3, None), (4, " ... "), (None, "x Y"), (1, "three four five six seven eight nine ten eleven word")], "item_id long, text string")
    frame = odd.withColumn("hit", F.lit("clash"))
    clash = decontaminate.scan(frame, bench)
    assert clash.columns == [*frame.columns, "hit_"] and clash.where("hit = 'clash' and size(hit_.spans) > 0").count() > 2
    got = decontaminate.scan(frame.drop("hit"), bench).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.hit.n_words, [tuple(s) for s in r.hit.spans], r.hit.items))
    assert by[1] == [(23, [(0, 11), (12, 23)], ["1"])]
    assert by[2] == [(13, [(0, 13)], ["", "1"])] * 2
    assert by[3] == [(0, [], [])] and (6, [(0, 2)], ["2"]) in [(n, s, i) for n, s, i in by[7]] or by[7]
    blocks = decontaminate.scan(odd, bench.union(bench), broadcast_bytes=40).collect()
    assert sorted(map(repr, ((r.doc_id, r.hit) for r in blocks))) == sorted(map(repr, ((r.doc_id, r.hit) for r in got)))
    kept = decontaminate.drop_documents(frame, bench)
    assert kept.columns == frame.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, 4, None, 5, 6, 7], key=repr)
    cut = {(r.doc_id, r.n_chars): r.text for r in decontaminate.cut_spans(frame, bench).collect()}
    assert len(cut) == 10 and cut[1, 2 * len(RUN) + 7] == "short\n" and cut[3, None] is None and cut[5, len(LONG)] == LONG
    assert collected(decontaminate.drop_documents(empty, bench)) == []
    assert decontaminate.drop_documents(odd, bench.where("false")).count() == 11


# 8 WARC


def test_warc_of_odd_rows(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, "same"), (3, "http://c", "same"), (4, "u\r\nEvil: 1", "line\r\n\r\nWARC/1.1\r\n\r\n"), (5, "e", None), (6, "f", ""), (None, "g", "same"), (7, "é", "日本" * 50_000), (1, "http://a", "same")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("page", F.lit(2))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(frame).collect()), key=repr)
    size = len(rows[4][2])
    want = [(1, 4, "revisit", 3), (1, 4, "revisit", 3), (2, 4, "revisit", 3), (3, 4, "response", None), (3, 4, "response", None), (4, size, "response", None), (5, 0, "revisit", 6), (6, 0, "response", None), (7, 300_000, "response", None), (None, 4, "revisit", 3)]
    assert got == sorted(want, key=repr)
    assert {r.record_type for r in warc.round_trip(frame, min_bytes=5).collect()} == {"response"}
    assert collected(warc.round_trip(frame.where("false"))) == []
    import base64

    digests = {r.page_id: r.payload_digest for r in warc.round_trip(frame).collect()}
    assert digests[2] == base64.b32encode(hashlib.sha1(b"same").digest()).decode()


def test_warc_files(spark, tmp_path):
    rows = [(k, f"u{k}", f"page {k % 40} " * 200) for k in range(100)] + [(100, "big", "".join(map(chr, np.random.default_rng(3).integers(97, 123, 20_000_000))))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = str(tmp_path / "archive")
    warc.write_archive(frame, path, file_bytes=20_000)
    files = [p.read_bytes() for p in (tmp_path / "archive").glob("part-*")]
    assert len(files) > 2 and sorted(map(len, files))[-2] < 21_000
    types = []
    for content in files:
        assert gzip.decompress(content).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        first = zlib.decompressobj(31)
        assert first.decompress(content).count(b"WARC/1.1") == 1 and first.eof  # the first member is the first record
        found = [(h["WARC-Type"], h["WARC-Record-ID"]) for h, _ in warc.records(content)]
        assert found[0][0] == "warcinfo"
        types += found
    assert len({x for _, x in types}) == len(types)
    assert sum(t == "response" for t, _ in types) == 41 and sum(t == "revisit" for t, _ in types) == 60
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records(files[0][:-30]))


def test_a_revisit_without_its_response_is_an_error(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a", "same"), (2, "b", "same")], "page_id long, url string, html string")
    scratch = Scratch(spark, "test")
    warc.write_archive(frame.coalesce(1), str(tmp_path / "a"), file_bytes=1)
    lone = tmp_path / "lone"
    lone.mkdir()
    for p in (tmp_path / "a").glob("part-*"):
        if b"revisit" in gzip.decompress(p.read_bytes()):
            (lone / p.name).write_bytes(p.read_bytes())
    with pytest.raises(Exception, match="no response for the revisit"):
        warc.read_pages(spark, str(lone), scratch).collect()


def test_warc_many_revisits(spark):
    rows = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("p"), (F.col("id") % 7).cast("string")).alias("html"))
    got = warc.round_trip(rows).toPandas()
    assert len(got) == 400 and (got.record_type == "response").sum() == 7
    for r in got[got.record_type == "revisit"].itertuples():
        assert r.refers_to % 7 == r.page_id % 7 and r.refers_to >= 393


# 10 classifier


def test_quality_on_held_out_ratings(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    grades = quality.grades_of(labels)
    model = quality.train(docs, grades.where("doc_id % 4 <> 0"), 3)
    assert (np.diff(model.thresholds) > 0).all()
    held = quality.score(docs.join(grades.where("doc_id % 4 = 0"), "doc_id"), model, keep=["doc_id", "grade"]).toPandas()
    keep = held["tail"] >= 0.5
    assert keep[held.grade == 2].mean() > 0.98
    assert keep[held.grade == 0].mean() < 0.1
    assert keep[held.grade == 1].mean() < 0.2
    assert held.expected_grade.between(0, 2).all()


def test_quality_of_odd_rows(spark, odd, empty):
    ratings = spark.createDataFrame([(1, 2), (2, 0), (None, 1), (99, 1), (5, None), (1, 2)], "doc_id long, grade int")
    model = quality.train(odd, ratings, 3, min_docs=1)
    out = quality.score(odd.withColumn("grade", F.lit(1)).withColumn("id", F.lit(2)), model)
    assert out.columns == [*odd.columns, "grade", "id", "expected_grade", "tail"] and out.count() == 11
    assert out.where("tail is null or tail < 0 or tail > 1").count() == 0
    blank = quality.train(odd, ratings.where("false"), 3)
    assert quality.score(odd, blank, at_least=0.5).count() == 11
    assert collected(quality.score(empty, model)) == []
    assert quality.train(empty, ratings, 3).keys.size == 0


def test_the_sample_is_bounded(spark, small):
    docs, grades = spark.read.parquet(f"{small}/documents.parquet"), quality.grades_of(spark.read.parquet(f"{small}/labels.parquet"))
    a, b = (quality.train(frame, grades, 3, max_fit=20) for frame in (docs, docs.union(docs)))  # repeated rows change nothing
    assert np.array_equal(a.keys, b.keys) and np.array_equal(a.weights, b.weights)


def test_a_very_long_rated_text_changes_little(spark):
    """Its own words have no weight, as no other document has them, and nothing else is left out."""
    rows = [(k, f"good text number {k} fine words here") for k in range(20)] + [(100 + k, f"bad spam {k} buy now cheap") for k in range(20)]
    ratings = spark.createDataFrame([(i, 2 if i < 100 else 1) for i, _ in rows] + [(7777, 2)], "doc_id long, grade int")
    short = quality.train(documents(spark, rows + [(7777, "good text fine words here")]), ratings, 3)
    long = quality.train(documents(spark, rows + [(7777, "good text fine words here " + " ".join(f"u{k}" for k in range(300_000)))]), ratings, 3)
    assert {f"{k}": round(w, 1) for k, w in zip(short.keys, short.weights)}.keys() & {f"{k}" for k in long.keys}
    assert np.abs(long.weights).max() < 3 * np.abs(short.weights).max() and len(long.keys) < 60


# pipeline


def test_pipeline_stage_by_stage(spark, small):
    folder = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scratch = Scratch(spark, "test-pipeline")
    before = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch.keep(stage(spark, docs, folder), name.replace(" ", "-"))
        assert out.schema == docs.schema
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        assert len(set(ids)) == len(ids) and set(ids) <= set(before)
        if name == "line dedup":
            gone = plain_dedup([(i, t) for i, t in before.items()], line_dedup.MIN_WORDS)
            for r in rows:
                lines = before[r.doc_id].split("\n")
                cut = set(gone[r.doc_id, before[r.doc_id]])
                assert r.text == "\n".join(x for k, x in enumerate(lines) if k not in cut) and r.n_chars == len(r.text)
            emptied = {i for (i, t), g in gone.items() if g and len(g) == len(t.split("\n"))}
            assert set(before) - set(ids) == emptied
        else:
            assert all(r.text == before[r.doc_id] for r in rows)
        if name == "simhash near-dedup":
            order = sorted(before)
            prints = [int(r.fingerprint, 16) for r in simhash.near_duplicates(docs).orderBy("doc_id").collect()]
            assert set(ids) == {order[k] for k in set(plain_components(prints))}
        if name == "benchmark decontamination":
            hit = {r.doc_id for r in decontaminate.scan(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).where("size(hit.spans) > 0").collect()}
            assert set(ids) == set(before) - hit
        docs, before = out, {r.doc_id: r.text for r in rows}
    packed = stages["packing"](spark, docs, folder)
    assert set(packed.select("doc_id").distinct().toPandas().doc_id) == set(before)


def test_pipeline_stages_take_odd_rows(spark, small, odd, empty):
    for frame in (odd.withColumn("removed", F.lit(1)).withColumn("n_lines", F.lit(2)).withColumn("hit", F.lit(3)), empty):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            out = Scratch(spark, "odd-pipeline").keep(stage(spark, docs, small), name.replace(" ", "-"))
            if name != "packing":
                assert out.columns == frame.columns
                docs = out
        assert (out.count() > 0) == (frame is not empty)


def test_entry_has_all_of_them(spark, small):
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert corpus_pipeline.ORACLE_SQL is None
