"""Corpus pipeline: documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage
before kept; every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import decontaminate, line_dedup, packing, quality, similar
from tidewheel.llm.queries import tokenizer_path
from tidewheel.llm.shared import Scratch, table
from tidewheel.session import with_package

GOOD = 0.5


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose probability of the best grade is at least one half."""
    model = quality.train(docs, quality.grades_of(table(spark, sf_dir, "labels")), 3)
    return quality.score(docs, model, at_least=GOOD)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated line runs; a document of which nothing is left goes, n_chars follows the text."""
    removed, before = _unused(docs, "removed"), _unused(docs, "n_lines")
    kept = line_dedup.dedup(docs, removed_col=removed, lines_col=before)
    some = kept.where((F.size(removed) == 0) | (F.size(removed) < F.col(before)))
    changed = F.when(F.size(removed) == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return some.withColumn("n_chars", changed).drop(removed, before) if "n_chars" in docs.columns else some.drop(removed, before)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: five-word shingles, Jaccard similarity of 0.8 or more."""
    return similar.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that share a window of words with a benchmark item."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", with_package(quality_classifier)),
    ("line dedup", with_package(line_deduplication)),
    ("simhash near-dedup", with_package(simhash_near_dedup)),
    ("benchmark decontamination", with_package(benchmark_decontamination)),
    ("packing", with_package(harmonic_packing)),
]

#: A classifier, 64-bit hashes and a tokenizer are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
