"""Corpus pipeline: language filter, exact and near deduplication, mixing, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and works on all rows that the stage before kept.  ``run`` applies them to
``documents``; between stages the rows are written to the shared folder and
read again, so a lost executor never repeats an earlier stage.

Texts may be null or empty at any stage: the language stage drops such rows,
as no language can be told, and documents without a main language; empty tables pass through as empty tables; further
columns, whatever their names, stay with their rows up to the last stage.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabforge.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from tabforge.llm.common import written


# Fixed value: the share of a document's main language from which on its language counts as told.
MAIN_SHARE = 0.65


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told: one language makes up ``MAIN_SHARE`` of them at least; learned
    from the labelled documents themselves."""
    return language_id.accepted(docs, language_id.fit(docs), min_score=MAIN_SHARE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, the one with the largest id."""
    return exact_dedup.keep_first(docs, written(exact_dedup.dedup(docs), "exact"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, 80 %), the one with the smallest id."""
    return near_dedup.keep_one(docs, written(near_dedup.near_duplicates(docs, size=5, percent=80), "near"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents so that sources reach their targets (150 % in all, at most two epochs) within a
    thousandth, where documents that fit the gap are left."""
    rows = written(mixing.sized(docs), "mix-rows")
    return mixing.apply_mix(docs, mixing.plan_mix(rows, mixing.cycle_weights(rows), within=0.001))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of the text they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(bpe.round_trip(docs, path, most=100_000))  # a worker stays small beside the heap of its executor


def _in_small_batches(stage):
    """Rows of this pipeline are long texts: some hundreds of them make a batch between Spark and Python, so that
    a task's buffers on both sides stay small beside its executor's heap."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "250")
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _in_small_batches(stage)) for name, stage in (
    ("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens))]

# Language inference, sketches and tokens have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's result over all of ``documents``: one row for each time the mix takes a document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
