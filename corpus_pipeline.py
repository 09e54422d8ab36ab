"""From raw documents to tokens: what a classifier rejects goes, then lines that many documents share, near copies, and
documents with benchmark passages; what is left is encoded.

Each stage takes (spark, docs, sf_dir) with all that its predecessor kept; its result is to be written as Parquet and read
again before the next begins, which deletes the tables that the last one worked with.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aquila.llm.bpe import round_trip
from aquila.llm.decontamination import keep_clean
from aquila.llm.jaccard_join import keep_one
from aquila.llm.line_dedup import dedup_lines
from aquila.llm.quality_classifier import keep_good
from aquila.llm.tables import close, load, opened, ship, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Not expressible in SQL; tests/llm/test_pipeline.py holds it against brute force.
ORACLE_SQL = None
_left: list[tuple[SparkSession, str]] = []


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        close(_left)
        _left.clear()
        ship(spark)
        before = opened()
        out = f(spark, docs, sf_dir)
        _left.extend(t for t in opened() if t not in before)
        return out

    return run_stage


@_stage
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, load(spark, sf_dir, "labels"))


@_stage
def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs, keep=("lang", "source")).select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, load(spark, sf_dir, "benchmark"))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip(docs)


STAGES: list[tuple[str, Stage]] = [("quality_classifier", classify), ("line_dedup", dedup), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontaminate), ("byte_level_bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
