"""The corpus pipeline: five stages of the llm operators, each on all that the one before kept, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from lexiloom.llm.queries import TOKENIZER
from lexiloom.plans.storage import load, materialize, prepare


LEAST_WORDS = 6
"""Benchmark items of fewer words delete no document, as ordinary text holds them too."""


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated rules reject go."""
    prepare(spark)
    return quality_rules.drop_rejected(docs, load(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated blocks of lines go from the later document, and documents of which nothing is left."""
    prepare(spark)
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group stays."""
    prepare(spark)
    return near_dedup.drop_near_duplicates(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark phrase, or its terms close together, go; items of fewer than LEAST_WORDS words don't count."""
    prepare(spark)
    return decontaminate.drop_leaks(docs, load(spark, sf_dir, "benchmark"), least_words=LEAST_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of documents for training: bin, slot, doc_id, digest, piece, start, tokens, loss_tokens."""
    prepare(spark)
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", leaks), ("packing", pack)]

ORACLE_SQL = None
"""No SQL: fast similarity sketching, patience diff and the packing heuristic are outside it; tests hold the stages against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, with a written table after each."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
