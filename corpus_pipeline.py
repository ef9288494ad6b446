"""Corpus pipeline: each stage works on what the stage before kept, written as
Parquet in the shared checkpoint folder and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import bpe, decontam, lines, quality, simhash
from cadenza.llm.common import table, without_rows, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier accepts (score of 0.3 or more)."""
    scored = quality.scored_rows(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return without_rows(docs, scored.filter(F.col("predicted") == 0).select("doc_id", "th"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines under later three-line windows;
    n_chars counts the text that is left."""
    return lines.line_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near-duplicates."""
    return simhash.near_dedup(docs, shingle=4, max_bits=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text no benchmark item leaks into."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes
    they decode to.  The workers have run other stages before, beside a heap
    that has grown: memo, slices and batches are smaller than bpe's own."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                      words_kept=60_000, slice_bytes=1 << 20, batch_bytes=4 << 20)


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("byte_level_bpe", encode),
]

#: A fitted classifier can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
