"""The registered corpus queries and the pipeline on the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
for _p in (ROOT, os.path.join(ROOT, "tests")):
    if _p not in sys.path:
        sys.path.insert(0, _p)

import corpus_pipeline  # noqa: E402
from cadenza.llm import decontam, quality, queries, simhash  # noqa: E402
from cadenza.llm.common import table  # noqa: E402
from conftest import SF_SMALL  # noqa: E402
from oracle_check import digest, duck  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    df = queries.QUERIES[name](spark, SF_SMALL)
    res = duck(SF_SMALL).execute(queries.ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert digest(df.columns, df.collect()) == digest(cols, res.fetchall())


def test_pipeline_equals_its_stages(spark):
    docs = table(spark, SF_SMALL, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_level_bpe"]
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        before = stage
        stage = spark.createDataFrame(f(spark, before, SF_SMALL).collect(), docs.schema)
        assert stage.columns == docs.columns
    last = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.STAGES[-1][1](spark, stage, SF_SMALL).collect()}
    assert {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF_SMALL).collect()} == last


def test_stages_take_effect(spark):
    docs = table(spark, SF_SMALL, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    scored = {r.doc_id: r.predicted for r in quality.score(docs, quality.train(docs, table(spark, SF_SMALL, "labels"))).collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality_filter(spark, docs, SF_SMALL).collect()}
    assert kept == {i for i, p in scored.items() if p == 1} and 0 < len(kept) < len(rows)
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF_SMALL).collect()} == {i for i, c in near.items() if i == c}
    bad = {r.doc_id for r in decontam.leaks(docs, table(spark, SF_SMALL, "benchmark")).collect()}
    assert {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, SF_SMALL).collect()} == set(rows) - bad


def test_null_or_repeated_id_drops_no_clean_text(spark, monkeypatch):
    item = " ".join(f"v{i}" for i in range(20))
    docs = spark.createDataFrame([(None, item, 1), (None, "clean one", 2), (7, f"so {item}", 3), (7, "clean two", 4), (7, None, 5), (8, "clean one", 6)],
                                 "doc_id long, text string, n long")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.n for r in kept.collect()) == [2, 4, 5, 6]
    monkeypatch.setattr(quality, "train", lambda *a: 0.0)
    assert corpus_pipeline.quality_filter(spark, docs, SF_SMALL).count() == 0
    scored = quality.scored_rows
    monkeypatch.setattr(quality, "scored_rows", lambda *a: scored(*a).withColumn(
        "predicted", F.when(F.col("th").isin([r[0] for r in docs.filter("n in (1, 3)").select(F.xxhash64("text")).collect()]), 0).otherwise(1)))
    assert sorted(r.n for r in corpus_pipeline.quality_filter(spark, docs, SF_SMALL).collect()) == [2, 4, 5, 6]


def test_stages_on_empty_table(spark):
    stage = table(spark, SF_SMALL, "documents").limit(0)
    for _, f in corpus_pipeline.STAGES:
        stage = f(spark, stage, SF_SMALL)
        assert stage.count() == 0
