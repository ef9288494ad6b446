"""Inputs that several steps read are made once; text sinks are compressed."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from cadenza.functions import constants as C
from cadenza.operators import cluster as CL
from cadenza.operators import graph as G
from cadenza.session import scratch_path
from cadenza.sources import schema


def test_label_propagation_makes_its_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            made.add(len(f))
            yield f

    rows = [(f"v{i}", f"v{(i * 7 + 1) % 20}", 1) for i in range(20)]
    edges = spark.createDataFrame(rows, "src string, dst string, weight long").mapInPandas(count, "src string, dst string, weight long")
    assert G.label_propagation(edges).count() == 20
    assert made.value == len(rows)


@pytest.mark.parametrize("fmt", ["json", "csv"])
def test_text_sinks_are_compressed(spark, events_small, fmt):
    path = scratch_path(spark, fmt)
    schema.write_table(schema.to_export(events_small), path, fmt)
    local = path.removeprefix("file:")
    assert glob.glob(f"{local}/part-*.{fmt}.gz") and not glob.glob(f"{local}/part-*.{fmt}")
    cols = [c for c in schema.PLAY_COLUMNS if c not in ("play_id", "album")]  # csv has one spelling for empty and null albums
    back = schema.read_plays(spark, path, fmt=fmt, multiline=False)
    assert sorted(back.select(*cols).collect(), key=str) == sorted(events_small.select(*cols).collect(), key=str)


def test_flags_mean_what_they_meant(spark):
    means = {"true": True, " TRUE ": True, "t": True, "yes": True, "1": True, "1.0": True, "2": True, "-3e1": True, "NaN": True,
             "false": False, "no": False, "0": False, "0.0": False, "-0": False, "": False, "oops": False, None: False}
    df = spark.createDataFrame([(k,) for k in means], "skipped string")
    got = {r[0]: r[1] for r in df.select("skipped", schema._flag_expr(df, "skipped")).collect()}
    assert got == means


def test_vectors_are_spread_over_the_cores(spark):
    wide = spark.range(4000).coalesce(1).select(F.col("id").alias("user_id"), *[
        (F.xxhash64("id", F.lit(i)) % 1000).cast("double").alias(m) for i, m in enumerate(C.METRIC_KEYS)])
    _, n, _, scaled = CL.prepare_vectors(wide)
    parts = scaled.rdd.getNumPartitions()
    scaled.unpersist()
    assert n == 4000 and parts == min(4, spark.sparkContext.defaultParallelism - 1) + 1
