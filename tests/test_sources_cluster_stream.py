"""Sources / sinks, clustering and the streaming session operator."""

from __future__ import annotations

import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from cadenza.functions import constants as C
from cadenza.operators import cluster as CL
from cadenza.operators import sequence as S
from cadenza.session import scratch_path
from cadenza.sources import fixtures, pool, schema, synth
from cadenza.sources.synth import synthetic_plays


def _local(path: str) -> str:
    return path[5:] if path.startswith("file:") else path


def test_json_array_export_multiline(spark):
    """A pretty-printed JSON array per file (the export format)."""
    d = _local(scratch_path(spark, "export"))
    os.makedirs(d, exist_ok=True)
    recs = [{"ts": "2024-03-01T10:00:00Z", "ms_played": 1000, "master_metadata_track_name": "x",
             "master_metadata_album_artist_name": "y", "skipped": None, "platform": "ios"},
            {"ts": "bad", "ms_played": 5, "master_metadata_track_name": "z"},
            {"ts": "2024-03-01T11:00:00Z", "master_metadata_track_name": "w"}]
    with open(os.path.join(d, "part1.json"), "w") as fh:
        json.dump(recs, fh, indent=2)
    with open(os.path.join(d, "part2.json"), "w") as fh:
        json.dump(recs[:1], fh, indent=2)
    df = schema.read_plays(spark, d, fmt="json", multiline=True)
    rows = df.orderBy("ts").collect()
    assert len(rows) == 3
    assert rows[-1].ms_played == 0 and rows[-1].artist == "Unknown" and rows[0].skipped is False


def test_partitioned_parquet_prunes(spark, events_small):
    path = scratch_path(spark, "plays")
    schema.write_plays(fixtures.plays(spark, SF_SMALL, "plays_lineitem"), path)
    df = schema.read_plays_table(spark, path, years=[1996])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "isnotnull(year" in plan or "year" in plan
    assert df.select("year").distinct().collect()[0].year == 1996


def test_csv_and_json_sinks_roundtrip(spark, events_small):
    for fmt in ("csv", "json"):
        p = scratch_path(spark, fmt)
        schema.write_table(schema.to_export(events_small), p, fmt)
        back = schema.read_plays(spark, p, fmt=fmt, multiline=False)
        assert back.count() == events_small.count()


def test_pool_append_and_read(spark, events_small):
    from cadenza.operators import metrics as M

    vec = M.user_vector(M.user_profile(events_small))
    p = scratch_path(spark, "pool")
    pool.append_pool(vec, p)
    pool.append_pool(vec.limit(3), p)
    back = pool.read_pool(spark, p)
    assert back.count() == vec.count() + 3
    assert back.columns[:2] == ["id", "created_at"] and back.columns[2:] == C.METRIC_KEYS


@pytest.mark.parametrize(("alpha", "n"), [(1.15, 2), (1.15, 50), (1.15, 20_000), (1.05, 30_000)])
def test_zipf_index_inverts_the_distribution(spark, alpha, n):
    weights = np.arange(1, n, dtype=float) ** -alpha
    bounds = np.cumsum(weights) / synth.zipf_total(alpha)
    us = np.linspace(0, 1, 3_001)[:-1]
    us = np.concatenate([us, bounds[:50] * (1 - 1e-7), bounds[:50] * (1 + 1e-7), bounds[-50:] * (1 - 1e-9), [1 - 2.0 ** -52]])
    want = np.searchsorted(bounds, us, side="right")
    rows = spark.createDataFrame([(i, float(u)) for i, u in enumerate(us)], "i int, u double").select(
        "i", synth._zipf_index(F.col("u"), alpha, n).alias("k")).orderBy("i").collect()
    assert [r.k for r in rows] == want.tolist()


def test_synthetic_plays_deterministic_and_skewed(spark):
    a = synthetic_plays(spark.range(20_000), n_rows=20_000)
    b = synthetic_plays(spark.range(20_000).repartition(7), n_rows=20_000)
    assert a.exceptAll(b).count() == 0
    plays = schema.clean_plays(schema.from_export(a))
    assert plays.count() == 20_000
    top = plays.groupBy("artist").count().orderBy(F.desc("count")).first()
    assert top["count"] > 20_000 / 50  # popularity is skewed
    skip = plays.agg(F.avg(F.col("skipped").cast("double"))).first()[0]
    assert 0.29 < skip < 0.35


def test_planted_clusters_are_recovered(spark):
    rng = np.random.default_rng(7)
    centers = rng.normal(0, 10, size=(4, 15))
    rows = []
    for i in range(240):
        c = i % 4
        v = centers[c] + rng.normal(0, 0.3, 15)
        rows.append((i, c, *map(float, v)))
    df = spark.createDataFrame(rows, ["user_id", "planted", *C.METRIC_KEYS])
    seg = CL.segment(df.drop("planted"), ["user_id"], restarts=2)
    assert seg.status == "ok" and seg.k == 4 and seg.silhouette > 0.9
    joined = seg.assignments.join(df.select("user_id", "planted"), "user_id")
    purity = joined.groupBy("cluster", "planted").count().groupBy("cluster").agg(F.max("count")).agg(
        F.sum("max(count)")).first()[0]
    assert purity == 240
    sizes = {r.cluster: r.size for r in seg.clusters.collect()}
    assert sorted(sizes.values()) == [60, 60, 60, 60]
    # centroid = group mean of the raw columns
    c0 = seg.clusters.orderBy("cluster").first()
    m0 = seg.assignments.filter(F.col("cluster") == c0.cluster).agg(F.avg(C.METRIC_KEYS[0])).first()[0]
    assert abs(c0[C.METRIC_KEYS[0]] - m0) < 1e-9
    placed = CL.assign(seg, df.drop("planted").limit(8), ["user_id"])
    assert placed.count() == 8


def test_too_few_rows_is_insufficient(spark):
    df = spark.createDataFrame([(i, *([1.0] * 15)) for i in range(3)], ["user_id", *C.METRIC_KEYS])
    assert CL.segment(df).status == "insufficient_data"


def test_streaming_sessions_match_batch(spark, events_small):
    from cadenza.streaming.sessions import read_play_stream, stream_sessions

    src = scratch_path(spark, "stream-src")
    events_small.write.parquet(src)
    # a far-future play of every listener closes all earlier sessions
    late = events_small.groupBy("user_id").agg(F.max("ts").alias("mts")).join(
        events_small, "user_id").filter(F.col("ts") == F.col("mts")).drop("mts").dropDuplicates(["user_id"]).withColumn(
        "ts", F.timestamp_add("DAY", F.lit(30), F.col("ts")))
    late.select(*events_small.columns).write.mode("append").parquet(src)
    st = stream_sessions(read_play_stream(spark, src))
    q = st.writeStream.outputMode("append").format("memory").queryName("sess_test").start()
    q.processAllAvailable()
    # one more (empty) batch lets the advanced watermark evict closed sessions
    time.sleep(0.5)
    q.processAllAvailable()
    last = events_small.agg(F.max("ts")).first()[0]
    got = spark.table("sess_test").filter(F.col("start_ts") <= F.lit(last))  # drop the closer plays
    want = S.sessions(events_small, ("user_id",), "end_to_end")
    q.stop()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_no_exports_give_an_empty_typed_table(spark):
    missing = scratch_path(spark, "none") + "/*.json"
    df = schema.read_plays(spark, missing)
    assert df.count() == 0 and df.schema == schema.PLAY_SCHEMA
    assert schema.read_plays(spark, []).count() == 0
