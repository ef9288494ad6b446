"""Physical-plan properties behind the scale claims (checked with explain)."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from cadenza.operators import aggregates as A
from cadenza.operators import sequence as S
from cadenza.session import scratch_path
from cadenza.sources import schema


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df) -> str:
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(
        jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_top_k_per_listener_limits_before_the_shuffle(events_small):
    txt = _formatted(A.top_artists(events_small, 20, ("user_id",)))
    assert txt.count("WindowGroupLimit") >= 2  # partial (map side) + final


def test_top_k_whole_input_is_take_ordered(events_small):
    assert "TakeOrderedAndProject" in _formatted(A.top_artists(events_small, 20, ()))


def _one_hot_listener(spark):
    """12,000 plays, half of them one listener's, one a minute with pauses."""
    return spark.range(12_000).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 400 + 1).alias("user_id"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id + 60 * (id div 500), 0)").alias("ts"),
        F.concat(F.lit("t"), F.col("id") % 37).alias("track"), F.concat(F.lit("a"), F.col("id") % 11).alias("artist"),
        (F.col("id") % 90 * 1000).alias("ms_played"), F.col("id").alias("play_id"))


@pytest.mark.parametrize("keys", [("user_id",), ()])
def test_a_hot_listener_is_spread_over_tasks(spark, keys):
    """With shuffle joins forced and 64 partitions, no ordered window of plays
    has a task with many more than hot_rows plays."""
    plays, hot = _one_hot_listener(spark), 500
    names = ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("64", "-1", "false")):
            spark.conf.set(n, v)
        o = S._divide(plays, keys, None, hot)
        for df in (S.gaps(plays, keys, hot_rows=hot), S.session_ids(plays, keys, hot_rows=hot),
                   S._fragments(o.hot, o.part, "end_to_start", 30).withColumnRenamed("plays", "weight")):
            weight = F.sum("weight") if "weight" in df.columns else F.count(F.lit(1))
            used = F.sum(F.xxhash64(*df.columns) % 2)                            # so that no column is pruned
            most = df.groupBy(F.spark_partition_id()).agg(weight.alias("n"), used.alias("u")).agg(F.max("n"), F.max("u")).first()[0]
            assert most <= 5 * hot
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


@pytest.mark.parametrize("mode,keys", [("end_to_start", ("user_id",)), ("end_to_end", ())])
def test_fragments_merge_to_the_same_history(spark, mode, keys):
    plays = _one_hot_listener(spark).limit(6000)
    rows = lambda df: [(round(x, 9) if isinstance(x, float) else x) for r in df.orderBy(*df.columns).collect() for x in r]
    whole = rows(S.history(plays, keys, mode))
    assert rows(S.history(plays, keys, mode, none_hot=True)) == whole
    counted = S.session_ids(plays, keys, mode).select(*keys, "session_start").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("sessions"))
    assert rows(S.history(plays, keys, mode).select(*keys, "sessions")) == rows(counted)
    for hot in (0, 100, 2900):
        assert rows(S.history(plays, keys, mode, hot_rows=hot)) == whole
    assert rows(S.sessions(plays, keys, mode, hot_rows=50)) == rows(S.sessions(plays, keys, mode))


def test_history_reads_and_shuffles_the_plays_once(events_small):
    for none_hot, scans in ((True, 1), (False, 2)):         # one more counts the plays of each key
        df = S.history(events_small, ("user_id",), none_hot=none_hot)
        assert len(df.collect()) == 15
        txt = df._jdf.queryExecution().executedPlan().toString()
        final = txt[txt.index("Final Plan"):].split("Initial Plan")[0]
        assert final.count("Scan parquet") <= scans and len(re.findall(r"Exchange hashpartitioning", final)) <= scans


def test_scan_reads_only_needed_columns(spark, events_small):
    path = scratch_path(spark, "plays")
    schema.write_plays(events_small, path)
    plays = schema.read_plays_table(spark, path)
    txt = _formatted(A.by_artist(plays, ("user_id",)))
    rs = [l for l in txt.splitlines() if "ReadSchema" in l][0]
    assert "artist" in rs and "ms_played" in rs and "platform" not in rs and "track" not in rs


def test_filters_reach_the_scan(spark, events_small):
    path = scratch_path(spark, "plays")
    schema.write_plays(events_small, path)
    plays = schema.read_plays_table(spark, path).filter(F.col("artist") != "Unknown")
    txt = _formatted(S.transitions(plays, ("user_id",)))
    assert "PushedFilters: [IsNotNull(artist), Not(EqualTo(artist,Unknown))]" in txt


def test_edge_weights_equal_in_gap_pairs(events_small):
    e = S.transitions(events_small, ("user_id",))
    g = S.gaps(events_small.filter(F.col("artist") != "Unknown"), ("user_id",))
    pairs = g.filter(F.col("prev_ts").isNotNull() & (F.col("gap_min") <= 30)).count()
    assert e.agg(F.sum("weight")).first()[0] == pairs
