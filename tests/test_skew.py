"""Hubs, hot values and one-scan aggregates."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from cadenza.operators import aggregates as A
from cadenza.operators import graph as G
from cadenza.operators import metrics as M
from cadenza.operators import percentiles as PC
from cadenza.operators.skew import split_join


def _final(df) -> str:
    df.collect()
    txt = df._jdf.queryExecution().executedPlan().toString()
    return txt[txt.index("Final Plan"):].split("Initial Plan")[0] if "Final Plan" in txt else txt


def test_a_star_of_a_million_members_has_no_large_task(spark):
    """The centre's million edges meet their centre row in pieces."""
    star = spark.range(1, 1_000_001).select(F.lit(0).alias("u"), F.col("id").alias("v")).unionAll(
        spark.range(1, 1001).select(F.col("id").alias("u"), (F.col("id") + 2_000_000).alias("v")))
    m = star.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.skewJoin.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("32", "false", "false", "-1")):
            spark.conf.set(n, v)
        joined = split_join(star, m, ["u"], "n", hot_rows=5_000)
        used = F.sum(F.xxhash64(*joined.columns) % 2).alias("u")
        rows, most, _ = joined.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), used).agg(
            F.sum("n"), F.max("n"), F.max("u")).first()
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert rows == 1_001_000 and most <= 60_000                # 31,281 a task on average


def test_split_hubs_give_the_same_graph_results(spark):
    e = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 23).cast("string").alias("src"),
        (F.col("id") * 7 % 61).cast("string").alias("dst"), (F.col("id") % 5 + 1).alias("weight"))
    e = e.unionByName(e.limit(40).select((F.col("src").cast("int") + 100).cast("string").alias("src"),
                                         (F.col("dst").cast("int") + 100).cast("string").alias("dst"), "weight"))
    key = lambda df: [(round(x, 12) if isinstance(x, float) else x) for r in df.orderBy("id").collect() for x in r]
    assert key(G.components(e, hot_rows=3)) == key(G.components(e))
    assert key(G.pagerank(e, iterations=5, hot_rows=3)) == key(G.pagerank(e, iterations=5))
    assert key(G.pagerank_unweighted(e, iterations=3, hot_rows=3)) == key(G.pagerank_unweighted(e, iterations=3))


def test_ranges_follow_the_pool(spark, monkeypatch):
    values = spark.range(5000).select(F.lit("m").alias("metric"), (F.pmod(F.xxhash64("id"), F.lit(3000)) / 7).alias("value"))
    want = sorted(map(tuple, PC.count_below(values, buckets=1).collect()))
    monkeypatch.setattr(PC, "RANGE_ROWS", 100)
    assert sorted(map(tuple, PC.count_below(values).collect())) == want
    assert PC.count_below(values.limit(0)).count() == 0


@pytest.mark.parametrize("keys", [("user_id",), ()])
def test_these_read_the_plays_once(events_small, keys):
    for f in (A.distinct_counts, A.peaks, M.circadian, M.weekday_profile, M.novelty):
        assert len(re.findall(r"Scan parquet", _final(f(events_small, keys)))) == 1, f.__name__
