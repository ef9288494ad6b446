"""What the passes of the profile exchange: each play a fixed number of times."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cadenza.operators import aggregates as A
from cadenza.operators import metrics as M
from cadenza.sources.schema import clean_plays


def _sparse_plays(spark):
    """Few plays a listener, every one in another month and far from the next."""
    return clean_plays(spark.range(3000).repartition(8).select(
        (F.col("id") % 300).alias("user_id"), F.expr("timestampadd(MONTH, cast(id div 300 as int), timestamp_ntz '2020-01-05 10:00:00')").alias("ts"),
        F.concat(F.lit("t"), F.col("id") % 7).alias("track"), F.concat(F.lit("a"), F.col("id") % 3).alias("artist"),
        (F.col("id") % 90 * 1000).alias("ms_played"), (F.col("id") % 5 == 0).alias("skipped")))


def _exchanges(df) -> int:
    df.write.format("noop").mode("overwrite").save()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return len(re.findall(r"Exchange hashpartitioning", final))


def test_a_pass_exchanges_the_plays_by_their_keys_alone(spark):
    d = _sparse_plays(spark)
    for t in (A.listener_tables(d, none_hot=True)["month"], *A.track_tables(d, none_hot=True).values()):
        assert _exchanges(t) == 1


def test_tables_are_the_same_without_hot_keys(spark):
    d = _sparse_plays(spark)
    rows = lambda t: sorted(t.collect(), key=str)
    for make in (A.listener_tables, A.track_tables):
        plain, gathered = make(d), make(d, none_hot=True)
        assert plain.keys() == gathered.keys()
        for name in plain:
            assert rows(plain[name]) == rows(gathered[name].select(*plain[name].columns)), name


def test_profile_of_hot_keys_is_the_same(spark):
    d = _sparse_plays(spark)
    rows = lambda t: sorted(([round(x, 9) if isinstance(x, float) else x for x in r] for r in t.collect()), key=str)
    assert rows(M.user_profile(d)) == rows(M.user_profile(d, hot_rows=5))
