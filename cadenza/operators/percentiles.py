"""Where a listener stands in the pool of listeners.

Percentile of a value = 100 * (pool values strictly below it) / (pool size);
pools with fewer than two members give 50.

The count of strictly smaller values is computed without a window over the
whole metric (which would put every listener of a metric in one task):

1. values are collapsed to distinct ``(metric, value)`` rows with a weight
   (ties, however hot, become one row after a map-side partial aggregate);
2. ``percentile_approx``, a mergeable sketch of the values, gives ``B - 1``
   splitters per metric.  ``B`` comes from the counted pool, so that a range
   holds about ``RANGE_ROWS`` distinct values at any pool size, and the
   sketch's accuracy grows with it.  The splitters are ``#metrics`` rows of
   ``B`` numbers, counted before they are broadcast;
3. each distinct value falls in one of ``B`` buckets; a per-(metric, bucket)
   total (``#metrics * B`` rows) gives the mass of all lower buckets;
4. inside each (metric, bucket) a running sum gives the mass below the value.

Equal values always share a bucket, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import constants as C
from cadenza.session import written

#: Distinct values of a group that one sorted range holds, about.
RANGE_ROWS = 100_000
#: Ranges a group may have: groups x this many numbers are broadcast.
MAX_RANGES = 20_000


def _count_less(bounds: str, value: str, size: int) -> list[tuple[str, F.Column]]:
    """Binary lifting over a sorted array: number of elements < value in
    O(log size) steps (one projection per step)."""
    steps = []
    step = 1
    while step * 2 <= size:
        step *= 2
    steps.append(("_lo", F.lit(0)))
    while step >= 1:
        nxt = F.col("_lo") + F.lit(step)
        ok = (nxt <= F.size(bounds)) & (F.element_at(bounds, nxt) < F.col(value))
        steps.append(("_lo", F.when(ok, nxt).otherwise(F.col("_lo"))))
        step //= 2
    return steps


def to_long(vectors: DataFrame, id_cols: Sequence[str], metrics: Sequence[str] = tuple(C.METRIC_KEYS)) -> DataFrame:
    """Wide vectors -> ``(id..., metric, value)`` (unpivot)."""
    return vectors.unpivot(list(id_cols), list(metrics), "metric", "value").select(
        *id_cols, "metric", F.col("value").cast("double").alias("value"))


def count_below(values: DataFrame, group: Sequence[str] = ("metric",), value: str = "value",
                weight: str | None = None, buckets: int | None = None) -> DataFrame:
    """For every distinct ``(group, value)``: the total weight of rows of the
    group with a strictly smaller value (``below``) and the group's total
    weight (``total``).  Rows with weight 0 are query points only.

    ``buckets``: ranges per group; by default counted from ``values`` (which
    should be a written table, as it is read three times)."""
    g = list(group)
    w = F.col(weight) if weight else F.lit(1)
    cnt = values.groupBy(*g, value).agg(F.sum(w).cast("bigint").alias("_w"))
    if buckets is None:
        most = cnt.groupBy(*g).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        buckets = max(1, min(MAX_RANGES, -(-most // RANGE_ROWS)))
    bounds = cnt.groupBy(*g).agg(*([F.percentile_approx(
        value, [i / buckets for i in range(1, buckets)], max(10_000, 20 * buckets)).alias("_bounds")] if buckets > 1 else []),
        F.sum("_w").alias("total"))
    # one row per group, at most ``buckets`` doubles each: bounded, broadcast
    c = cnt.join(F.broadcast(bounds), g)
    for name, expr in _count_less("_bounds", value, buckets - 1) if buckets > 1 else [("_lo", F.lit(0))]:
        c = c.withColumn(name, expr)
    c = c.withColumnRenamed("_lo", "_bkt")
    per_bucket = c.groupBy(*g, "_bkt").agg(F.sum("_w").alias("_bw"))
    offsets = per_bucket.select(
        *g, "_bkt",
        F.coalesce(F.sum("_bw").over(
            Window.partitionBy(*g).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_off"))
    within = Window.partitionBy(*g, "_bkt").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = c.join(F.broadcast(offsets), [*g, "_bkt"]).select(
        *g, value, "total",
        (F.col("_off") + F.coalesce(F.sum("_w").over(within), F.lit(0))).alias("below"))
    return out


def percentiles(pool: DataFrame, id_cols: Sequence[str] = ("user_id",),
                metrics: Sequence[str] = tuple(C.METRIC_KEYS)) -> DataFrame:
    """Every pool member's percentile on every metric (long format).

    The long table is read by several consumers (ranking, join back), so it
    is materialised once instead of re-running the plan that built the pool."""
    long = written(to_long(pool, id_cols, metrics), "pool-long")
    below = count_below(long)
    pct = F.when(F.col("total") < 2, F.lit(C.PERCENTILE_SMALL_POOL)).otherwise(
        F.lit(100.0) * F.col("below") / F.col("total"))
    return long.join(below, ["metric", "value"]).select(*id_cols, "metric", "value", pct.alias("percentile"))


def percentiles_against(users: DataFrame, pool: DataFrame, id_cols: Sequence[str] = ("user_id",),
                        metrics: Sequence[str] = tuple(C.METRIC_KEYS)) -> DataFrame:
    """Percentiles of (new) users against a pool they are not part of.

    The users' values enter the ranking with weight 0, so they are positioned
    among the pool values without counting themselves (no theta join)."""
    pool_long = to_long(pool, [], metrics).withColumn("_w", F.lit(1))
    user_long = written(to_long(users, id_cols, metrics), "users-long")
    # ties of both sides collapse before they are written and ranked
    both = written(pool_long.unionByName(user_long.select("metric", "value", F.lit(0).alias("_w"))).groupBy("metric", "value").agg(
        F.sum("_w").alias("_w")), "ranked-values")
    below = count_below(both, weight="_w")
    pct = F.when(F.col("total") < 2, F.lit(C.PERCENTILE_SMALL_POOL)).otherwise(
        F.lit(100.0) * F.col("below") / F.col("total"))
    return user_long.join(below, ["metric", "value"]).select(
        *id_cols, "metric", "value", pct.alias("percentile"))


def percentile_labels(pcts: DataFrame, id_cols: Sequence[str] = ("user_id",)) -> DataFrame:
    """``%NN <text>`` per metric; the number is the percentile shown with
    one decimal, then with none (half-even both times)."""
    m = F.create_map(*[x for k, v in C.METRIC_LABEL_SUFFIX.items() for x in (F.lit(k), F.lit(v))])
    shown = F.bround(F.bround(F.col("percentile"), 1), 0).cast("bigint")
    return pcts.select(*id_cols, "metric",
                       F.format_string("%%%d %s", shown, F.element_at(m, F.col("metric"))).alias("label"))


def pool_averages(pool: DataFrame, metrics: Sequence[str] = tuple(C.METRIC_KEYS)) -> DataFrame:
    """Pool size and the mean of every metric (one row; empty pool -> 0)."""
    return pool.agg(F.count(F.lit(1)).alias("total_users"),
                    *[F.coalesce(F.avg(F.col(m).cast("double")), F.lit(0.0)).alias(m) for m in metrics])
