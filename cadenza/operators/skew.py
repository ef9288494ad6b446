"""Joins whose hot keys are split by the counts of the round itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that go to one task.
HOT_ROWS = 100_000
#: Keys that are split; their list is broadcast.  A key beyond them has less
#: than 1 / MAX_HOT_KEYS of the rows.
MAX_HOT_KEYS = 10_000


def hot_splits(counts: DataFrame, keys: Sequence[str], n: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, _splits): in how many pieces each hot key goes, at most
    ``MAX_HOT_KEYS`` rows, the largest keys."""
    return counts.filter(F.col(n) > hot_rows).orderBy(F.col(n).desc(), *keys).limit(MAX_HOT_KEYS).select(
        *keys, F.ceil(F.col(n) / F.lit(hot_rows)).cast("int").alias("_splits"))


def split_join(left: DataFrame, right: DataFrame, keys: Sequence[str], n: str,
               hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``left`` with ``right``, one row per key whose column
    ``n`` counts the left rows of the key (dropped from the result).

    Left rows of a hot key are dealt over pieces by a hash of the row (a task
    that runs again deals them alike), and its right row is repeated per
    piece, so no task gets more than about ``hot_rows`` rows of a key.  The
    plan is lazy; where no key is hot AQE drops the broadcast."""
    ks, dealt = list(keys), left.columns
    hot = F.broadcast(hot_splits(right.select(*ks, n), ks, n, hot_rows))
    piece = F.when(F.col("_splits").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*dealt), F.col("_splits")).cast("int"))
    salted = left.join(hot, ks, "left").withColumn("_piece", piece).drop("_splits")
    spread = right.join(hot, ks, "left").withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1))).drop("_splits", n)
    return salted.join(spread, [*ks, "_piece"]).drop("_piece")
