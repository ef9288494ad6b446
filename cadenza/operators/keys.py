"""Grouping-key handling shared by every operator.

``keys=()`` means "the whole input is one listener".  Internally that case
uses a constant key column so every join stays an equi-join on a key (no
cartesian products) and the same code path serves both cases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL = "_all"
DEFAULT_KEYS = ("user_id",)


def prepare(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    keys = list(keys)
    if keys:
        return df, keys
    if ALL in df.columns:
        return df, [ALL]
    return df.withColumn(ALL, F.lit(0)), [ALL]


def finish(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not list(keys) and ALL in df.columns:
        return df.drop(ALL)
    return df


def join_per_key(big: DataFrame, per_key: DataFrame, ks: Sequence[str], keys: Sequence[str],
                 how: str = "inner") -> DataFrame:
    """Join a table with one row per key (graph size, last play, ...).

    With ``keys=()`` the per-key side is exactly one row and the join key is
    a constant: a shuffle join would send every row to one partition, so the
    one-row side is broadcast (its size is proven: one row).  With real keys
    it is an ordinary equi-join on the keys, planned by Catalyst/AQE."""
    if not list(keys):
        per_key = F.broadcast(per_key)
    return big.join(per_key, list(ks), how)
