"""The pool of listener vectors as an appendable Parquet table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions import constants as C

POOL_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("created_at", T.TimestampNTZType())]
    + [T.StructField(m, T.DoubleType()) for m in C.METRIC_KEYS]
)


def to_pool_rows(vectors: DataFrame, id_col: str = "user_id") -> DataFrame:
    """Vectors -> pool rows (P13: missing/null metric -> 0.0)."""
    cols = set(vectors.columns)
    return vectors.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.localtimestamp().alias("created_at"),
        *[(F.coalesce(F.col(m).cast("double"), F.lit(0.0)) if m in cols else F.lit(0.0)).alias(m)
          for m in C.METRIC_KEYS])


def append_pool(vectors: DataFrame, path: str, id_col: str = "user_id") -> str:
    """Append listener vectors to the pool table (one write job, no driver loop)."""
    to_pool_rows(vectors, id_col).write.mode("append").parquet(path)
    return path


def read_pool(spark: SparkSession, path: str, metrics: Sequence[str] = tuple(C.METRIC_KEYS)) -> DataFrame:
    """Scan the pool (only the requested columns are read)."""
    return spark.read.schema(POOL_SCHEMA).parquet(path).select("id", "created_at", *metrics)
