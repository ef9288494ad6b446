"""Helpers shared by the corpus operators: written tables, joins that survive
hot keys, connected components by star rounds, and bounded Arrow batches.

Conventions of every operator here: an id column identifies a document (rows
that share an id are the same document and share its decision, but where a
decision comes from the text alone, as in the quality filter and in
decontamination, the rows of one text share it; ids may be null); a null text counts as an empty one; extra columns, whatever their
names, are carried or ignored but never read.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import scratch_path

#: A key is hot when it holds at least 1 / HOT_SHARE of the rows, so that the
#: list of hot keys has at most HOT_SHARE rows whatever the input's size.
HOT_SHARE = 1000
#: Rows of one key that go to one task.
SPLIT_ROWS = 20_000
#: Numbers (8 bytes each, and an entry of a hash table) that may be broadcast.
BROADCAST_NUMBERS = 1 << 20
#: Bytes of an Arrow batch handed to Python (long texts make small batches).
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: later jobs
    read it instead of replaying the plan, and it outlives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches of this session to ``most`` where Spark's own
    default (64 MB) or this module's holds; a setting the user made is left as
    it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") in (str(64 << 20), str(BATCH_BYTES)):
        spark.conf.set(key, str(most))


_memos: list[Callable[[], None]] = []


def remembers(clear: Callable[[], None]) -> None:
    """Name what empties a memo that a Python worker keeps between tasks."""
    _memos.append(clear)


def release_memos() -> None:
    """Called by tasks of other operators: a worker that has moved on to them
    gives back what the encoders remembered."""
    for clear in _memos:
        clear()


def give_back() -> None:
    """Called by tasks of a worker that earlier stages have used: unused pages
    of Arrow's pool and of the C heap go back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


@contextmanager
def no_cycle_collector() -> Iterator[None]:
    """Inside, Python frees objects by their reference counts alone: the
    encoders make millions of strings and no cycles, and the collector would
    walk them again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], n: str,
                how: str = "inner") -> DataFrame:
    """Join ``left`` with ``right`` (one row per key; its column ``n`` counts
    the left rows of the key) without sending a hot key to one task.

    Keys with 1/HOT_SHARE of the rows or more, at most HOT_SHARE of them, are
    broadcast with their number of splits; their left rows take a salt (a hash
    of the row, so a task that runs again deals them alike) and their right
    row is repeated once per split.  ``right`` must be a written
    table (it is read three times); ``left`` is read once."""
    total = right.agg(F.sum(n)).first()[0] or 0
    if total < SPLIT_ROWS:
        return left.join(right, list(keys), how)
    hot = F.greatest(F.lit(SPLIT_ROWS), F.lit(total // HOT_SHARE + 1))
    splits = F.when(F.col(n) >= hot, F.ceil(F.col(n) / F.lit(SPLIT_ROWS)).cast("int")).otherwise(F.lit(1))
    many = right.filter(F.col(n) >= hot).select(*keys, splits.alias("_splits"))
    salted = left.join(F.broadcast(many), list(keys), "left").withColumn(
        "_salt", F.when(F.col("_splits") > 1, F.pmod(F.xxhash64(*left.columns), F.col("_splits")).cast("int"))
        .otherwise(F.lit(0))).drop("_splits")
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), splits - 1)))
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components of undirected ``links`` (a, b: bigint) by
    alternating large-star and small-star rounds: (v, label), label the
    smallest vertex reachable; only vertices that have a link appear.

    Every round emits at most one link per link, hubs are split by
    ``lookup_join``, each round is written, and the fixpoint is told by the
    count and the summed hash of the links."""
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    cur = written(links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = state(cur)
    if not seen[0]:
        return cur.select(F.col("a").alias("v"), F.col("b").alias("label"))
    for _ in range(max_rounds):
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        m = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), "star")
        large = lookup_join(both, m, ["u"], "n").filter(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        m = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "star")
        small = lookup_join(large, m, ["u"], "n")
        cur = written(small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            small.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .filter(F.col("a") != F.col("b")).distinct(), "links")
        now = state(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no fixpoint after {max_rounds} rounds")
    top = cur.select(F.col("a").alias("v"), F.col("b").alias("label"))
    return top.union(cur.select(F.col("b").alias("v"), F.col("b").alias("label"))).distinct()


def if_small(df: DataFrame, numbers: int) -> DataFrame:
    """``df`` to be broadcast if the counted ``numbers`` it holds are within
    BROADCAST_NUMBERS; beyond, the join shuffles both sides."""
    return F.broadcast(df) if numbers <= BROADCAST_NUMBERS else df


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", how: str = "left_anti") -> DataFrame:
    """Rows of ``docs`` whose id is not (``left_semi``: is) in the one column
    of ``ids``; null ids match null ids.  The ids are written and counted:
    few enough, they are broadcast and the documents are not shuffled."""
    ids = written(ids.toDF("_ids").distinct(), "ids")
    ids = if_small(ids, ids.count())
    return docs.join(ids, docs[id_col].eqNullSafe(ids["_ids"]), how)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without_rows(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id and text are not in ``rows`` (id, text_hash);
    so other texts under the same id, or under a null one, stay."""
    rows = written(rows.toDF("_ids", "_th").distinct(), "rows")
    rows = if_small(rows, 2 * rows.count())
    return docs.join(rows, docs[id_col].eqNullSafe(rows["_ids"]) & (text_hash(docs[text_col]) == rows["_th"]), "left_anti")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
