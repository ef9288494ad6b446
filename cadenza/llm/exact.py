"""Exact dedup over an extendible-hash index kept as shared files.

A document's key is the 64-bit hash of its text.  The directory starts with
one bucket and doubles while a bucket holds more than ``capacity`` keys; a
bucket splits only if it is overfull, so buckets have local depths.  The
directory routes every row: owner tasks take ranges of buckets (ranges of the
key), compare the bytes of texts that share a key by grouping, chain texts
that differ, and write their part of the index to the checkpoint folder.
Documents find their bucket by the same directory and, in it, the chain of
their key.  Keys with many copies are folded, with partial aggregation, before
they go to their owner.  DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.llm.common import lookup_join, sha256_hex, without_rows, written
from cadenza.session import scratch_path

#: Keys a bucket may hold before it splits; fewer where an owner would have
#: less than BUCKETS_PER_OWNER buckets.
CAPACITY = 16_384
BUCKETS_PER_OWNER = 4
#: The directory stops doubling here, so it has at most 65,536 slots (8 bytes
#: and two numbers each) and may be broadcast; a bucket that is still overfull
#: then stays as it is.
MAX_DEPTH = 16
#: Keys with this many rows, and at least 1/FOLD_SHARE of all, are folded
#: before they are routed; their list has at most FOLD_SHARE keys.
FOLD_ROWS = 1_000
FOLD_SHARE = 100_000


def _slot(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, bucket, local_depth) and the global depth for distinct ``keys``,
    by doubling.

    The loads of the slots at a depth come from one histogram a few bits
    finer; a round counts the overfull buckets and doubles if there are any."""
    n = keys.count()
    fine = min(MAX_DEPTH, max(4, math.ceil(math.log2(max(n, 1) / capacity + 1)) + 4))
    loads = written(keys.groupBy(_slot(F.col("key"), fine).alias("slot")).agg(F.count(F.lit(1)).alias("load")), "loads")
    depth = 0
    while depth < MAX_DEPTH:
        if depth > fine:                                       # the histogram is too coarse: a finer one
            fine = min(MAX_DEPTH, fine + 4)
            loads = written(keys.groupBy(_slot(F.col("key"), fine).alias("slot")).agg(F.count(F.lit(1)).alias("load")), "loads")
        at = loads.groupBy(F.shiftrightunsigned("slot", fine - depth).alias("slot")).agg(F.sum("load").alias("load"))
        if at.filter(F.col("load") > capacity).isEmpty():
            break
        depth += 1
    # local depth of a slot: the least depth at which its bucket is not overfull
    levels = loads.select("load", F.shiftrightunsigned("slot", fine - depth).alias("slot"),
                          F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"))
    shift = F.lit(depth) - F.col("d")
    nodes = levels.groupBy("d", F.floor(F.col("slot") / F.pow(F.lit(2.0), shift)).cast("long").alias("prefix")).agg(
        F.sum("load").alias("load"))
    fits = nodes.filter((F.col("load") <= capacity) | (F.col("d") == depth))
    slots = loads.select(F.shiftrightunsigned("slot", fine - depth).alias("slot")).distinct()
    cover = slots.select("slot", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d")).withColumn(
        "prefix", F.floor(F.col("slot") / F.pow(F.lit(2.0), shift)).cast("long"))
    local = cover.join(fits, ["d", "prefix"]).groupBy("slot").agg(F.min("d").alias("local_depth"))
    bucket = F.floor(F.col("slot") / F.pow(F.lit(2.0), F.lit(depth) - F.col("local_depth"))) * F.pow(
        F.lit(2.0), F.lit(depth) - F.col("local_depth"))
    return written(local.select("slot", bucket.cast("long").alias("bucket"), "local_depth"), "directory"), depth


def route(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """``rows`` (key, ...) with the bucket and local_depth of their slot."""
    return rows.withColumn("slot", _slot(F.col("key"), depth)).join(F.broadcast(slots), "slot").drop("slot")


def _keyed(docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column] | None) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("key"), "text")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None,
                capacity: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The index, its directory and the global depth.

    The index has one row per distinct text: bucket, local_depth, key, chain
    (its place among the texts of the key, in order of their digests), sha,
    keep_id (largest id), n.  A chain is as long as texts share a 64-bit hash."""
    spark = docs.sparkSession
    rows = _keyed(docs, id_col, text_col, normalise)
    keys = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "keys")
    total, distinct = keys.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots, depth = directory(keys, capacity or min(CAPACITY, distinct // (BUCKETS_PER_OWNER * owners) + 1))
    routed = route(rows, slots, depth)
    many = keys.filter(F.col("n") >= max(FOLD_ROWS, total // FOLD_SHARE + 1)).select("key")
    one = routed.select("bucket", "local_depth", "key", "text", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    if not many.isEmpty():
        folded = routed.join(F.broadcast(many), "key", "left_semi").groupBy("bucket", "local_depth", "key", "text").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        one = one.join(F.broadcast(many), "key", "left_anti").select(*folded.columns).union(folded)
    # a range of buckets per owner; grouping there needs no further exchange
    owner = F.floor(F.col("bucket") * F.lit(owners) / F.lit(float(1 << depth))).cast("int")
    owned = one.withColumn("owner", owner).repartitionById(owners, "owner")
    texts = owned.groupBy("owner", "bucket", "local_depth", "key", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("owner", "bucket", "key").orderBy("sha"))
    out = texts.select("owner", "bucket", "local_depth", "key", sha256_hex(F.col("text")).alias("sha"), "keep_id", "n").withColumn(
        "chain", place).select("bucket", "local_depth", "key", "chain", "sha", "keep_id", "n")
    path = scratch_path(spark, "exact-index")
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path), slots, depth


def find(docs: DataFrame, index: tuple[DataFrame, DataFrame, int], id_col: str = "doc_id", text_col: str = "text",
         normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, bucket, key, sha, chain, keep_id, n): for every row its bucket
    by the directory and its text's place in the chain of its key there."""
    entries, slots, depth = index
    rows = route(_keyed(docs, id_col, text_col, normalise).select("doc_id", "key", sha256_hex(F.col("text")).alias("sha")), slots, depth)
    return lookup_join(rows.select("doc_id", "bucket", "key", "sha"), entries.select("bucket", "key", "sha", "chain", "keep_id", "n"),
                       ["bucket", "key", "sha"], "n").select("doc_id", "bucket", "key", "sha", "chain", "keep_id", "n")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     normalise: Callable[[Column], Column] | None = None, capacity: int | None = None,
                     with_key: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256 (of the normalised text).

    Of equal texts the row with the largest id stays.  A null text equals an
    empty one.  Rows that share id and text are all kept or all dropped; a
    group of null ids only has a null keep_id and is kept.  An empty table
    gives an empty result."""
    found = find(docs, build_index(docs, id_col, text_col, normalise, capacity), id_col, text_col, normalise)
    return found.select("doc_id", "keep_id", F.col("n").alias("group_size"),
                        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), *(["key"] if with_key else []))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` drops, told by id
    and text, so that another text under a dropped id stays."""
    gone = exact_duplicates(docs, id_col, text_col, with_key=True).filter(~F.col("kept")).select("doc_id", "key")
    return without_rows(docs, gone, id_col, text_col)
