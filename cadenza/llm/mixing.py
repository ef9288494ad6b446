"""Mixing sources to target weights.

Every row gets a hash-random key; inside each source the rows are cut into key
ranges, each range is sorted, and the prefix sum of words before a row is the
sum of the ranges before its own plus the running sum in it.  A source's
budget is whole epochs of the source plus the rows whose prefix lies below
what is left; the row that crosses the budget is cut at a word.

No source meets in one task: ranges have a bounded number of rows (keys are
uniform; identical rows are numbered and keyed apart), and only range totals
are summed in order.  The list of sources may be long: it is ranked and
water-filled by the same prefix sums over range partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.llm.common import BROADCAST_NUMBERS, lookup_join, written

WEIGHTS = (5, 2, 1)
#: A source is taken this many times at most.
MOST_EPOCHS = 3
#: Rows that one sorted range may hold.
RANGE_ROWS = 50_000
LEAST_RANGE_ROWS = 1_000
#: Copies of a row that are numbered from one row of the plan.
COPIES_AT_ONCE = 10_000
WHITE = " \t\n\x0b\x0c\r"
_BEFORE = (W.unboundedPreceding, -1)


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII white ones."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("long")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(df: DataFrame, order: Sequence[str], sums: dict[str, Column], name: str) -> DataFrame:
    """``df`` with, for each entry of ``sums``, the sum over all rows before
    the row in ``order`` (a total order).  The rows are range-partitioned and
    written, so that partition numbers stay; one row per partition is summed
    in order and broadcast."""
    placed = written(df.repartitionByRange(_partitions(df), *order).withColumn("_part", F.spark_partition_id()), name)
    parts = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_of_{k}") for k, c in sums.items()])
    ahead = W.orderBy("_part").rowsBetween(*_BEFORE)
    carry = parts.select("_part", *[F.coalesce(F.sum(f"_of_{k}").over(ahead), F.lit(0)).alias(f"_to_{k}") for k in sums])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(*_BEFORE)
    return placed.join(F.broadcast(carry), "_part").select(
        *df.columns, *[(F.col(f"_to_{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(k) for k, c in sums.items()])


def budgets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``sources`` (absent, source, source_size, ...) with sid (its place by
    code point, null last, from 0), target (double) and budget (whole words).

    Sources share the words of all by weight; a source above ``most`` times
    its size is held there and the excess is shared again.  The end of that is
    min(most x size, level x weight); with the sources in the order of
    most x size / weight, the level is the largest of (words left) / (weight
    left) over the prefixes, so no rounds are needed."""
    ranked = prefix_sums(sources, ["absent", "source"], {"sid": F.lit(1)}, "mix-ranked").withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * most
    full = prefix_sums(ranked.withColumn("_when", cap / F.col("weight")), ["_when", "absent", "source"],
                       {"_held": cap, "_gone": F.col("weight")}, "mix-filled")
    words, weight = full.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = full.agg(F.max((F.lit(words) - F.col("_held")) / (F.lit(weight) - F.col("_gone")))).first()[0] or 0.0
    target = F.least(cap.cast("double"), F.lit(level) * F.col("weight"))
    return full.drop("_when", "_held", "_gone").withColumn("target", target).withColumn(
        "budget", F.least(cap, F.floor(F.col("target") + 0.5)))


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 11,
         id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, key (binary, the order of
    the mix), size (words), source_size, target, budget, taken (words the mix
    takes of this row, epochs counted).

    Sums of taken equal the budgets, the targets rounded to whole words.  Null
    texts count as empty; a null source is a source of its own, the last;
    empty rows and sources take nothing.  Rows with null or repeated ids are
    rows like others; identical rows are numbered, so which of them is cut is
    the same in every run.  An empty table gives an empty plan."""
    text, source = F.coalesce(F.col(text_col), F.lit("")), F.col(source_col)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    same = ["doc_id", "absent", "source", "size", "key"]
    rows = written(docs.select(F.col(id_col).alias("doc_id"), source.isNull().alias("absent"), F.coalesce(source, F.lit("")).alias("source"),
                               word_count(text).alias("size"), key.alias("key")).groupBy(*same).agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    per_source = rows.groupBy("absent", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"),
                                                      F.max("n").alias("most_copies"))
    totals = budgets(per_source, weights, most)
    total, copies, listed = per_source.agg(F.sum("n"), F.max("most_copies"), F.count(F.lit(1))).first()
    in_range = max(LEAST_RANGE_ROWS, min(RANGE_ROWS, (total or 0) // (4 * _partitions(docs))))
    totals = written(totals.select("absent", "source", "sid", "source_size", "target", "budget", "n",
                                   F.ceil(F.col("n") / F.lit(in_range)).cast("long").alias("ranges")), "mix-budgets")

    # number identical rows and key them apart, in pieces where there are very many
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES_AT_ONCE).cast("long")))
    pieces = rows.withColumn("_from", piece)
    if (copies or 0) > COPIES_AT_ONCE:
        pieces = pieces.repartition(*same, "_from")
    each = pieces.withColumn("_copy", F.explode(F.sequence("_from", F.least(F.col("_from") + COPIES_AT_ONCE, F.col("n")) - 1)))
    keyed = each.select("doc_id", "absent", "source", "size", F.unhex(F.md5(F.concat_ws(":", "key", "_copy").cast("binary"))).alias("key"))

    share = ["absent", "source"]
    found = (keyed.join(F.broadcast(totals), share) if 8 * listed <= BROADCAST_NUMBERS else lookup_join(keyed, totals, share, "n"))
    at = F.conv(F.substring(F.hex("key"), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    placed = written(found.select("doc_id", "sid", "size", "key", F.floor(at * F.col("ranges")).alias("range")), "mix-placed")
    ahead = W.partitionBy("sid").orderBy("range").rowsBetween(*_BEFORE)
    ranges = placed.groupBy("sid", "range").agg(F.sum("size").alias("_words")).select(
        "sid", "range", F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_ahead"))
    facts = totals.select("sid", "absent", "source", "source_size", "target", "budget")
    starts = ranges.join(F.broadcast(facts) if 8 * listed <= BROADCAST_NUMBERS else facts, "sid")
    inside = W.partitionBy("sid", "range").orderBy("key", "doc_id").rowsBetween(*_BEFORE)
    before = F.col("_ahead") + F.col("_inside")
    epochs = F.expr("if(source_size = 0, 0, budget div source_size)")
    left = F.col("budget") - epochs * F.col("source_size") - before
    return placed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["sid", "range"]).select(
        "doc_id", F.when(~F.col("absent"), F.col("source")).alias("source"), "key", "size", "source_size", "target", "budget",
        (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))).alias("taken"))


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 11,
            id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: doc_id, source, epoch (from 0), words, text; a row per
    epoch of every row the mix takes, the last one cut after ``words`` words,
    in a random order that is the same in every run.

    Identical rows are written out as often as the mix takes words of them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    chosen = plan(docs, weights, most, seed, id_col, source_col, text_col).filter(F.col("taken") > 0)
    same = ["doc_id", "source", "size"]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), text.alias("text")).withColumn(
        "size", word_count(F.col("text"))).withColumn("_hash", F.xxhash64("text"))
    first = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")).cast("binary"))
    copies = texts.groupBy(*same, "_hash", "text").agg(F.count(F.lit(1)).alias("n"))
    keyed = copies.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn(
        "key", F.unhex(F.md5(F.concat_ws(":", first, "_copy").cast("binary")))).drop("n", "_copy", "_hash")
    on = [keyed[c].eqNullSafe(chosen[c]) for c in same[:2]] + [keyed["key"] == chosen["key"]]
    found = keyed.join(chosen.select("doc_id", "source", "key", "taken"), on).select(keyed["*"], chosen["taken"])
    epochs = F.sequence(F.lit(0).cast("long"), F.expr("(taken - 1) div size"))
    out = found.withColumn("epoch", F.explode(epochs)).withColumn(
        "words", F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")))
    # pieces end where a word does, so the first of them keep their white space
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, 1, F.col("words").cast("int")), "")
    out = out.withColumn("text", F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(cut)).withColumn(
        "_order", F.md5(F.concat_ws(":", F.hex("key"), "epoch").cast("binary")))
    return out.select("doc_id", "source", "epoch", "words", "text", "_order").repartitionByRange(
        _partitions(docs), "_order").sortWithinPartitions("_order").drop("_order")
