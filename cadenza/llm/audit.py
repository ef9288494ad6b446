"""Audit of how quality filters interact: every order in which they could run.

One pass over the texts gives each document a mask of the filters it fails;
documents are then only counted per (part, mask).  Each of these cells is
folded across the array of all orders with ``transform`` and ``aggregate``:
step by step the mask of the filters already run tells whether the cell's
documents are kept, removed here or were gone before.  That makes one weighted
struct per order and step, and the structs of a part's cells are summed
element by element.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.llm.common import BROADCAST_NUMBERS, written

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_WHITE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> list[Column]:
    """Failure conditions A to D of a text, from its words (runs of other than
    the six ASCII white characters) and its characters."""
    words = F.filter(F.split(text, _WHITE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and mask of failed
    filters (bit 0: the first), and those of them labelled good and toxic.

    A document fails E if a smaller id has the same text (told by its
    SHA-256).  Copies of a text are counted per id and aggregated before
    they meet, so a text that many documents share is one row per part and
    label.  Null texts count as empty and a null part as the empty string; a
    null id is no smaller than any other, has no label and does not fail E;
    rows that share the smallest id of their text do not fail it either."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(text_failures(F.col("text")))]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    facts = written(rows.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"),
                                sum(bits[1:], bits[0]).alias("mask")), "audit-facts")
    named = written(labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).filter("good or toxic"), "audit-labels")
    few = 2 * named.count() <= BROADCAST_NUMBERS
    none = F.lit(False)
    known = facts.filter(F.col("id").isNotNull()).join(F.broadcast(named) if few else named, "id", "left").select(
        *facts.columns, F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
    labelled = known.unionByName(facts.filter(F.col("id").isNull()).withColumns({"good": none, "toxic": none}))

    group = ["sha", "part", "mask", "good", "toxic"]
    per_id = labelled.groupBy(*group, "id").agg(F.count(F.lit(1)).alias("n"))
    per_text = per_id.groupBy(*group).agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))
    first = F.col("least") == F.min("least").over(W.partitionBy("sha"))
    passed = F.col("n_null") + F.when(first, F.col("n_least")).otherwise(F.lit(0))
    split = per_text.withColumn("passed", passed).select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("mask"), F.col("passed").alias("n")),
            F.struct((F.col("mask") + F.lit(1 << 4)).alias("mask"), (F.col("n") - F.col("passed")).alias("n")))).alias("c"))
    n = F.col("c.n")
    return split.filter(n > 0).groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


def fold_cells(cells: DataFrame, filters: str = FILTERS, over: Sequence[str] | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley) from ``masks``' cells, for every order in
    ``over`` (all permutations), an array literal that goes to the tasks with
    the plan's broadcast."""
    listed = ", ".join(f"'{o}'" for o in (over or orders(filters)))
    fold = f"""flatten(transform(array({listed}), o -> aggregate(
        sequence(1, {len(filters)}),
        named_struct('ran', 0, 'steps', cast(array() as
            array<struct<filter_order:string,step:int,kept:bigint,removed:bigint,redundant:bigint,unique_fails:bigint,good_lost:bigint,toxic_lost:bigint>>)),
        (s, i) -> named_struct(
            'ran', s.ran | shiftleft(1, instr('{filters}', substr(o, i, 1)) - 1),
            'steps', array_append(s.steps, transform(array(shiftleft(1, instr('{filters}', substr(o, i, 1)) - 1)), b -> named_struct(
                'filter_order', o, 'step', i,
                'kept', if(mask & (s.ran | b) = 0, n, 0L),
                'removed', if(mask & s.ran = 0 and mask & b <> 0, n, 0L),
                'redundant', if(mask & s.ran <> 0 and mask & b <> 0, n, 0L),
                'unique_fails', if(mask = b, n, 0L),
                'good_lost', if(mask & s.ran = 0 and mask & b <> 0, good, 0L),
                'toxic_lost', if(mask & s.ran = 0 and mask & b <> 0, toxic, 0L)))[0])),
        s -> s.steps)))"""
    steps = cells.select("part", F.explode(F.expr(fold)).alias("s")).select("part", "s.*")
    summed = steps.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    return summed.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", letter)))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The whole audit: a row per part, order and step, zeros included; see
    ``masks`` for nulls and repeated rows.  No documents, no rows."""
    return fold_cells(masks(docs, labels, id_col, text_col, part_col))
