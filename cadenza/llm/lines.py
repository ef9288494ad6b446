"""Line dedup over overlapping three-line windows.  DataFrame functions only.

Each run of three consecutive lines is a window, told by two 64-bit hashes of
its text.  Windows that occur more than once in the corpus keep their first
occurrence (smallest doc_id, then smallest position); the lines under all
later occurrences are removed, overlapping windows merged.  Windows of blank
lines only don't count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.llm.common import if_small, lookup_join, written

WINDOW_LINES = 3


def window_rows(docs: DataFrame, id_col: str, text_col: str, k: int = WINDOW_LINES) -> DataFrame:
    """(doc_id, th, pos, h1, h2): th tells the text of the row, pos counts from 0."""
    lines = docs.filter(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"),
        F.split(F.col(text_col), "\n", -1).alias("lines")).filter(F.size("lines") >= k)
    shifted = F.arrays_zip(*[F.slice(F.col("lines"), i + 1, F.size("lines") - (k - 1)).alias(f"l{i}") for i in range(k)])
    hashed = F.transform(shifted, lambda z: _window_hash(F.concat_ws("\n", *[z[f"l{i}"] for i in range(k)])))
    return lines.select("doc_id", "th", F.posexplode(hashed).alias("pos", "w")).filter(F.col("w").isNotNull()).select(
        "doc_id", "th", "pos", F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"))


def _window_hash(w):
    blank = F.translate(w, " \t\r\n", "") == ""
    return F.when(~blank, F.struct(F.xxhash64(w).alias("h1"), F.xxhash64(F.lit("second"), w).alias("h2")))


def removed_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW_LINES) -> DataFrame:
    """(doc_id, th, starts): sorted starts of the later windows of each row."""
    rows = written(window_rows(docs, id_col, text_col, k), "windows")
    repeated = written(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
                       .filter(F.col("n") > 1), "repeated")
    hits = lookup_join(rows, repeated, ["h1", "h2"], "n").withColumn(
        "own", F.col("doc_id").eqNullSafe(F.col("first_id")))
    again = F.dense_rank().over(W.partitionBy("doc_id", "th", "h1", "h2").orderBy("pos")) > 1
    # one exchange by document serves the numbering and the gathering below
    later = hits.repartition("doc_id", "th").withColumn("again", again).filter(~F.col("own") | F.col("again"))
    return later.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def _deduped(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(row: struct of all columns of ``docs``, doc_id, n_lines, n_removed, text)."""
    found = written(removed_positions(docs, id_col, text_col, k), "removed").withColumnsRenamed(
        {"doc_id": "found_id", "th": "found_th"})
    found = if_small(found, found.agg(F.sum(F.size("starts") + 4)).first()[0] or 0)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("doc_id"),
                       docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("th"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("th") == F.col("found_th")), "left")
    text = F.col("text")
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + F.lit(k - 1))))))
    # one generated row each: the split lines are made once, not once per line kept
    cut = joined.select("row", "doc_id", "text", "starts", F.explode(F.array(F.struct(
        F.when(F.col("starts").isNotNull(), F.split(text, "\n", -1)).alias("lines"), covered.alias("covered")))).alias("cut"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("cut.lines") - 1), F.col("cut.covered"))
    return cut.select(
        "row", "doc_id", (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long").alias("n_lines"),
        F.when(F.col("starts").isNull(), 0).otherwise(F.size("cut.covered")).cast("long").alias("n_removed"),
        F.when(F.col("starts").isNull(), text).otherwise(
            F.array_join(F.transform(kept, lambda i: F.get("cut.lines", i)), "\n")).alias("text"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW_LINES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, text (without
    the lines under later windows).

    Lines are what line feeds separate, blank ones included.  Null texts stay
    null (and their count of lines), texts of fewer than three lines stay
    whole, a text all of whose lines go becomes empty.  Rows that share doc_id
    count as one document: each keeps its own first occurrence.  A null id
    comes after all others.  The lines of one document stay in one row."""
    return _deduped(docs, id_col, text_col, k).drop("row")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW_LINES,
               length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the text of ``line_report``, and ``length_col``, where
    the table has it, counting the text that is left."""
    new = {text_col: F.col("text")}
    if length_col in docs.columns:
        new[length_col] = F.length("text").cast(docs.schema[length_col].dataType)
    return _deduped(docs, id_col, text_col, k).select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
