"""Benchmark decontamination by spaced-seed hashing.  DataFrame functions only.

Texts become lower-case words (runs of letters and digits; a letter of a script
that is written without spaces is a word of its own).  Two fixed masks
of span 8 look at six of the eight positions; together they hit every aligned
stretch of 13 words with up to two substitutions (all 78 placements are
covered).  Seeds of all documents at every position join the seeds of all
benchmark items; a hit names a diagonal (document position - item position),
and along the diagonal the words are compared one by one.  An item leaks into
a document if some 13 consecutive positions of it agree in 11 or more.  Items
of 5 to 12 words are compared whole with one substitution per five words,
their seeds are the solid runs that this leaves (pigeonhole): one for each of
the equal pieces of the item, of which a copy keeps at least one.  Shorter
items are too little evidence and are not searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import if_small, text_hash, without_rows, written

#: Selected positions of each mask; all other positions are ignored.
MASKS = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))
SPAN = 8
STRETCH, SUBSTITUTIONS = 13, 2
MIN_ITEM_WORDS = 5
#: Thai, Lao, Burmese, Khmer, kana and Han: no spaces tell their words.
UNSPACED = r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\x{20000}-\x{3ffff}]"
#: Seeds (24 bytes each) and items up to these numbers are broadcast after
#: counting; beyond, both joins shuffle.
BROADCAST_SEEDS, BROADCAST_ITEM_WORDS = 1 << 18, 1 << 20
#: Item words (about) whose hits are compared in one row; a document with more
#: is dealt over several rows.
ROW_WORDS = 1 << 16


def words(text: Column) -> Column:
    low = F.lower(text)
    cut = F.when(low.rlike(UNSPACED), F.regexp_replace(low, f"({UNSPACED})", " $1 ")).otherwise(low)
    return F.array_remove(F.split(cut, r"[^\p{L}\p{N}]+"), "")


def unsearched(bench: DataFrame, text_col: str = "text") -> int:
    """Items that have words but too few to be searched."""
    return bench.filter(F.size(words(F.coalesce(F.col(text_col), F.lit("")))).between(1, MIN_ITEM_WORDS - 1)).count()


def _hashes(df: DataFrame, *keep: str) -> DataFrame:
    """Word hashes of the column ``text`` as ``h``, made once per row."""
    return df.select(*keep, F.explode(F.array(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))).alias("h"))


def _seeds(df: DataFrame, forms: list[tuple], *keep: str) -> DataFrame:
    """(keep, pos, seed): seeds of the forms (tag, offsets, condition on the
    row and the position)."""
    def at(i: Column, tag: int, offsets, holds) -> Column:
        fits = i + (offsets[-1] + 1) <= F.size("h")
        return F.when(fits if holds is None else fits & holds(i), F.xxhash64(F.lit(tag), *[F.get("h", i + o) for o in offsets]))

    every = F.transform(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.array(*[at(i, *form) for form in forms]))
    rows = df.filter(F.size("h") > 0).select(*keep, F.posexplode(every).alias("pos", "s"))
    return rows.select(*keep, "pos", F.explode("s").alias("seed")).filter(F.col("seed").isNotNull())


def _forms(lengths: list[int], masked: bool, of_items: bool) -> list[tuple]:
    """Forms of seeds: the masks, if an item has them, and solid runs of the
    given lengths.  Of items only those of a stretch or more have the masks,
    and a shorter one has its own length alone, once per piece."""
    n = F.col("n")
    masks = [(t, m, (lambda i: n >= STRETCH) if of_items else None) for t, m in enumerate(MASKS)] if masked else []
    return masks + [(100 + k, tuple(range(k)), (lambda i, k=k: (n < STRETCH) & (_piece(n) == k) & (i % k == 0) & (
        i <= k * _allowed(n))) if of_items else None) for k in lengths]


def _piece(n: Column) -> Column:
    """Words of a piece of a short item: one more piece than substitutions."""
    return F.floor(n / (_allowed(n) + 1)).cast("int")


def _item_seeds(items: DataFrame, lengths: list[int], masked: bool) -> DataFrame:
    return _seeds(_hashes(items, "item_id", "ih", "n"), _forms(lengths, masked, True), "item_id", "ih", "n").select(
        "item_id", "ih", "n", F.col("pos").alias("q"), "seed")


def _listed(hits: DataFrame, row_words: int) -> DataFrame:
    """(_id, _th, hits): the hits of a text, in lists of about ``row_words``
    item words at most; texts with more are counted, dealt by a hash."""
    many = written(hits.groupBy("doc_id", "th").agg(F.sum("n").alias("words")).filter(F.col("words") > row_words).select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.ceil(F.col("words") / row_words).alias("rows")), "many-hits")
    n = many.count()
    dealt = hits.withColumn("row", F.lit(0)) if not n else hits.join(
        if_small(many, 3 * n), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").withColumn(
        "row", F.coalesce(F.pmod(F.xxhash64("item_id", "ih", "diagonal"), F.col("rows")).cast("int"), F.lit(0)))
    return dealt.groupBy("doc_id", "th", "row").agg(F.collect_list(F.struct("item_id", "ih", "n", "diagonal")).alias("hits")).select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "hits")


def _allowed(n: Column) -> Column:
    return F.when(n >= STRETCH, SUBSTITUTIONS).otherwise(F.floor(n / 5).cast("int"))


def _leaks(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(doc_id, th, item_id, n, matched, best): the diagonals that pass; th
    tells the text of the row."""
    items = written(bench.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
                    .select("item_id", "text", F.xxhash64("text").alias("ih"), F.size(words(F.col("text"))).alias("n"))
                    .filter(F.col("n") >= MIN_ITEM_WORDS).distinct(), "items")
    n = F.col("n")
    lengths = sorted(r.k for r in items.filter(n < STRETCH).select(_piece(n).alias("k")).distinct().collect())   # at most STRETCH - 1 numbers
    size, most = items.agg(F.sum("n"), F.max("n")).first()
    size, masked = size or 0, (most or 0) >= STRETCH
    if not size:                                               # no items: some form, which nothing meets
        lengths = [MIN_ITEM_WORDS]
    item_seeds = _item_seeds(items, lengths, masked)
    if size * (len(MASKS) + len(lengths)) <= BROADCAST_SEEDS:
        item_seeds = F.broadcast(item_seeds)
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "th", text_hash(F.col("text")))
    doc_seeds = _seeds(_hashes(d, "doc_id", "th"), _forms(lengths, masked, False), "doc_id", "th")
    hits = written(doc_seeds.join(item_seeds, "seed").select(
        "doc_id", "th", "item_id", "ih", "n", (F.col("pos") - F.col("q")).alias("diagonal")).distinct(), "hits")
    per = if_small(_listed(hits, ROW_WORDS), 5 * hits.count())
    # a hit takes only the words beside its item along: from the diagonal's start, or the text's
    start = lambda g: F.greatest(g, F.lit(0))
    beside = F.transform("x.hits", lambda x: F.struct(
        x["item_id"].alias("_item"), x["ih"].alias("_ih"), x["diagonal"].alias("g"),
        F.slice("x.w", start(x["diagonal"]) + 1, F.greatest(x["diagonal"] + x["n"] - start(x["diagonal"]), F.lit(0))).alias("w")))
    hit = d.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select(
        "doc_id", "th", F.explode(F.array(F.struct(words(F.col("text")).alias("w"), "hits"))).alias("x")).select(
        "doc_id", "th", F.inline(beside))
    item_words = items.select("item_id", "ih", "n", words(F.col("text")).alias("iw"))
    if size <= BROADCAST_ITEM_WORDS:
        item_words = F.broadcast(item_words)
    on = F.col("_item").eqNullSafe(F.col("item_id")) & (F.col("_ih") == F.col("ih"))
    same = F.transform("iw", lambda w, j: F.when(F.get("w", j + F.col("g") - start(F.col("g"))) == w, 1).otherwise(0))
    lined = hit.join(item_words, on).select("doc_id", "th", "item_id", "n", F.explode(F.array(same)).alias("same"))
    starts = F.sequence(F.lit(0), F.greatest(n - STRETCH, F.lit(0)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    scored = lined.select(
        "doc_id", "th", "item_id", "n", total(F.col("same")).alias("matched"),
        F.array_max(F.transform(starts, lambda i: total(F.slice("same", i + 1, STRETCH)))).alias("best"))
    passes = F.when(n >= STRETCH, F.col("best") >= STRETCH - SUBSTITUTIONS).otherwise(F.col("matched") >= n - _allowed(n))
    return scored.filter(passes)


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, best, matched, item_words): the items that leak into
    documents; best = most agreeing words within 13 consecutive positions,
    matched = most agreeing words along one diagonal that passes.

    Null texts are empty and match nothing, as do empty tables.  Rows that
    share an id count as one document (or item).  Null ids are results like
    others.  Benchmark items with equal texts are all named."""
    return _leaks(docs, bench, id_col, text_col, item_col, item_text_col).groupBy("doc_id", "item_id").agg(
        F.max("best").alias("best"), F.max("matched").alias("matched"), F.max("n").alias("item_words"))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that an item leaks into, told by id and text."""
    found = _leaks(docs, bench, id_col, text_col, "item_id", "text")
    return without_rows(docs, found.select("doc_id", "th"), id_col, text_col)
