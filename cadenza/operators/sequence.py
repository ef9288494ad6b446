"""Operators over each listener's plays in time order.

Hot keys.  A plain ``Window.partitionBy(keys).orderBy(ts)`` sends all plays
of a key to one task; with ``keys=()`` (or a listener holding a third of the
data) that is the whole table in one task.  The ordered operators therefore
cut every key with more than ``hot_rows`` plays into time buckets of at most
about that many:

0. a map-side pre-aggregated count per key names the hot keys, at most
   ``MAX_HOT_KEYS`` of them (the largest; a key beyond has less than
   1 / ``MAX_HOT_KEYS`` of all plays).  Their plays alone are counted per
   minute, and each hot key takes the coarsest unit (year, month, day, hour,
   minute) of which no bucket exceeds ``hot_rows`` (plays of one minute stay
   together).  This bounded list is broadcast: it divides the plays into those
   of hot keys and the others, so that hot plays are never exchanged by their
   keys alone.  The others take the plain window;
1. within each (key, bucket) of a hot key the window gives ``lag`` for all but
   the first row;
2. a pre-aggregated summary of the hot plays keeps the last row of each
   bucket; ``lag`` over that summary (one row per bucket, small) is the carry,
   joined back on (key, bucket), already the partitioning of the windowed rows;
3. sessions of hot keys are cut inside buckets into fragments; only a bucket's
   first and last fragment are open, and these are merged in bucket order.

One lazy plan does this for all inputs and nothing runs while it is built;
where no key is hot, the list is empty and AQE prunes the whole hot branch.
The result equals the plain per-key window for any data and any split
(tested with every key split, ``hot_rows=0``, against brute force).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import constants as C
from cadenza.functions.expressions import micros_between, minus_ms
from cadenza.operators.keys import DEFAULT_KEYS, finish, prepare

# Total order of plays within a listener.
PLAY_ORDER = ("ts", "track", "artist", "ms_played", "play_id")
GAP_MICROS = C.SESSION_GAP_MINUTES * 60 * 1_000_000
BUCKET = "_bucket"


def _order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])


HOT_KEY_ROWS = 1_000_000  # plays a key, and then a time bucket of it, may bring to one task
#: Bucket units of hot keys, coarsest first.
UNITS = ("year", "month", "day", "hour", "minute")


MAX_HOT_KEYS = 10_000  # keys that are split; their list is broadcast


def hot_units(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS, hot_rows: int = HOT_KEY_ROWS,
              counts: DataFrame | None = None, unit: str | None = None) -> DataFrame:
    """``_unit`` for each key with more than ``hot_rows`` plays: ``unit``, or
    the coarsest one whose buckets hold at most ``hot_rows`` plays each; at
    most ``MAX_HOT_KEYS`` rows.
    ``counts`` (keys + ``total_plays``, e.g. the listener totals already
    computed) saves the counting scan over the plays."""
    d, ks = prepare(df, keys)
    if counts is None:
        counts = d.groupBy(*ks).agg(F.count(F.lit(1)).alias("total_plays"))
    # a null key stays whole: the joins on the list don't match it
    hot = counts.filter(F.col("total_plays") > hot_rows).dropna(subset=ks).orderBy(F.col("total_plays").desc(), *ks).limit(
        MAX_HOT_KEYS).select(*ks)
    if unit:
        return hot.select(*ks, F.lit(unit).alias("_unit"))
    fine = d.select(*ks, "ts").join(F.broadcast(hot), ks, "left_semi").groupBy(
        *ks, F.date_trunc(UNITS[-1], "ts").alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = fine.select(*ks, "_n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.date_trunc(u, "_m").alias("at")) for i, u in enumerate(UNITS)])).alias("_u"))
    most = sizes.groupBy(*ks, "_u.i", "_u.at").agg(F.sum("_n").alias("_n")).groupBy(*ks, "i").agg(F.max("_n").alias("_n"))
    fit = most.filter((F.col("_n") <= hot_rows) | (F.col("i") == len(UNITS) - 1)).groupBy(*ks).agg(F.min("i").alias("_i"))
    return fit.select(*ks, F.element_at(F.array(*map(F.lit, UNITS)), F.col("_i") + 1).alias("_unit"))


class Divided(NamedTuple):
    """Plays of hot keys, with their bucket, and all others (bucket null),
    the key columns, and the partitioning of hot plays."""

    hot: DataFrame
    cold: DataFrame
    ks: list[str]
    part: list[str]


def _divide(df: DataFrame, keys: Sequence[str], bucket: str | None, hot_rows: int | None,
            counts: DataFrame | None = None) -> Divided:
    """The bucket of a hot play is the start of its time unit
    (``hot_rows=0``: all keys are hot)."""
    d, ks = prepare(df, keys)
    units = F.broadcast(hot_units(d, ks, HOT_KEY_ROWS if hot_rows is None else hot_rows, counts, bucket))
    none = F.lit(None).cast("timestamp_ntz")
    at = none
    for u in UNITS:
        at = F.when(F.col("_unit") == u, F.date_trunc(u, "ts")).otherwise(at)
    return Divided(d.join(units, ks).withColumn(BUCKET, at).drop("_unit"),
                   d.join(units, ks, "left_anti").withColumn(BUCKET, none), ks, [*ks, BUCKET])


def _prev(o: Divided, cols: Sequence[str], order: Sequence[str], prev_col: str) -> DataFrame:
    row = F.struct(*[F.col(c) for c in cols])
    w = Window.partitionBy(*o.part).orderBy(*order)
    # summary: last row of every bucket of a hot key, pre-aggregated map-side
    last = o.hot.groupBy(*o.part).agg(F.max_by(row, _order_struct(order)).alias("_last"))
    carry = last.select(
        *o.part, F.lag("_last").over(Window.partitionBy(*o.ks).orderBy(BUCKET)).alias("_carry"))
    hot = (
        o.hot.withColumn("_rn", F.row_number().over(w)).withColumn("_lag", F.lag(row).over(w)).join(carry, o.part, "left")
        .withColumn(prev_col, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lag")))
        .drop("_rn", "_lag", "_carry"))
    return o.cold.withColumn(prev_col, F.lag(row).over(Window.partitionBy(*o.ks).orderBy(*order))).unionByName(hot)


def with_previous(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = DEFAULT_KEYS,
    order: Sequence[str] = PLAY_ORDER,
    bucket: str | None = None,
    prev_col: str = "prev",
    hot_rows: int | None = HOT_KEY_ROWS,
) -> DataFrame:
    """Add ``prev`` (struct of ``cols`` on the previous play of the same key, or
    null for the first play) plus the bucket column.  See the module doc."""
    o = _divide(df, keys, bucket, hot_rows)
    return finish(_prev(o, cols, order, prev_col), keys)


def gaps(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS, bucket: str | None = None,
         hot_rows: int | None = HOT_KEY_ROWS) -> DataFrame:
    """Previous artist / ts and the end-to-end gap in minutes."""
    d = with_previous(df, ["artist", "ts"], keys, bucket=bucket, hot_rows=hot_rows)
    return d.select(
        *[c for c in df.columns],
        F.col("prev.artist").alias("prev_artist"),
        F.col("prev.ts").alias("prev_ts"),
        (micros_between(F.col("prev.ts"), F.col("ts")) / F.lit(60_000_000.0)).alias("gap_min"),
    )


def _starts_session(prev_ts: Column, mode: str, gap_minutes: int) -> Column:
    """True if a play after one at ``prev_ts`` (null: none) opens a session."""
    if mode not in ("end_to_start", "end_to_end"):
        raise ValueError(mode)
    start = minus_ms("ts", "ms_played") if mode == "end_to_start" else F.col("ts")
    gap = micros_between(prev_ts, start)
    return prev_ts.isNull() | (gap > F.lit(gap_minutes * 60 * 1_000_000))


def session_flags(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS, mode: str = "end_to_start",
                  gap_minutes: int = C.SESSION_GAP_MINUTES, bucket: str | None = None,
                  hot_rows: int | None = HOT_KEY_ROWS) -> DataFrame:
    """Flag the first play of each session (``_new``).

    * ``end_to_start`` (W2a): new iff ``(ts - ms_played) - prev_ts > gap``
    * ``end_to_end`` (W2b): new iff ``ts - prev_ts > gap``
    """
    seq = with_previous(df, ["ts"], keys, bucket=bucket, hot_rows=hot_rows)
    return seq.withColumn("_new", _starts_session(F.col("prev.ts"), mode, gap_minutes)).drop("prev")


def session_ids(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS, mode: str = "end_to_start",
                gap_minutes: int = C.SESSION_GAP_MINUTES, bucket: str | None = None,
                hot_rows: int | None = HOT_KEY_ROWS) -> DataFrame:
    """Tag every play with ``session_start`` (order key of its session's
    first play), using the same bucket-and-carry scheme for the running
    "last session start"."""
    o = _divide(df, keys, bucket, hot_rows)
    d = _prev(o, ["ts"], PLAY_ORDER, "prev").withColumn(
        "_new", _starts_session(F.col("prev.ts"), mode, gap_minutes)).drop("prev")
    start_key = F.when(F.col("_new"), _order_struct(PLAY_ORDER))
    w = Window.partitionBy(*o.part).orderBy(*PLAY_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    # per bucket: latest session start inside it; carried to later buckets
    summary = d.filter(F.col(BUCKET).isNotNull()).groupBy(*o.part).agg(F.max(start_key).alias("_bmax"))
    carry = summary.select(
        *o.part,
        F.max("_bmax").over(
            Window.partitionBy(*o.ks).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        ).alias("_carry"))
    d = (
        d.withColumn("_run", F.max(start_key).over(w)).join(carry, o.part, "left")
        .withColumn("session_start", F.coalesce(F.col("_run"), F.col("_carry")))
        .drop("_run", "_carry", BUCKET)
    )
    return finish(d, keys)


def _fragments(plays: DataFrame, part: list[str], mode: str, gap_minutes: int) -> DataFrame:
    """Sessions as far as one part tells: one row per run of its plays without
    a session gap, with its own first play (``frag``), totals, whether it is
    the part's first (``head``) or last (``tail``), and ``from_ts``, where a
    head's first play counts as begun.

    Fragments are a mergeable state: one that is neither head nor tail is a
    closed session, the others are open (two a part at most)."""
    w = Window.partitionBy(*part).orderBy(*PLAY_ORDER)
    from_ts = minus_ms("ts", "ms_played") if mode == "end_to_start" else F.col("ts")
    rows = plays.select(*part, *PLAY_ORDER).withColumn("_prev", F.lag("ts").over(w)).withColumn(
        "_tail", F.lead(F.lit(1)).over(w).isNull())
    flagged = rows.withColumn("_new", _starts_session(F.col("_prev"), mode, gap_minutes))
    start = F.max(F.when(F.col("_new"), _order_struct(PLAY_ORDER))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # grouped within the window's partitioning: no further exchange of plays
    return flagged.withColumn("frag", start).groupBy(*part, "frag").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("plays"),
        F.sum("ms_played").alias("ms"), F.max(F.col("_prev").isNull()).alias("head"), F.max("_tail").alias("tail"),
        F.min(F.when(F.col("_prev").isNull(), from_ts)).alias("from_ts"))


def _merge_fragments(frags: DataFrame, ks: list[str], gap_minutes: int) -> DataFrame:
    """Fragments merged in bucket order: a head goes on with the fragment
    before it (the tail of the bucket before) unless a gap lies between.
    Only open fragments of a key meet; closed ones stay with their bucket."""
    place = F.when(~(F.col("head") | F.col("tail")), F.col(BUCKET))
    w = Window.partitionBy(*ks, "_place").orderBy("frag")
    gap = micros_between(F.lag("end_ts").over(w), F.col("from_ts"))
    goes_on = F.col("head") & (gap <= F.lit(gap_minutes * 60 * 1_000_000))
    chained = frags.withColumn("_place", place).withColumn("_goes_on", F.coalesce(goes_on, F.lit(False))).withColumn(
        "_session", F.max(F.when(~F.col("_goes_on"), F.col("frag"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return chained.groupBy(*ks, "_place", "_session").agg(
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"),
        F.sum("plays").alias("plays"), F.sum("ms").alias("ms"))


def _hot_sessions(o: Divided, mode: str, gap_minutes: int) -> DataFrame:
    return _merge_fragments(_fragments(o.hot, o.part, mode, gap_minutes), o.ks, gap_minutes)


def sessions(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS, mode: str = "end_to_start",
             gap_minutes: int = C.SESSION_GAP_MINUTES, bucket: str | None = None,
             hot_rows: int | None = HOT_KEY_ROWS) -> DataFrame:
    """One row per session: start, end, plays, ms.

    Both modes use the bucketed ordered pass, so a hot listener is spread over
    its time buckets; the plays are read and shuffled once.
    (:func:`sessions_by_window` is the ``session_window`` form of
    ``end_to_end`` for keys of a bounded size: simpler, but its final merge is
    partitioned by the keys only.)"""
    o = _divide(df, keys, bucket, hot_rows)
    cols = [*o.ks, "start_ts", "end_ts", "plays", "ms"]
    whole = _fragments(o.cold, o.ks, mode, gap_minutes)
    return finish(whole.select(*cols).unionByName(_hot_sessions(o, mode, gap_minutes).select(*cols)), keys)


def _session_stats(sess: DataFrame, keys: Sequence[str]) -> DataFrame:
    s, ks = prepare(sess, keys)
    out = s.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("sessions"),
        (F.sum("ms") / F.count(F.lit(1)) / F.lit(3_600_000.0)).alias("avg_session_hours"),
        (F.max("ms") / F.lit(3_600_000.0)).alias("max_session_hours"),
    )
    return finish(out, keys)


def sessions_by_window(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS,
                       gap_minutes: int = C.SESSION_GAP_MINUTES) -> DataFrame:
    """W2b with Spark's ``session_window``: events ``[ts, ts+gap)`` that touch
    or overlap merge, which is exactly "new iff ts - prev_ts > gap".  Sessions
    are merged map-side inside each partition before the shuffle; the final
    merge is partitioned by the keys only, so prefer :func:`sessions` when a
    single key can hold a large share of the plays."""
    d, ks = prepare(df, keys)
    out = d.groupBy(*ks, F.session_window("ts", f"{gap_minutes} minutes").alias("w")).agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count(F.lit(1)).alias("plays"),
        F.sum("ms_played").alias("ms"),
    ).drop("w")
    return finish(out, keys)


def session_stats(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS, mode: str = "end_to_start",
                  bucket: str | None = None, hot_rows: int | None = HOT_KEY_ROWS) -> DataFrame:
    """M25 + R1 input: session count, mean and longest session hours."""
    return _session_stats(sessions(df, keys, mode, bucket=bucket, hot_rows=hot_rows), keys)


def _pairs(seq: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    d, ks = prepare(seq, keys)
    out = d.filter(F.col("prev").isNotNull()).groupBy(
        *ks, *[F.col(f"prev.{c}").alias(f"prev_{c}") for c in cols], *cols
    ).agg(F.count(F.lit(1)).alias("n"))
    return finish(out, keys)


def consecutive_pairs(df: DataFrame, cols: Sequence[str] = ("track", "artist"),
                      keys: Sequence[str] = DEFAULT_KEYS, bucket: str | None = None,
                      hot_rows: int | None = HOT_KEY_ROWS) -> DataFrame:
    """Count of each (previous, current) pair of consecutive plays."""
    return _pairs(with_previous(df, list(cols), keys, bucket=bucket, hot_rows=hot_rows), cols, keys)


def _habit(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    p, ks = prepare(pairs, keys)
    rep = p.groupBy(*ks).agg(F.count_if(F.col("n") > 1).alias("repeated_pairs"),
                             F.sum("n").alias("all_pairs"))
    out = rep.select(
        *ks, "repeated_pairs", "all_pairs",
        F.coalesce(F.try_divide(F.lit(100.0) * F.col("repeated_pairs"), F.col("all_pairs")),
                   F.lit(0.0)).alias("habit_loop_score_pct"))
    return finish(out, keys)


def habit_loop(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS, bucket: str | None = None,
               hot_rows: int | None = HOT_KEY_ROWS) -> DataFrame:
    """100 * (distinct consecutive (track, artist) pairs seen more than
    once) / (plays - 1); no row for a key with fewer than two plays."""
    return _habit(consecutive_pairs(df, ("track", "artist"), keys, bucket, hot_rows), keys)


def _history_whole(d: DataFrame, ks: list[str], mode: str, gap_minutes: int) -> DataFrame:
    """:func:`history` of keys that each fit one task: pairs and sessions from
    one exchange of the plays.  A session's listening time stands at its last
    play (running sum less the sum before its first), so it rides along with
    the pair counts, which are grouped within the window's partitioning."""
    w = Window.partitionBy(*ks).orderBy(*PLAY_ORDER)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    ms = F.coalesce(F.col("ms_played"), F.lit(0))
    rows = d.select(*ks, *PLAY_ORDER).withColumn("_prev", F.lag(F.struct("track", "artist", "ts")).over(w)).withColumn(
        "_sum", F.sum(ms).over(so_far)).withColumn("_new", _starts_session(F.col("_prev.ts"), mode, gap_minutes))
    rows = rows.withColumn("_base", F.last(F.when(F.col("_new"), F.col("_sum") - ms), ignorenulls=True).over(so_far)).withColumn(
        "_ends", F.coalesce(F.lead("_new").over(w), F.lit(True)))
    pairs = rows.groupBy(*ks, F.col("_prev").isNull().alias("_first"), F.col("_prev.track").alias("_track"),
                         F.col("_prev.artist").alias("_artist"), "track", "artist").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_new").alias("sessions"), F.sum(ms).alias("ms"),
        F.max(F.when(F.col("_ends"), F.col("_sum") - F.col("_base"))).alias("most"))
    n = F.when(F.col("_first"), F.lit(0)).otherwise(F.col("n"))
    return pairs.groupBy(*ks).agg(
        F.count_if(n > 1).alias("repeated_pairs"), F.sum(n).alias("all_pairs"), F.sum("sessions").alias("sessions"),
        F.sum("ms").alias("_ms"), F.max("most").alias("_most"))


def _history_columns(sums: DataFrame, ks: list[str]) -> DataFrame:
    return sums.select(
        *ks, "repeated_pairs", "all_pairs",
        F.coalesce(F.try_divide(F.lit(100.0) * F.col("repeated_pairs"), F.col("all_pairs")),
                   F.lit(0.0)).alias("habit_loop_score_pct"),
        "sessions", (F.col("_ms") / F.col("sessions") / F.lit(3_600_000.0)).alias("avg_session_hours"),
        (F.col("_most") / F.lit(3_600_000.0)).alias("max_session_hours"))


def history(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS, mode: str = "end_to_start",
            gap_minutes: int = C.SESSION_GAP_MINUTES, bucket: str | None = None,
            hot_rows: int | None = HOT_KEY_ROWS, counts: DataFrame | None = None, none_hot: bool = False) -> DataFrame:
    """M21 + M25 in one row per key: ``repeated_pairs``, ``all_pairs``,
    ``habit_loop_score_pct``, ``sessions``, ``avg_session_hours``,
    ``max_session_hours``.  Nothing is written per play: keys that are not hot
    take one exchange of their plays; hot ones add up pair counts and merge
    session fragments of their buckets.  ``none_hot``: the caller knows that
    no key has more than ``hot_rows`` plays."""
    if none_hot:
        d, ks = prepare(df, keys)
        return finish(_history_columns(_history_whole(d, ks, mode, gap_minutes), ks), keys)
    o = _divide(df, keys, bucket, hot_rows, counts)
    ks = o.ks
    hot_only = o._replace(cold=o.cold.limit(0))
    pairs = _pairs(_prev(hot_only, ["track", "artist"], PLAY_ORDER, "prev"), ("track", "artist"), ks)
    habit = pairs.groupBy(*ks).agg(F.count_if(F.col("n") > 1).alias("repeated_pairs"), F.sum("n").alias("all_pairs"))
    sess = _hot_sessions(o, mode, gap_minutes).groupBy(*ks).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("ms").alias("_ms"), F.max("ms").alias("_most"))
    split = sess.join(habit, ks, "left").select(
        *ks, F.coalesce("repeated_pairs", F.lit(0)).alias("repeated_pairs"),
        F.coalesce("all_pairs", F.lit(0)).alias("all_pairs"), "sessions", "_ms", "_most")
    out = _history_whole(o.cold, ks, mode, gap_minutes).unionByName(split)
    return finish(_history_columns(out, ks), keys)


def transitions(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS, gap_minutes: int = C.SESSION_GAP_MINUTES,
                group_keys: Sequence[str] | None = None, bucket: str | None = None,
                hot_rows: int | None = HOT_KEY_ROWS) -> DataFrame:
    """G1: artist transition edges ``(src, dst, weight)``.

    Plays without a real artist are removed *before* pairing; consecutive
    plays of one key form an edge when their end-to-end gap is at most the
    session gap; self-loops are kept.  Edges are grouped by ``group_keys``
    (default: the same keys; ``()`` pools all listeners into one graph).
    """
    d = df.filter(F.col("artist") != C.UNKNOWN)
    d = with_previous(d, ["artist", "ts"], keys, bucket=bucket, hot_rows=hot_rows)
    gk = list(keys) if group_keys is None else list(group_keys)
    ok = F.col("prev").isNotNull() & (
        micros_between(F.col("prev.ts"), F.col("ts")) <= F.lit(gap_minutes * 60 * 1_000_000))
    return d.filter(ok).groupBy(*gk, F.col("prev.artist").alias("src"), F.col("artist").alias("dst")).agg(
        F.count(F.lit(1)).alias("weight"))


def yearly_growth(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Growth of listening hours vs the previous *present* year."""
    d, ks = prepare(df, keys)
    y = d.groupBy(*ks, "year").agg(F.sum("ms_played").alias("ms"), F.count(F.lit(1)).alias("plays"))
    w = Window.partitionBy(*ks).orderBy("year")  # one row per year: small per key
    y = y.withColumn("prev_ms", F.lag("ms").over(w))
    out = y.filter(F.col("prev_ms") > 0).select(
        *ks, "year",
        (F.lit(100.0) * (F.col("ms") - F.col("prev_ms")) / F.col("prev_ms")).alias("growth_pct"))
    return finish(out, keys)


def streaks(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Longest run of consecutive active days (gaps and islands)."""
    d, ks = prepare(df, keys)
    days = d.groupBy(*ks, F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*ks).orderBy("day")  # one row per active day
    isl = days.withColumn("_island", F.date_sub("day", F.row_number().over(w).cast("int")))
    runs = isl.groupBy(*ks, "_island").agg(F.count(F.lit(1)).alias("run"))
    out = runs.groupBy(*ks).agg(F.max("run").alias("longest_streak_days"),
                                F.count(F.lit(1)).alias("streaks"))
    return finish(out, keys)
