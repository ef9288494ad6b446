"""Aggregations over the play table.

All aggregations are plain ``groupBy`` hash aggregates, so Spark runs a
partial (map-side) aggregate before the shuffle: a listener holding a third of
all plays still sends only one partial row per task to the reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import constants as C
from cadenza.functions.expressions import hours, platform_category
from cadenza.operators.keys import DEFAULT_KEYS, finish, prepare
from cadenza.session import written

DAY_MICROS = 86_400_000_000


def _sum_if(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, value).otherwise(F.lit(0)))


def _totals_aggs(completed_reason: str = C.COMPLETED_REASON) -> list[Column]:
    ms = F.col("ms_played")
    skipped = F.col("skipped")
    album_real = F.col("album").isNotNull() & (F.length(F.trim(F.col("album"))) > 0)
    return [
        F.count(F.lit(1)).alias("total_plays"),
        F.sum(ms).alias("total_ms"),
        F.count_if(skipped).alias("skipped_plays"),
        F.count_if(F.lower(F.col("reason_end")) == completed_reason).alias("completed_plays"),
        F.count_if(F.col("shuffle")).alias("shuffle_plays"),
        _sum_if(F.col("offline"), ms).alias("offline_ms"),
        F.count_if(F.col("incognito_mode")).alias("incognito_plays"),
        F.count_if(skipped & (ms < C.EARLY_SKIP_MS)).alias("early_skips"),
        _sum_if(skipped, ms).alias("skipped_ms"),
        F.count_if(~skipped & (ms >= C.FOCUS_MS)).alias("focus_plays"),
        F.count_if(album_real).alias("album_plays"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    ]


TOTAL_COLUMNS = ("total_plays", "total_ms", "skipped_plays", "completed_plays", "shuffle_plays", "offline_ms",
                 "incognito_plays", "early_skips", "skipped_ms", "focus_plays", "album_plays", "first_ts", "last_ts")


#: Play columns that the totals are made from.
TOTAL_INPUTS = ("ts", "ms_played", "skipped", "reason_end", "shuffle", "offline", "incognito_mode", "album")


def _totals_derived(out: DataFrame) -> DataFrame:
    return out.select(
        "*",
        hours("total_ms").alias("total_hours"),
        (hours("total_ms") / 24).alias("day_equivalent"),
        F.greatest(F.lit(1).cast("bigint"),
                   F.expr(f"timestampdiff(MICROSECOND, first_ts, last_ts) div {DAY_MICROS}")).alias("calendar_days"),
        F.year("first_ts").alias("first_year"),
        F.year("last_ts").alias("last_year"),
    )


def totals(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS,
           completed_reason: str = C.COMPLETED_REASON) -> DataFrame:
    """Counts, sums and extremes of one listener in one pass."""
    d, ks = prepare(df, keys)
    out = _totals_derived(d.groupBy(*ks).agg(*_totals_aggs(completed_reason)))
    return finish(out, keys)


def listener_tables(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS,
                    completed_reason: str = C.COMPLETED_REASON, materialize: bool = False,
                    none_hot: bool = False) -> dict[str, DataFrame]:
    """A1/A2/A15 + A7–A11 from ONE scan and ONE shuffle.

    A GROUPING SETS aggregate over ``(keys)``, ``(keys, hour_utc)``,
    ``(keys, weekday)``, ``(keys, conn_country)``, ``(keys, platform_cat)``,
    ``(keys, year, month)``; every returned table is a filter of that single
    aggregate, so Spark computes (and shuffles) it once and reuses the
    exchange.  Returns ``totals``, ``hour``, ``weekday``, ``country``,
    ``platform``, ``month`` (the dimension tables carry ``plays``, ``ms``,
    ``skips``).

    Catalyst pushes each table's ``grouping_id`` filter below the aggregate
    and prunes the aggregate per consumer, which would give every consumer
    its own scan; ``materialize=True`` writes the aggregate once
    (:func:`written`) so all tables read that one result.

    A key's plays lie in many input splits, so partial aggregates of sparse
    dimensions (months) hardly shrink them, and the shuffle carries several wide
    rows a play.  ``none_hot`` (the caller knows that the plays of each key fit
    one task) sends each play once, by its key; all sets are grouped there."""
    d, ks = prepare(df, keys)
    d = d.withColumn("platform_cat", platform_category("platform"))
    dims = ["hour_utc", "weekday", "conn_country", "platform_cat", "year", "month"]
    sets = {"totals": [], "hour": ["hour_utc"], "weekday": ["weekday"], "country": ["conn_country"],
            "platform": ["platform_cat"], "month": ["year", "month"]}

    def gid(members: list[str]) -> int:
        return sum(1 << (len(dims) - 1 - i) for i, c in enumerate(dims) if c not in members)

    if none_hot:
        d = d.select(*ks, *dims, *TOTAL_INPUTS).repartition(*ks)
        types = dict(d.dtypes)
        places = F.array(*[F.struct(F.lit(gid(v)).alias("_gid"), *[
            (F.col(c) if c in v else F.lit(None).cast(types[c])).alias(c) for c in dims]) for v in sets.values()])
        # an explode keeps the partitioning, which the rows of GROUPING SETS lose
        d = d.withColumn("_place", F.explode(places)).select(*ks, *TOTAL_INPUTS, "_place.*")
        g = d.groupBy(*ks, "_gid", *dims).agg(*_totals_aggs(completed_reason))
    else:
        g = d.groupingSets([[*ks, *v] for v in sets.values()], *ks, *dims).agg(
            *_totals_aggs(completed_reason), F.grouping_id(*ks, *dims).alias("_gid"))
    if materialize:
        g = written(g, "listener-tables")

    out = {}
    for name, members in sets.items():
        t = g.filter(F.col("_gid") == gid(members))
        if name == "totals":
            out[name] = finish(_totals_derived(t.select(*ks, *TOTAL_COLUMNS)), keys)
        else:
            out[name] = finish(t.select(*ks, *members, F.col("total_plays").alias("plays"),
                                        F.col("total_ms").alias("ms"), F.col("skipped_plays").alias("skips")), keys)
    return out


def track_tables(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS,
                 materialize: bool = False, none_hot: bool = False) -> dict[str, DataFrame]:
    """A3/A4/A16/A17 from ONE scan: per (keys, track, artist) plays, ms,
    skips, first play; the artist table is rolled up from it (no re-scan).
    ``materialize=True`` writes both so their many consumers share one
    computation (see :func:`listener_tables`).  With ``none_hot`` the plays are
    exchanged once, by the keys, for both tables, and are written in the order
    of the keys: later aggregates per key find a key's rows in one task."""
    d, ks = prepare(df, keys)
    if none_hot:
        d = d.select(*ks, "track", "artist", "ms_played", "skipped", "ts").repartition(*ks)
    tracks = d.groupBy(*ks, "track", "artist").agg(
        F.count(F.lit(1)).alias("plays"), F.sum("ms_played").alias("ms"),
        F.count_if(F.col("skipped")).alias("skips"), F.min("ts").alias("first_ts"))
    if none_hot:
        w = Window.partitionBy(*ks, "artist")
        sums = [F.sum(c).over(w).alias(f"_{c}") for c in ("plays", "ms", "skips")]
        both = tracks.select("*", *sums, F.min("first_ts").over(w).alias("_first_ts"),
                             (F.row_number().over(w.orderBy("track")) == 1).alias("_one"))
        both = written(both, "tracks") if materialize else both
        tracks = both.select(*tracks.columns)
        artists = both.filter("_one").select(*ks, "artist", *[F.col(f"_{c}").alias(c) for c in ("plays", "ms", "skips", "first_ts")])
        return {"tracks": finish(tracks, keys), "artists": finish(artists, keys)}
    if materialize:
        tracks = written(tracks, "tracks")
    artists = tracks.groupBy(*ks, "artist").agg(
        F.sum("plays").alias("plays"), F.sum("ms").alias("ms"), F.sum("skips").alias("skips"),
        F.min("first_ts").alias("first_ts"))
    if materialize:
        artists = written(artists, "artists")
    return {"tracks": finish(tracks, keys), "artists": finish(artists, keys)}


def by_dimension(df: DataFrame, dims: Sequence[str | Column], keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Plays, ms and skips per (keys, dims)."""
    d, ks = prepare(df, keys)
    out = d.groupBy(*ks, *dims).agg(
        F.count(F.lit(1)).alias("plays"),
        F.sum("ms_played").alias("ms"),
        F.count_if(F.col("skipped")).alias("skips"),
    )
    return finish(out, keys)


def by_artist(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    return by_dimension(df, ["artist"], keys)


def by_track(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    return by_dimension(df, ["track", "artist"], keys)


def by_platform(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """A10: by platform category."""
    return by_dimension(df, [platform_category("platform").alias("platform_cat")], keys)


# Dimension sets computed together by all_dimensions.
DIMENSION_SETS = {
    "year": ["year"],
    "month": ["year", "month"],
    "hour": ["hour_utc"],
    "weekday": ["weekday"],
    "country": ["conn_country"],
    "platform": ["platform_cat"],
    "reason_start": ["reason_start"],
    "reason_end": ["reason_end"],
}


def all_dimensions(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS,
                   sets: Sequence[str] = tuple(DIMENSION_SETS)) -> DataFrame:
    """Every small dimension table in one scan via GROUPING SETS.

    Output is long: ``keys, dimension, year, month, hour_utc, weekday,
    conn_country, platform_cat, reason_start, reason_end, plays, ms, skips``
    with the columns that are not part of a row's dimension set null.
    """
    d, ks = prepare(df, keys)
    d = d.withColumn("platform_cat", platform_category("platform"))
    cols = sorted({c for s in sets for c in DIMENSION_SETS[s]},
                  key=lambda c: list(_ALL_DIM_COLS).index(c))
    gsets = [[*ks, *DIMENSION_SETS[s]] for s in sets]
    g = d.groupingSets(gsets, *ks, *cols).agg(
        F.count(F.lit(1)).alias("plays"),
        F.sum("ms_played").alias("ms"),
        F.count_if(F.col("skipped")).alias("skips"),
        F.grouping_id().alias("_gid"),
    )
    # name each grouping set from its grouping_id bitmask
    name = None
    for s in sets:
        gid = sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in DIMENSION_SETS[s])
        cond = F.col("_gid") == gid
        name = F.when(cond, F.lit(s)) if name is None else name.when(cond, F.lit(s))
    out = g.select(*ks, name.alias("dimension"), *cols, "plays", "ms", "skips")
    return finish(out, keys)


_ALL_DIM_COLS = ("year", "month", "hour_utc", "weekday", "conn_country", "platform_cat",
                 "reason_start", "reason_end")


def top_k(df: DataFrame, by: str, k: int, keys: Sequence[str] = DEFAULT_KEYS,
          tiebreak: Sequence[str] = (), rank_col: str = "rank") -> DataFrame:
    """The k rows with the largest ``by`` per key, ranked 1..k.

    ``row_number() <= k`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so only k rows per key and task travel.
    """
    d, ks = prepare(df, keys)
    w = Window.partitionBy(*ks).orderBy(F.col(by).desc(), *[F.col(c).asc() for c in tiebreak])
    out = d.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
    return finish(out, keys)


def top_artists(df: DataFrame, k: int = C.TOP_LIST_SIZE, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """T1 + M27: top artists by listening time, with hours and skip share."""
    t = top_k(by_artist(df, keys), "ms", k, keys, tiebreak=["artist"])
    return t.select(
        *keys, "rank", "artist", "plays", "ms", "skips",
        hours("ms").alias("hours"),
        (F.lit(100.0) * F.col("skips") / F.col("plays")).alias("skip_pct"),
    )


def top_songs(df: DataFrame, k: int = C.TOP_LIST_SIZE, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Top (track, artist) by listening time."""
    t = top_k(by_track(df, keys), "ms", k, keys, tiebreak=["track", "artist"])
    return t.select(*keys, "rank", "track", "artist", "plays", "ms", hours("ms").alias("hours"))


def first_listen(df: DataFrame, by: Sequence[str], keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """First play time per (keys, by)."""
    d, ks = prepare(df, keys)
    out = d.groupBy(*ks, *by).agg(F.min("ts").alias("first_ts"))
    return finish(out, keys)


def entropy(counts: DataFrame, count_col: str = "plays", keys: Sequence[str] = DEFAULT_KEYS,
            out_col: str = "entropy") -> DataFrame:
    """Shannon entropy (log2) of a count column per key.

    ``H = log2(N) - sum(c*log2 c)/N`` needs only one aggregation (no window
    over the key), so a hot key is pre-aggregated map-side.
    """
    d, ks = prepare(counts, keys)
    c = F.col(count_col).cast("double")
    agg = d.filter(F.col(count_col) > 0).groupBy(*ks).agg(
        F.sum(c).alias("_n"), F.sum(c * F.log2(c)).alias("_s"))
    out = agg.select(*ks, (F.log2("_n") - F.col("_s") / F.col("_n")).alias(out_col))
    return finish(out, keys)


def distinct_counts(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Distinct artists and distinct (track, artist), from one scan:
    tracks are counted per artist, then the artists."""
    d, ks = prepare(df, keys)
    per_artist = by_track(d, ks).groupBy(*ks, "artist").agg(F.count(F.lit(1)).alias("_n"))
    out = per_artist.groupBy(*ks).agg(F.sum("_n").alias("unique_tracks"), F.count(F.lit(1)).alias("unique_artists"))
    return finish(out, keys)


def argmax(table: DataFrame, dim: str, measure: str, keys: Sequence[str] = DEFAULT_KEYS,
           out_col: str | None = None) -> DataFrame:
    """The ``dim`` value with the largest ``measure`` per key (ties -> smallest)."""
    d, ks = prepare(table, keys)
    out = d.groupBy(*ks).agg(
        F.min_by(F.col(dim), F.struct((-F.col(measure)).alias("m"), F.col(dim).alias("d"))).alias(out_col or dim))
    return finish(out, keys)


def dominant_country(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Country with the most listening time (``'Unknown'`` takes part)."""
    return argmax(by_dimension(df, ["conn_country"], keys), "conn_country", "ms", keys,
                  out_col="dominant_country")


def known_countries(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Number of distinct countries other than the unknown marker."""
    d, ks = prepare(df, keys)
    per = d.filter(F.col("conn_country") != C.UNKNOWN).groupBy(*ks, "conn_country").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy(*ks).agg(F.count(F.lit(1)).alias("known_countries"))
    return finish(out, keys)


def peaks(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Peak UTC hour and busiest weekday (by ms), most active year (by
    plays) and top artist (by plays), ties to the smallest value."""
    d, ks = prepare(df, keys)
    dims = {"hour_utc": ("peak_hour_utc", "ms"), "weekday": ("busiest_weekday", "ms"),
            "year": ("most_active_year", "plays"), "artist": ("top_artist_by_plays", "plays")}
    # one scan: a grouping set per dimension, told apart by its grouping bits
    g = d.groupingSets([[*ks, c] for c in dims], *ks, *dims).agg(
        F.count(F.lit(1)).alias("plays"), F.sum("ms_played").alias("ms"), *[F.grouping(c).alias(f"_no_{c}") for c in dims])
    first = [F.min_by(F.col(c), F.when(F.col(f"_no_{c}") == 0, F.struct((-F.col(by)).alias("m"), F.col(c).alias("d")))).alias(name)
             for c, (name, by) in dims.items()]
    return finish(g.groupBy(*ks).agg(*first), keys)
