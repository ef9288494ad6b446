"""Behavioural metrics and the per-listener profile.

Every piece is a small aggregate keyed by ``keys``; the profile joins them on
the keys (all pieces are hash-partitioned on the keys, so the joins are
co-partitioned).  Ratios are a single final double division of exact
integers; nothing is rounded here (rounding is a report concern).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import constants as C
from cadenza.functions.expressions import hours, pct, ratio, tz_label, tz_offset
from cadenza.operators import aggregates as A
from cadenza.operators import sequence as S
from cadenza.operators.keys import DEFAULT_KEYS, finish, join_per_key, prepare
from cadenza.session import cut_lineage, written


def timezone(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """A18 + P11/P12 (J2): dominant country, its offset and label."""
    d, ks = prepare(df, keys)
    dom = A.dominant_country(d, ks)
    out = dom.select(*ks, "dominant_country",
                     tz_offset("dominant_country").alias("tz_offset")).withColumn(
        "timezone", tz_label("tz_offset"))
    return finish(out, keys)


def _local_hours(d: DataFrame, ks: list[str], tz: DataFrame) -> DataFrame:
    by_hour = A.by_dimension(d, ["hour_utc"], ks)
    return by_hour.join(tz.select(*ks, "tz_offset"), ks).withColumn(
        "local_hour", F.pmod(F.col("hour_utc") + F.col("tz_offset"), F.lit(24)))


def night_and_mobile(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS,
                     tz: DataFrame | None = None) -> DataFrame:
    """M13/M14 numerators: ms in local night hours, ms on mobile."""
    d, ks = prepare(df, keys)
    tz = tz if tz is not None else timezone(d, ks)
    night = _local_hours(d, ks, tz).groupBy(*ks).agg(
        F.sum(F.when(F.col("local_hour") < C.NIGHT_LOCAL_HOURS, F.col("ms")).otherwise(0)).alias("night_ms"))
    mobile = A.by_platform(d, ks).groupBy(*ks).agg(
        F.sum(F.when(F.col("platform_cat") == "Mobile", F.col("ms")).otherwise(0)).alias("mobile_ms"))
    return finish(night.join(mobile, ks, "full").fillna(0, ["night_ms", "mobile_ms"]), keys)


def circadian(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """M11 + J6: 24 local hours per key (hours listened), zero-filled.  One
    scan: listening per country gives the offset, and an array of 24 sums
    (one per UTC hour) is turned by it."""
    d, ks = prepare(df, keys)
    sums = [F.sum(F.when(F.col("hour_utc") == h, F.col("ms_played")).otherwise(0)).alias(f"_h{h}") for h in range(24)]
    per_country = d.groupBy(*ks, "conn_country").agg(F.sum("ms_played").alias("_ms"), *sums)
    per_key = per_country.groupBy(*ks).agg(
        F.min_by("conn_country", F.struct((-F.col("_ms")).alias("m"), F.col("conn_country").alias("d"))).alias("_country"),
        *[F.sum(f"_h{h}").alias(f"_h{h}") for h in range(24)])
    turned = per_key.select(*ks, tz_offset("_country").alias("_tz"), F.posexplode(F.array(*[f"_h{h}" for h in range(24)])).alias("_h", "_ms"))
    out = turned.select(*ks, F.pmod(F.col("_h") + F.col("_tz"), F.lit(24)).alias("local_hour"),
                        hours(F.coalesce(F.col("_ms"), F.lit(0))).alias("hours"))
    return finish(out, keys)


def weekday_profile(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """A9 + J6: hours per weekday (Mon=0), all 7 days present, in one scan."""
    d, ks = prepare(df, keys)
    per_key = d.groupBy(*ks).agg(*[
        F.sum(F.when(F.col("weekday") == i, F.col("ms_played")).otherwise(0)).alias(f"_d{i}") for i in range(7)])
    out = per_key.select(*ks, F.posexplode(F.array(*[f"_d{i}" for i in range(7)])).alias("weekday", "_ms")).select(
        *ks, "weekday", hours(F.coalesce(F.col("_ms"), F.lit(0))).alias("hours"))
    return finish(out, keys)


def novelty(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """M17 (A17 + A7 + J1): mean over months with plays of
    100 * (tracks first heard that month) / (plays that month)."""
    d, ks = prepare(df, keys)
    track = [*ks, "track", "artist"]
    # one scan: plays per track and month; a track is new in its first month
    monthly = d.groupBy(*track, "year", "month").agg(F.count(F.lit(1)).alias("_n"))
    first = F.min(F.struct("year", "month")).over(Window.partitionBy(*track)) == F.struct("year", "month")
    out = monthly.withColumn("_new", first).groupBy(*ks, "year", "month").agg(
        F.sum("_n").alias("plays"), F.count_if("_new").alias("_new"))
    new_tracks = F.when(F.col("_new") > 0, F.col("_new"))
    return finish(out.select(*ks, "year", "month", "plays", new_tracks.alias("new_tracks"),
                             pct("_new", "plays").alias("novelty_pct")), keys)


def novelty_rate(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    d, ks = prepare(df, keys)
    out = novelty(d, ks).groupBy(*ks).agg(F.avg("novelty_pct").alias("music_novelty_rate_pct"))
    return finish(out, keys)


def loyalty(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS, k: int = C.LOYALTY_TOP_ARTISTS) -> DataFrame:
    """M18 numerator: plays of the top-k artists by listening time."""
    d, ks = prepare(df, keys)
    top = A.top_k(A.by_artist(d, ks), "ms", k, ks, tiebreak=["artist"])
    out = top.groupBy(*ks).agg(F.sum("plays").alias("top_artist_plays"))
    return finish(out, keys)


def top_song(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """M19 numerator + R1 input: the top song's plays and hours."""
    d, ks = prepare(df, keys)
    top = A.top_k(A.by_track(d, ks), "ms", 1, ks, tiebreak=["track", "artist"])
    out = top.select(*ks, F.col("plays").alias("top_song_plays"), hours("ms").alias("top_song_hours"))
    return finish(out, keys)


def loyal_artists(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS,
                  days: int = C.LOYAL_ARTIST_DAYS, min_plays: int = C.LOYAL_ARTIST_MIN_PLAYS) -> DataFrame:
    """Artists first heard at least ``days`` before the last play and
    played at least ``min_plays`` times."""
    d, ks = prepare(df, keys)
    # the plays are read once: artists, written, also give the last play
    artists = cut_lineage(d.groupBy(*ks, "artist").agg(
        F.count(F.lit(1)).alias("plays"), F.min("ts").alias("first_ts"), F.max("ts").alias("_last")))
    last = artists.groupBy(*ks).agg(F.max("_last").alias("last_ts"))
    art = join_per_key(artists, last, ks, keys)
    since = F.expr(f"timestampdiff(MICROSECOND, first_ts, last_ts) div {A.DAY_MICROS}")
    out = art.groupBy(*ks).agg(
        F.count_if((since >= days) & (F.col("plays") >= min_plays)).alias("loyal_artists_5yr"))
    return finish(out, keys)


#: Play columns that the passes of a profile read.
PASS_COLUMNS = tuple(dict.fromkeys([*S.PLAY_ORDER, *A.TOTAL_INPUTS, "conn_country", "platform", "year", "month", "hour_utc", "weekday"]))


def profile_tables(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS,
                   session_mode: str = "end_to_start", bucket: str | None = None,
                   hot_rows: int | None = S.HOT_KEY_ROWS, materialize: bool = True) -> dict[str, DataFrame]:
    """The three passes over the plays that every profile / report piece is
    derived from: one GROUPING SETS aggregate (totals + hour / weekday /
    country / platform / month tables), one (track, artist) aggregate rolled
    up to artists, and one ordered pass (pairs + sessions, ``history``); plus
    the dominant-country time zone.  Keys column(s) included (``_all`` for
    ``()``).

    With ``materialize`` (default) the plays' columns are written once, so that
    the plan that makes them (a scan, cleaning, joins) runs once, and so are the
    aggregates: every later piece reads those compact results, and a lost
    executor does not replay them.  The written plays are counted per key;
    where no key is hot each pass exchanges them once, by the keys.  The
    ordered pass writes nothing per play; its one row per key is read once."""
    d, ks = prepare(df, keys)
    counts, none_hot = None, False
    if materialize:
        d = written(d.select(*ks, *[c for c in PASS_COLUMNS if c not in ks]), "plays")
        most = S.HOT_KEY_ROWS if hot_rows is None else hot_rows
        none_hot = d.groupBy(*ks).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).isEmpty()
    t = dict(A.listener_tables(d, ks, materialize=materialize, none_hot=none_hot))
    t.update(A.track_tables(d, ks, materialize=materialize, none_hot=none_hot))
    if materialize:  # plays per key are in the written totals: no extra scan
        counts = t["totals"].select(*ks, "total_plays")
    t["history"] = S.history(d, ks, session_mode, bucket=bucket, hot_rows=hot_rows, counts=counts, none_hot=none_hot)
    dom = A.argmax(t["country"], "conn_country", "ms", ks, "dominant_country")
    t["tz"] = dom.select(*ks, "dominant_country", tz_offset("dominant_country").alias("tz_offset")).withColumn(
        "timezone", tz_label("tz_offset"))
    t["_ks"] = ks  # type: ignore[assignment]
    return t


def local_hours(t: dict, keys: Sequence[str]) -> DataFrame:
    """M11 + J6 from the profile tables: 24 local hours per key, zero-filled."""
    ks = t["_ks"]
    lh = join_per_key(t["hour"], t["tz"].select(*ks, "tz_offset"), ks, keys).select(
        *ks, F.pmod(F.col("hour_utc") + F.col("tz_offset"), F.lit(24)).alias("local_hour"), "ms")
    grid = t["tz"].select(*ks, F.explode(F.sequence(F.lit(0), F.lit(23))).alias("local_hour"))
    return grid.join(lh, [*ks, "local_hour"], "left").select(
        *ks, "local_hour", hours(F.coalesce(F.col("ms"), F.lit(0))).alias("hours"))


def weekdays(t: dict) -> DataFrame:
    """A9 + J6 from the profile tables: hours per weekday, all 7 days."""
    ks = t["_ks"]
    grid = t["totals"].select(*ks, F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"))
    return grid.join(t["weekday"], [*ks, "weekday"], "left").select(
        *ks, "weekday", hours(F.coalesce(F.col("ms"), F.lit(0))).alias("hours"))


def years(t: dict) -> DataFrame:
    """A6 rolled up from the month table: plays, ms, hours per year."""
    ks = t["_ks"]
    return t["month"].groupBy(*ks, "year").agg(F.sum("plays").alias("plays"), F.sum("ms").alias("ms")).withColumn(
        "hours", hours("ms"))


def growth(t: dict) -> DataFrame:
    """W4/M10 from the year table."""
    ks = t["_ks"]
    y = years(t).withColumn("prev_ms", F.lag("ms").over(Window.partitionBy(*ks).orderBy("year")))
    return y.filter(F.col("prev_ms") > 0).select(
        *ks, "year", (F.lit(100.0) * (F.col("ms") - F.col("prev_ms")) / F.col("prev_ms")).alias("growth_pct"))


def user_profile(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS,
                 session_mode: str = "end_to_start", bucket: str | None = None,
                 hot_rows: int | None = S.HOT_KEY_ROWS, tables: dict | None = None) -> DataFrame:
    """One row per key with every metric (unrounded), assembled from
    :func:`profile_tables` by joins on the keys."""
    t = tables or profile_tables(df, keys, session_mode, bucket, hot_rows)
    ks = t["_ks"]
    tracks, artists = t["tracks"], t["artists"]
    tz = t["tz"]
    night = join_per_key(t["hour"], tz.select(*ks, "tz_offset"), ks, keys).groupBy(*ks).agg(
        F.sum(F.when(F.pmod(F.col("hour_utc") + F.col("tz_offset"), F.lit(24)) < C.NIGHT_LOCAL_HOURS,
                     F.col("ms")).otherwise(0)).alias("night_ms"))
    mobile = t["platform"].groupBy(*ks).agg(
        F.sum(F.when(F.col("platform_cat") == "Mobile", F.col("ms")).otherwise(0)).alias("mobile_ms"))
    countries = t["country"].groupBy(*ks).agg(
        F.count_if(F.col("conn_country") != C.UNKNOWN).alias("known_countries"))
    new_m = tracks.groupBy(*ks, F.year("first_ts").alias("year"), F.month("first_ts").alias("month")).agg(
        F.count(F.lit(1)).alias("new_tracks"))
    nov = t["month"].join(new_m, [*ks, "year", "month"], "left").groupBy(*ks).agg(
        F.avg(pct(F.coalesce(F.col("new_tracks"), F.lit(0)), F.col("plays"))).alias("music_novelty_rate_pct"))
    # one aggregate over tracks: distinct tracks + top song (ms desc, then
    # track, artist asc: the same order as the top-k lists)
    track_stats = tracks.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("unique_tracks"),
        F.min_by(F.struct("plays", "ms"),
                 F.struct((-F.col("ms")).alias("m"), F.col("track"), F.col("artist"))).alias("_top"),
    ).select(*ks, "unique_tracks", F.col("_top.plays").alias("top_song_plays"),
             hours(F.col("_top.ms")).alias("top_song_hours"))
    # one aggregate over artists: distinct artists, entropy sums
    c = F.col("plays").cast("double")
    artist_stats = artists.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("unique_artists"),
        F.sum(c).alias("_n"), F.sum(c * F.log2(c)).alias("_s"),
    ).select(*ks, "unique_artists", (F.log2("_n") - F.col("_s") / F.col("_n")).alias("artist_diversity_entropy"))
    # loyal artists: only those with plays enough meet the last play of their key
    since = F.expr(f"timestampdiff(MICROSECOND, first_ts, last_ts) div {A.DAY_MICROS}")
    often = artists.filter(F.col("plays") >= C.LOYAL_ARTIST_MIN_PLAYS).select(*ks, "first_ts")
    steady = join_per_key(often, t["totals"].select(*ks, "last_ts"), ks, keys).groupBy(*ks).agg(
        F.count_if(since >= C.LOYAL_ARTIST_DAYS).alias("loyal_artists_5yr"))
    loyal = A.top_k(artists, "ms", C.LOYALTY_TOP_ARTISTS, ks, tiebreak=["artist"]).groupBy(*ks).agg(
        F.sum("plays").alias("top_artist_plays"))
    parts = [track_stats, artist_stats, steady, tz, night, mobile, nov, loyal,
             t["history"].drop("repeated_pairs", "all_pairs"), countries]
    p = t["totals"]
    for part in parts:
        p = p.join(part, ks, "left")
    return finish(_profile_columns(p, ks), keys)


def _profile_columns(p: DataFrame, ks: list[str]) -> DataFrame:
    n = F.col("total_plays")
    return p.select(
        *ks,
        "total_plays", "total_ms", "total_hours", "day_equivalent",
        "completed_plays", "skipped_plays",
        F.coalesce("sessions", F.lit(0)).alias("sessions"),
        F.coalesce("avg_session_hours", F.lit(0.0)).alias("avg_session_hours"),
        F.coalesce("max_session_hours", F.lit(0.0)).alias("max_session_hours"),
        pct("shuffle_plays", n).alias("shuffle_pct"),
        hours("offline_ms").alias("offline_hours"),
        pct("offline_ms", "total_ms").alias("offline_ratio_pct"),
        "incognito_plays", "calendar_days", "first_year", "last_year", "first_ts", "last_ts",
        F.coalesce("unique_artists", F.lit(0)).alias("unique_artists"),
        F.coalesce("unique_tracks", F.lit(0)).alias("unique_tracks"),
        pct("skipped_plays", n).alias("impatience_score_pct"),
        pct("completed_plays", n).alias("completion_rate_pct"),
        (F.col("total_ms").cast("double") / 1000 / n).alias("avg_listen_sec"),
        F.least(F.lit(1.0), F.col("total_ms").cast("double") / 1000 / n / C.AVG_TRACK_SECONDS).alias(
            "avg_listening_ratio"),
        pct(F.coalesce("unique_tracks", F.lit(0)), n).alias("exploration_score"),
        F.coalesce("artist_diversity_entropy", F.lit(0.0)).alias("artist_diversity_entropy"),
        ratio(F.col("skipped_ms").cast("double") / 1000,
              F.lit(C.AVG_TRACK_SECONDS) * F.col("skipped_plays")).alias("skip_latency_ratio"),
        pct("early_skips", "skipped_plays").alias("early_skip_rate_pct"),
        (F.col("total_hours") / F.col("calendar_days")).alias("listening_intensity_h_per_day"),
        "dominant_country", "tz_offset", "timezone",
        pct(F.coalesce("night_ms", F.lit(0)), "total_ms").alias("night_listening_ratio_pct"),
        pct(F.coalesce("mobile_ms", F.lit(0)), "total_ms").alias("mobile_usage_ratio_pct"),
        pct("album_plays", n).alias("album_listening_ratio_pct"),
        pct("focus_plays", n).alias("focus_session_score_pct"),
        F.coalesce("music_novelty_rate_pct", F.lit(0.0)).alias("music_novelty_rate_pct"),
        pct(F.coalesce("top_artist_plays", F.lit(0)), n).alias("artist_loyalty_score_pct"),
        pct(F.coalesce("top_song_plays", F.lit(0)), n).alias("song_replay_density_pct"),
        ratio("skipped_plays", "sessions").alias("listening_fragmentation_index"),
        F.coalesce("habit_loop_score_pct", F.lit(0.0)).alias("habit_loop_score_pct"),
        F.coalesce("top_song_hours", F.lit(0.0)).alias("top_song_hours"),
        F.coalesce("known_countries", F.lit(0)).alias("known_countries"),
        F.coalesce("loyal_artists_5yr", F.lit(0)).alias("loyal_artists_5yr"),
    )


def user_vector(profile: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """The 15 metric columns in fixed order, null -> 0.0."""
    return profile.select(
        *keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in C.METRIC_KEYS])
