"""Registered queries: one Spark plan per operator of the inventory, each
paired (where SQL can express it) with an equivalent DuckDB query over the
same parquet tables.

Names start with the inventory id.  Every query reads the given tables (via
the fixture views) and runs the library operators on them, so its work grows
with the tables.  Columns whose value depends on floating-point summation
order (entropy, means of ratios, PageRank) are rounded to 9 digits on both
sides; integer ratios are one double division on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import constants as C
from cadenza.functions.expressions import platform_category, platform_label, tz_label, tz_offset
from cadenza.operators import aggregates as A
from cadenza.operators import metrics as M
from cadenza.operators import sequence as S
from cadenza.plans.oracle import (
    hours_sql,
    pct_sql,
    platform_category_sql,
    platform_label_sql,
    tz_label_sql,
    tz_offset_sql,
    with_plays,
)
from cadenza.sources import fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}

U = ("user_id",)
ALL: tuple[str, ...] = ()


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _events(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.plays(spark, d, "plays_events")


def _lineitem(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.plays(spark, d, "plays_lineitem")


def _r9(c: str) -> F.Column:
    return F.round(F.col(c), 9).alias(c)


# ---------------------------------------------------------------- P: cleaning
PLAY_COLS_SQL = ("user_id, play_id, ts, ms_played, track, artist, album, skipped, shuffle, offline, "
                 "incognito_mode, reason_start, reason_end, conn_country, platform, year, month, hour_utc, weekday")

register("P1_P8_clean_plays_events", with_plays(f"SELECT {PLAY_COLS_SQL} FROM plays"))(
    lambda spark, d: _events(spark, d))
register("P1_P8_clean_plays_lineitem", with_plays(f"SELECT {PLAY_COLS_SQL} FROM plays", "plays_lineitem"))(
    lambda spark, d: _lineitem(spark, d))


@register("P9_P10_platform_categories", with_plays(
    f"SELECT platform, {platform_category_sql()} AS platform_cat, {platform_label_sql()} AS platform_label, "
    "count(*) AS plays FROM plays GROUP BY ALL"))
def q_platforms(spark, d):
    p = _events(spark, d)
    return p.groupBy("platform", platform_category("platform").alias("platform_cat"),
                     platform_label("platform").alias("platform_label")).agg(F.count(F.lit(1)).alias("plays"))


@register("P11_P12_country_offsets", with_plays(
    f"SELECT conn_country, {tz_offset_sql('conn_country')} AS tz_offset, "
    f"{tz_label_sql(tz_offset_sql('conn_country'))} AS timezone, count(*) AS plays FROM plays GROUP BY ALL"))
def q_offsets(spark, d):
    p = _events(spark, d)
    return p.groupBy("conn_country", tz_offset("conn_country").alias("tz_offset"),
                     tz_label(tz_offset("conn_country")).alias("timezone")).agg(F.count(F.lit(1)).alias("plays"))


# ------------------------------------------------------------ A: aggregates
def _totals_sql(key: str) -> str:
    return f"""SELECT {key}, count(*) AS total_plays, CAST(sum(ms_played) AS BIGINT) AS total_ms,
  count(*) FILTER (WHERE skipped) AS skipped_plays,
  count(*) FILTER (WHERE lower(reason_end) = 'endplay') AS completed_plays,
  count(*) FILTER (WHERE shuffle) AS shuffle_plays,
  CAST(sum(CASE WHEN offline THEN ms_played ELSE 0 END) AS BIGINT) AS offline_ms,
  count(*) FILTER (WHERE incognito_mode) AS incognito_plays,
  count(*) FILTER (WHERE skipped AND ms_played < 30000) AS early_skips,
  CAST(sum(CASE WHEN skipped THEN ms_played ELSE 0 END) AS BIGINT) AS skipped_ms,
  count(*) FILTER (WHERE NOT skipped AND ms_played >= 240000) AS focus_plays,
  count(*) FILTER (WHERE album IS NOT NULL AND length(trim(album)) > 0) AS album_plays,
  min(ts) AS first_ts, max(ts) AS last_ts,
  {hours_sql('sum(ms_played)')} AS total_hours,
  {hours_sql('sum(ms_played)')} / 24 AS day_equivalent,
  greatest(1, date_diff('microsecond', min(ts), max(ts)) // 86400000000) AS calendar_days,
  CAST(year(min(ts)) AS INTEGER) AS first_year, CAST(year(max(ts)) AS INTEGER) AS last_year
FROM plays GROUP BY {key}"""


register("A1_A2_A15_totals_events", with_plays(_totals_sql("user_id")))(
    lambda spark, d: A.totals(_events(spark, d), U))
register("A1_A2_A15_totals_lineitem", with_plays(_totals_sql("user_id"), "plays_lineitem"))(
    lambda spark, d: A.totals(_lineitem(spark, d), U))
register("A1_A2_A15_totals_events_all",
         with_plays(_totals_sql("grp").replace("SELECT grp, ", "SELECT ").replace("GROUP BY grp", "")))(
    lambda spark, d: A.totals(_events(spark, d), ALL))


def _dim_sql(dims: str, name: str = "plays_events", key: str = "user_id, ", src: str = "plays") -> str:
    return with_plays(
        f"SELECT {key}{dims}, count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS ms, "
        f"count(*) FILTER (WHERE skipped) AS skips FROM {src} GROUP BY ALL", name)


register("A3_by_artist", _dim_sql("artist"))(lambda spark, d: A.by_artist(_events(spark, d), U))
register("A3_by_artist_lineitem", _dim_sql("artist", "plays_lineitem"))(
    lambda spark, d: A.by_artist(_lineitem(spark, d), U))
register("A4_by_track", _dim_sql("track, artist"))(lambda spark, d: A.by_track(_events(spark, d), U))
register("A4_by_track_all", _dim_sql("track, artist", key=""))(
    lambda spark, d: A.by_track(_events(spark, d), ALL))
register("A5_by_album", _dim_sql("album, artist"))(
    lambda spark, d: A.by_dimension(_events(spark, d), ["album", "artist"], U))
register("A6_by_year", _dim_sql("year", "plays_lineitem"))(
    lambda spark, d: A.by_dimension(_lineitem(spark, d), ["year"], U))
register("A7_by_year_month", _dim_sql("year, month", "plays_lineitem"))(
    lambda spark, d: A.by_dimension(_lineitem(spark, d), ["year", "month"], U))
register("A8_by_hour", _dim_sql("hour_utc"))(
    lambda spark, d: A.by_dimension(_events(spark, d), ["hour_utc"], U))
register("A9_by_weekday", _dim_sql("weekday"))(
    lambda spark, d: A.by_dimension(_events(spark, d), ["weekday"], U))
register("A10_by_platform", _dim_sql(f"{platform_category_sql()} AS platform_cat"))(
    lambda spark, d: A.by_platform(_events(spark, d), U))
register("A11_by_country", _dim_sql("conn_country", key=""))(
    lambda spark, d: A.by_dimension(_events(spark, d), ["conn_country"], ALL))
register("A12_by_reason_start", _dim_sql("reason_start"))(
    lambda spark, d: A.by_dimension(_events(spark, d), ["reason_start"], U))
register("A13_by_reason_end", _dim_sql("reason_end", key=""))(
    lambda spark, d: A.by_dimension(_events(spark, d), ["reason_end"], ALL))


@register("A14_distinct_counts", with_plays(
    "SELECT user_id, count(DISTINCT (track, artist)) AS unique_tracks, count(DISTINCT artist) AS unique_artists "
    "FROM plays GROUP BY user_id"))
def q_distinct(spark, d):
    return A.distinct_counts(_events(spark, d), U)


register("A16_first_listen_artist", with_plays(
    "SELECT user_id, artist, min(ts) AS first_ts FROM plays GROUP BY ALL", "plays_lineitem"))(
    lambda spark, d: A.first_listen(_lineitem(spark, d), ["artist"], U))


@register("A17_first_listen_track_month", with_plays(
    "SELECT user_id, CAST(year(first_ts) AS INTEGER) AS year, CAST(month(first_ts) AS INTEGER) AS month, "
    "count(*) AS new_tracks FROM (SELECT user_id, track, artist, min(ts) AS first_ts FROM plays GROUP BY ALL) "
    "GROUP BY ALL", "plays_lineitem"))
def q_first_track(spark, d):
    f = A.first_listen(_lineitem(spark, d), ["track", "artist"], U)
    return f.groupBy("user_id", F.year("first_ts").alias("year"), F.month("first_ts").alias("month")).agg(
        F.count(F.lit(1)).alias("new_tracks"))


_DOMINANT_SQL = """SELECT user_id, conn_country AS dominant_country FROM (
  SELECT user_id, conn_country, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, conn_country) AS rn
  FROM (SELECT user_id, conn_country, sum(ms_played) AS ms FROM plays GROUP BY ALL)) WHERE rn = 1"""
register("A18_dominant_country", with_plays(_DOMINANT_SQL))(
    lambda spark, d: A.dominant_country(_events(spark, d), U))


@register("A19_artist_entropy", with_plays(
    "SELECT user_id, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 9) AS entropy FROM "
    "(SELECT user_id, artist, CAST(count(*) AS DOUBLE) AS c FROM plays GROUP BY ALL) GROUP BY user_id",
    "plays_lineitem"))
def q_entropy(spark, d):
    e = A.entropy(A.by_artist(_lineitem(spark, d), U), "plays", U)
    return e.select("user_id", _r9("entropy"))


@register("A19_artist_entropy_all", with_plays(
    "SELECT round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 9) AS entropy FROM "
    "(SELECT artist, CAST(count(*) AS DOUBLE) AS c FROM plays GROUP BY ALL)"))
def q_entropy_all(spark, d):
    e = A.entropy(A.by_artist(_events(spark, d), ALL), "plays", ALL)
    return e.select(_r9("entropy"))


_DIMS_SQL = f"""SELECT user_id, dimension, year, month, hour_utc, weekday, conn_country, platform_cat,
  reason_start, reason_end, count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS ms,
  count(*) FILTER (WHERE skipped) AS skips
FROM (SELECT *, {platform_category_sql()} AS platform_cat FROM plays) AS x,
  (VALUES ('year'), ('month'), ('hour'), ('weekday'), ('country'), ('platform'), ('reason_start'), ('reason_end')) AS s(dimension)
GROUP BY user_id, dimension,
  CASE WHEN dimension IN ('year', 'month') THEN year END,
  CASE WHEN dimension = 'month' THEN month END,
  CASE WHEN dimension = 'hour' THEN hour_utc END,
  CASE WHEN dimension = 'weekday' THEN weekday END,
  CASE WHEN dimension = 'country' THEN conn_country END,
  CASE WHEN dimension = 'platform' THEN platform_cat END,
  CASE WHEN dimension = 'reason_start' THEN reason_start END,
  CASE WHEN dimension = 'reason_end' THEN reason_end END"""
_DIMS_SQL = _DIMS_SQL.replace(
    "SELECT user_id, dimension, year, month, hour_utc, weekday, conn_country, platform_cat,\n  reason_start, reason_end,",
    "SELECT user_id, dimension, CASE WHEN dimension IN ('year', 'month') THEN year END AS year, "
    "CASE WHEN dimension = 'month' THEN month END AS month, CASE WHEN dimension = 'hour' THEN hour_utc END AS hour_utc, "
    "CASE WHEN dimension = 'weekday' THEN weekday END AS weekday, "
    "CASE WHEN dimension = 'country' THEN conn_country END AS conn_country, "
    "CASE WHEN dimension = 'platform' THEN platform_cat END AS platform_cat, "
    "CASE WHEN dimension = 'reason_start' THEN reason_start END AS reason_start, "
    "CASE WHEN dimension = 'reason_end' THEN reason_end END AS reason_end,")
register("A20_all_dimensions", with_plays(_DIMS_SQL))(
    lambda spark, d: A.all_dimensions(_events(spark, d), U))

register("A24_U3_known_countries", with_plays(
    "SELECT count(DISTINCT conn_country) AS known_countries FROM plays WHERE conn_country <> 'Unknown'"))(
    lambda spark, d: A.known_countries(_events(spark, d), ALL))


def _argmax_sql(dim: str, measure: str, out: str, key: str = "user_id") -> str:
    agg = "sum(ms_played)" if measure == "ms" else "count(*)"
    return (f"SELECT {key}, {dim} AS {out} FROM (SELECT {key}, {dim}, row_number() OVER "
            f"(PARTITION BY {key} ORDER BY m DESC, {dim}) AS rn FROM (SELECT {key}, {dim}, {agg} AS m "
            f"FROM plays GROUP BY ALL)) WHERE rn = 1")


register("A25_peaks", with_plays(
    "SELECT h.user_id, peak_hour_utc, busiest_weekday, most_active_year, top_artist_by_plays FROM h "
    "JOIN w USING (user_id) JOIN y USING (user_id) JOIN a USING (user_id)", "plays_events",
    f"h AS ({_argmax_sql('hour_utc', 'ms', 'peak_hour_utc')}), w AS ({_argmax_sql('weekday', 'ms', 'busiest_weekday')}), "
    f"y AS ({_argmax_sql('year', 'plays', 'most_active_year')}), a AS ({_argmax_sql('artist', 'plays', 'top_artist_by_plays')})"))(
    lambda spark, d: A.peaks(_events(spark, d), U))


# --------------------------------------------------------------- T: top-k
def _top_artists_sql(key: str, name: str, k: int = 20) -> str:
    part = f"PARTITION BY {key} " if key else ""
    sel = f"{key}, " if key else ""
    return with_plays(
        f"SELECT {sel}rank, artist, plays, ms, skips, {hours_sql('ms')} AS hours, "
        f"CAST(100 AS DOUBLE) * skips / plays AS skip_pct FROM (SELECT *, CAST(row_number() OVER ({part}ORDER BY ms DESC, artist) AS INTEGER) AS rank "
        f"FROM (SELECT {sel}artist, count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS ms, "
        f"count(*) FILTER (WHERE skipped) AS skips FROM plays GROUP BY ALL)) WHERE rank <= {k}", name)


register("T1_M27_top_artists_all", _top_artists_sql("", "plays_events"))(
    lambda spark, d: A.top_artists(_events(spark, d), 20, ALL))
register("T1_M27_top_artists", _top_artists_sql("user_id", "plays_lineitem"))(
    lambda spark, d: A.top_artists(_lineitem(spark, d), 20, U))


def _top_songs_sql(key: str, name: str, k: int = 20) -> str:
    part = f"PARTITION BY {key} " if key else ""
    sel = f"{key}, " if key else ""
    return with_plays(
        f"SELECT {sel}rank, track, artist, plays, ms, {hours_sql('ms')} AS hours FROM (SELECT *, CAST(row_number() OVER "
        f"({part}ORDER BY ms DESC, track, artist) AS INTEGER) AS rank FROM (SELECT {sel}track, artist, count(*) AS plays, "
        f"CAST(sum(ms_played) AS BIGINT) AS ms FROM plays GROUP BY ALL)) WHERE rank <= {k}", name)


register("T2_top_songs_all", _top_songs_sql("", "plays_events"))(
    lambda spark, d: A.top_songs(_events(spark, d), 20, ALL))
register("T2_top_songs", _top_songs_sql("user_id", "plays_lineitem"))(
    lambda spark, d: A.top_songs(_lineitem(spark, d), 20, U))


# ------------------------------------------------------- W: sequences
_ORDER_SQL = "ts, track, artist, ms_played, play_id NULLS FIRST"


def _seq_sql(key: str) -> str:
    part = f"PARTITION BY {key} " if key else ""
    return f"WINDOW w AS ({part}ORDER BY {_ORDER_SQL})"


register("W1_gaps", with_plays(
    "SELECT user_id, play_id, ts, artist, lag(artist) OVER w AS prev_artist, lag(ts) OVER w AS prev_ts, "
    "CAST(date_diff('microsecond', lag(ts) OVER w, ts) AS DOUBLE) / 60000000 AS gap_min FROM plays " + _seq_sql("user_id")))(
    lambda spark, d: S.gaps(_events(spark, d), U).select(
        "user_id", "play_id", "ts", "artist", "prev_artist", "prev_ts", "gap_min"))


def _sessions_sql(key: str, mode: str) -> str:
    start = "ts - to_milliseconds(ms_played)" if mode == "end_to_start" else "ts"
    sel = f"{key}, " if key else ""
    part = f"PARTITION BY {key} " if key else ""
    return f"""SELECT {sel}min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS ms
FROM (SELECT *, sum(new) OVER ({part}ORDER BY {_ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS sid
  FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL
      OR date_diff('microsecond', lag(ts) OVER w, {start}) > 1800000000 THEN 1 ELSE 0 END AS new
    FROM plays {_seq_sql(key)}))
GROUP BY {sel}sid"""


register("W2a_A22_sessions_end_to_start", with_plays(_sessions_sql("user_id", "end_to_start")))(
    lambda spark, d: S.sessions(_events(spark, d), U, "end_to_start"))
register("W2a_A22_sessions_end_to_start_all", with_plays(_sessions_sql("", "end_to_start")))(
    lambda spark, d: S.sessions(_events(spark, d), ALL, "end_to_start"))
register("W2b_A22_sessions_end_to_end", with_plays(_sessions_sql("user_id", "end_to_end")))(
    lambda spark, d: S.sessions(_events(spark, d), U, "end_to_end"))
register("W2b_A22_sessions_end_to_end_all", with_plays(_sessions_sql("", "end_to_end")))(
    lambda spark, d: S.sessions(_events(spark, d), ALL, "end_to_end"))
register("W2a_sessions_split_by_day", with_plays(_sessions_sql("user_id", "end_to_start")))(
    lambda spark, d: S.sessions(_events(spark, d), U, "end_to_start", hot_rows=0))
register("W2a_sessions_split_by_hour_all", with_plays(_sessions_sql("", "end_to_start")))(
    lambda spark, d: S.sessions(_events(spark, d), ALL, "end_to_start", bucket="hour", hot_rows=0))
register("W2b_session_window", with_plays(_sessions_sql("user_id", "end_to_end")))(
    lambda spark, d: S.sessions_by_window(_events(spark, d), U))


def _pairs_sql(key: str) -> str:
    sel = f"{key}, " if key else ""
    return (f"SELECT {sel}prev_track, prev_artist, track, artist, count(*) AS n FROM (SELECT *, "
            f"lag(track) OVER w AS prev_track, lag(artist) OVER w AS prev_artist, row_number() OVER w AS rn "
            f"FROM plays {_seq_sql(key)}) WHERE rn > 1 GROUP BY ALL")


register("W3_consecutive_pairs", with_plays(_pairs_sql("user_id")))(
    lambda spark, d: S.consecutive_pairs(_events(spark, d), ("track", "artist"), U))
register("W3_consecutive_pairs_all", with_plays(_pairs_sql("")))(
    lambda spark, d: S.consecutive_pairs(_events(spark, d), ("track", "artist"), ALL))
register("W3_consecutive_pairs_split_by_day", with_plays(_pairs_sql("user_id")))(
    lambda spark, d: S.consecutive_pairs(_events(spark, d), ("track", "artist"), U, hot_rows=0))


def _habit_sql(key: str, name: str) -> str:
    sel = f"{key}, " if key else ""
    grp = f"GROUP BY {key}" if key else ""
    return with_plays(
        f"SELECT {sel}count(*) FILTER (WHERE n > 1) AS repeated_pairs, CAST(sum(n) AS BIGINT) AS all_pairs, "
        f"{pct_sql('count(*) FILTER (WHERE n > 1)', 'sum(n)')} AS habit_loop_score_pct FROM ({_pairs_sql(key)}) {grp}", name)


register("M21_habit_loop_all", _habit_sql("", "plays_events"))(
    lambda spark, d: S.habit_loop(_events(spark, d), ALL))
register("M21_habit_loop_lineitem", _habit_sql("user_id", "plays_lineitem"))(
    lambda spark, d: S.habit_loop(_lineitem(spark, d), U))


register("W4_M10_yearly_growth", with_plays(
    "SELECT user_id, year, CAST(100 AS DOUBLE) * (ms - prev_ms) / prev_ms AS growth_pct FROM ("
    "SELECT user_id, year, ms, lag(ms) OVER (PARTITION BY user_id ORDER BY year) AS prev_ms FROM "
    "(SELECT user_id, year, sum(ms_played) AS ms FROM plays GROUP BY ALL)) WHERE prev_ms > 0", "plays_lineitem"))(
    lambda spark, d: S.yearly_growth(_lineitem(spark, d), U))


register("W8_longest_streak", with_plays(
    "SELECT user_id, max(run) AS longest_streak_days, count(*) AS streaks FROM (SELECT user_id, isl, count(*) AS run FROM "
    "(SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS isl FROM "
    "(SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM plays)) GROUP BY ALL) GROUP BY user_id", "plays_lineitem"))(
    lambda spark, d: S.streaks(_lineitem(spark, d), U))


# --------------------------------------------------- M: metrics & profile
def _profile_sql(key: str | None, name: str) -> str:
    """DuckDB twin of metrics.user_profile (keys = [key] or whole input)."""
    k = key or "grp"
    src = "plays" if key else "(SELECT 0 AS grp, * FROM plays)"
    tot = _totals_sql(k).replace("FROM plays", f"FROM {src} AS s0")
    ctes = f"""p AS (SELECT * FROM {src} AS s1),
t AS ({tot}),
art AS (SELECT {k}, artist, count(*) AS plays, sum(ms_played) AS ms FROM p GROUP BY ALL),
trk AS (SELECT {k}, track, artist, count(*) AS plays, sum(ms_played) AS ms FROM p GROUP BY ALL),
dc AS (SELECT {k}, count(*) AS unique_tracks FROM trk GROUP BY ALL),
da AS (SELECT {k}, count(*) AS unique_artists,
  log2(sum(CAST(plays AS DOUBLE))) - sum(CAST(plays AS DOUBLE) * log2(CAST(plays AS DOUBLE))) / sum(CAST(plays AS DOUBLE)) AS ent
  FROM art GROUP BY ALL),
dom AS (SELECT {k}, conn_country AS dominant_country, {tz_offset_sql('conn_country')} AS tz_offset FROM (
  SELECT {k}, conn_country, row_number() OVER (PARTITION BY {k} ORDER BY ms DESC, conn_country) AS rn
  FROM (SELECT {k}, conn_country, sum(ms_played) AS ms FROM p GROUP BY ALL)) WHERE rn = 1),
nm AS (SELECT p.{k}, sum(CASE WHEN ((hour_utc + tz_offset) % 24 + 24) % 24 < 6 THEN ms_played ELSE 0 END) AS night_ms,
  sum(CASE WHEN {platform_category_sql()} = 'Mobile' THEN ms_played ELSE 0 END) AS mobile_ms
  FROM p JOIN dom USING ({k}) GROUP BY ALL),
ft AS (SELECT {k}, year(first_ts) AS y, month(first_ts) AS m, count(*) AS new_tracks
  FROM (SELECT {k}, track, artist, min(ts) AS first_ts FROM p GROUP BY ALL) GROUP BY ALL),
pm AS (SELECT {k}, year AS y, month AS m, count(*) AS plays FROM p GROUP BY ALL),
nov AS (SELECT pm.{k}, avg(CAST(100 AS DOUBLE) * coalesce(new_tracks, 0) / plays) AS novelty
  FROM pm LEFT JOIN ft USING ({k}, y, m) GROUP BY ALL),
loy AS (SELECT {k}, sum(plays) AS top_artist_plays FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY ms DESC, artist) AS rn FROM art) WHERE rn <= 10 GROUP BY ALL),
ts1 AS (SELECT {k}, plays AS top_song_plays, {hours_sql('ms')} AS top_song_hours FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY ms DESC, track, artist) AS rn FROM trk) WHERE rn = 1),
pr AS (SELECT {k}, prev_track, prev_artist, track, artist, count(*) AS n FROM (SELECT *,
  lag(track) OVER w AS prev_track, lag(artist) OVER w AS prev_artist, row_number() OVER w AS rn FROM p {_seq_sql(k)}) WHERE rn > 1 GROUP BY ALL),
hab AS (SELECT {k}, {pct_sql('count(*) FILTER (WHERE n > 1)', 'sum(n)')} AS habit FROM pr GROUP BY ALL),
ses AS (SELECT {k}, sid, sum(ms_played) AS ms FROM (SELECT *, sum(new) OVER (PARTITION BY {k} ORDER BY {_ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS sid
  FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR date_diff('microsecond', lag(ts) OVER w, ts - to_milliseconds(ms_played)) > 1800000000
  THEN 1 ELSE 0 END AS new FROM p {_seq_sql(k)})) GROUP BY ALL),
sst AS (SELECT {k}, count(*) AS sessions, CAST(sum(ms) AS DOUBLE) / count(*) / 3600000.0 AS avg_session_hours,
  CAST(max(ms) AS DOUBLE) / 3600000.0 AS max_session_hours FROM ses GROUP BY ALL),
kc AS (SELECT {k}, count(DISTINCT conn_country) FILTER (WHERE conn_country <> 'Unknown') AS known_countries FROM p GROUP BY ALL),
la AS (SELECT a.{k}, count(*) FILTER (WHERE date_diff('microsecond', f.first_ts, t.last_ts) // 86400000000 >= 1825 AND a.plays >= 20) AS loyal
  FROM art a JOIN (SELECT {k}, artist, min(ts) AS first_ts FROM p GROUP BY ALL) f USING ({k}, artist) JOIN t USING ({k}) GROUP BY ALL)"""
    sel_key = f"{k}, " if key else ""
    body = f"""SELECT {sel_key}total_plays, total_ms, total_hours, day_equivalent, completed_plays, skipped_plays,
  coalesce(sessions, 0) AS sessions, coalesce(avg_session_hours, 0.0) AS avg_session_hours,
  coalesce(max_session_hours, 0.0) AS max_session_hours,
  {pct_sql('shuffle_plays', 'total_plays')} AS shuffle_pct,
  {hours_sql('offline_ms')} AS offline_hours,
  {pct_sql('offline_ms', 'total_ms')} AS offline_ratio_pct,
  incognito_plays, calendar_days, first_year, last_year, first_ts, last_ts,
  coalesce(unique_artists, 0) AS unique_artists, coalesce(unique_tracks, 0) AS unique_tracks,
  {pct_sql('skipped_plays', 'total_plays')} AS impatience_score_pct,
  {pct_sql('completed_plays', 'total_plays')} AS completion_rate_pct,
  CAST(total_ms AS DOUBLE) / 1000 / total_plays AS avg_listen_sec,
  least(1.0, CAST(total_ms AS DOUBLE) / 1000 / total_plays / 210) AS avg_listening_ratio,
  {pct_sql('coalesce(unique_tracks, 0)', 'total_plays')} AS exploration_score,
  round(coalesce(ent, 0.0), 9) AS artist_diversity_entropy,
  coalesce((CAST(skipped_ms AS DOUBLE) / 1000) / nullif(210 * skipped_plays, 0), 0.0) AS skip_latency_ratio,
  {pct_sql('early_skips', 'skipped_plays')} AS early_skip_rate_pct,
  total_hours / calendar_days AS listening_intensity_h_per_day,
  dominant_country, tz_offset, {tz_label_sql('tz_offset')} AS timezone,
  {pct_sql('coalesce(night_ms, 0)', 'total_ms')} AS night_listening_ratio_pct,
  {pct_sql('coalesce(mobile_ms, 0)', 'total_ms')} AS mobile_usage_ratio_pct,
  {pct_sql('album_plays', 'total_plays')} AS album_listening_ratio_pct,
  {pct_sql('focus_plays', 'total_plays')} AS focus_session_score_pct,
  round(coalesce(novelty, 0.0), 9) AS music_novelty_rate_pct,
  {pct_sql('coalesce(top_artist_plays, 0)', 'total_plays')} AS artist_loyalty_score_pct,
  {pct_sql('coalesce(top_song_plays, 0)', 'total_plays')} AS song_replay_density_pct,
  coalesce(CAST(skipped_plays AS DOUBLE) / nullif(sessions, 0), 0.0) AS listening_fragmentation_index,
  coalesce(habit, 0.0) AS habit_loop_score_pct,
  coalesce(top_song_hours, 0.0) AS top_song_hours,
  coalesce(known_countries, 0) AS known_countries,
  coalesce(loyal, 0) AS loyal_artists_5yr
FROM t LEFT JOIN dc USING ({k}) LEFT JOIN da USING ({k}) LEFT JOIN dom USING ({k}) LEFT JOIN nm USING ({k})
  LEFT JOIN nov USING ({k}) LEFT JOIN loy USING ({k}) LEFT JOIN ts1 USING ({k}) LEFT JOIN hab USING ({k})
  LEFT JOIN sst USING ({k}) LEFT JOIN kc USING ({k}) LEFT JOIN la USING ({k})"""
    return with_plays(body, name, ctes)


def _profile_spark(df: DataFrame, keys, **kw) -> DataFrame:
    p = M.user_profile(df, keys, **kw)
    return p.select(*[_r9(c) if c in ("artist_diversity_entropy", "music_novelty_rate_pct") else F.col(c)
                      for c in p.columns])


register("M1_M28_profile_events", _profile_sql("user_id", "plays_events"))(
    lambda spark, d: _profile_spark(_events(spark, d), U))
register("M1_M28_profile_events_all", _profile_sql(None, "plays_events"))(
    lambda spark, d: _profile_spark(_events(spark, d), ALL))
register("M1_M28_profile_lineitem", _profile_sql("user_id", "plays_lineitem"))(
    lambda spark, d: _profile_spark(_lineitem(spark, d), U))
register("M1_M28_profile_lineitem_all", _profile_sql(None, "plays_lineitem"))(
    lambda spark, d: _profile_spark(_lineitem(spark, d), ALL))
register("M1_M28_profile_events_split_by_day", _profile_sql("user_id", "plays_events"))(
    lambda spark, d: _profile_spark(_events(spark, d), U, hot_rows=0))


register("M1_M28_profile_events_all_split", _profile_sql(None, "plays_events"))(
    lambda spark, d: _profile_spark(_events(spark, d), ALL, hot_rows=1000))


register("M11_J6_circadian", with_plays(
    f"""SELECT g.user_id, g.local_hour, {hours_sql('coalesce(ms, 0)')} AS hours FROM
 (SELECT user_id, tz_offset, CAST(unnest(range(0, 24)) AS INTEGER) AS local_hour FROM dom) g
 LEFT JOIN (SELECT p.user_id, CAST(((hour_utc + tz_offset) % 24 + 24) % 24 AS INTEGER) AS local_hour, sum(ms_played) AS ms
   FROM plays p JOIN dom USING (user_id) GROUP BY ALL) h ON g.user_id = h.user_id AND g.local_hour = h.local_hour""",
    "plays_events",
    f"dom AS (SELECT user_id, {tz_offset_sql('dominant_country')} AS tz_offset FROM ({_DOMINANT_SQL}))"))(
    lambda spark, d: M.circadian(_events(spark, d), U))


register("A9_J6_weekday_profile", with_plays(
    f"""SELECT g.user_id, g.weekday, {hours_sql('coalesce(ms, 0)')} AS hours FROM
 (SELECT DISTINCT user_id, CAST(unnest(range(0, 7)) AS INTEGER) AS weekday FROM plays) g
 LEFT JOIN (SELECT user_id, weekday, sum(ms_played) AS ms FROM plays GROUP BY ALL) h USING (user_id, weekday)""",
    "plays_lineitem"))(
    lambda spark, d: M.weekday_profile(_lineitem(spark, d), U))


register("M17_J1_monthly_novelty", with_plays(
    """SELECT pm.user_id, pm.year, pm.month, pm.plays, ft.new_tracks,
  CAST(100 AS DOUBLE) * coalesce(ft.new_tracks, 0) / pm.plays AS novelty_pct
FROM (SELECT user_id, year, month, count(*) AS plays FROM plays GROUP BY ALL) pm
LEFT JOIN (SELECT user_id, CAST(year(first_ts) AS INTEGER) AS year, CAST(month(first_ts) AS INTEGER) AS month, count(*) AS new_tracks
  FROM (SELECT user_id, track, artist, min(ts) AS first_ts FROM plays GROUP BY ALL) GROUP BY ALL) ft
USING (user_id, year, month)""", "plays_lineitem"))(
    lambda spark, d: M.novelty(_lineitem(spark, d), U))



# ------------------------------------------------------------ R: rule layers
from cadenza.operators import rules as R  # noqa: E402
from cadenza.operators.rules import DISPLAY_DIGITS  # noqa: E402


def _disp_sql(prof_sql: str, key: str = "user_id") -> str:
    cols = ", ".join(f"round_even({c}, {d}) AS {c}" for c, d in DISPLAY_DIGITS.items())
    return (f"SELECT {key}, total_hours, max_session_hours, top_song_hours, unique_artists, loyal_artists_5yr, "
            f"incognito_plays, known_countries, total_plays, {cols} FROM ({prof_sql}) AS prof")


def _first_rule_sql(rules, default: str) -> str:
    whens = " ".join(f"WHEN coalesce({c}, false) THEN '{n}'" for c, n in rules)
    return f"CASE {whens} ELSE '{default}' END"


_EARNED_SQL = " + ".join(f"CAST(coalesce({cond}, false) AS INTEGER)" for _, _, cond in C.BADGES)
_PROFILE_EVENTS = _profile_sql("user_id", "plays_events")
_PROFILE_LINEITEM = _profile_sql("user_id", "plays_lineitem")


def _badge_text_sql(badge: str) -> str:
    text, column, digits = C.BADGE_DESCRIPTIONS[badge]
    if column is None:
        return f"'{text}'"
    before, after = text.split("{}")
    shown = f"format('{{:,}}', {column})" if digits == "," else f"format('{{:.{digits}f}}', round_even(CAST({column} AS DOUBLE), {digits}))"
    return f"'{before}' || {shown} || '{after}'"


def _badges_sql(prof: str) -> str:
    parts = [f"SELECT user_id, {i} AS badge_order, '{bid}' AS badge, '{name}' AS name, {_badge_text_sql(bid)} AS description, "
             f"coalesce({cond}, false) AS earned FROM disp" for i, (bid, name, cond) in enumerate(C.BADGES)]
    return f"WITH disp AS ({_disp_sql(prof)})\n" + "\nUNION ALL\n".join(parts)


def _levels_sql(prof: str) -> str:
    lv = " ".join(f"WHEN total_hours >= {t} THEN {l}" for t, _, l in reversed(C.LEVELS))
    tt = " ".join(f"WHEN total_hours >= {t} THEN '{n}'" for t, n, _ in reversed(C.LEVELS))
    nx = " ".join(f"WHEN total_hours < {t} THEN {t}" for t, _, _ in C.LEVELS)
    return (f"WITH disp AS ({_disp_sql(prof)}), b AS (SELECT user_id, total_hours, {_EARNED_SQL} AS badges_earned FROM disp)\n"
            f"SELECT user_id, badges_earned, {len(C.BADGES)} AS badges_total, "
            f"CASE {lv} ELSE {C.LEVEL_BELOW_FIRST[1]} END AS level, CASE {tt} ELSE '{C.LEVEL_BELOW_FIRST[0]}' END AS title, "
            f"CASE {nx} END AS next_threshold_hours, "
            f"CAST(floor(total_hours * {C.XP_PER_HOUR} + badges_earned * {C.XP_PER_BADGE}) AS BIGINT) AS xp FROM b")


def _archetype_sql(prof: str) -> str:
    texts = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.ARCHETYPE_DESCRIPTIONS.items())
    return (f"WITH disp AS ({_disp_sql(prof)}) SELECT user_id, archetype, CASE archetype {texts} END AS archetype_description "
            f"FROM (SELECT user_id, {_first_rule_sql(C.ARCHETYPES, C.ARCHETYPE_DEFAULT)} AS archetype FROM disp)")


def _radar_sql(prof: str) -> str:
    cols = []
    for name, metric, factor, capped in C.RADAR_AXES:
        v = f"(CAST(100 AS DOUBLE) - {metric})" if factor is None else f"({metric} * CAST({factor} AS DOUBLE))"
        if capped:
            v = f"least({v}, CAST(100 AS DOUBLE))"
        cols.append(f"round_even({v}, 1) AS {name}")
    return f"WITH disp AS ({_disp_sql(prof)}) SELECT user_id, {', '.join(cols)} FROM disp"


def _prof_events(spark, d):
    return _profile_spark(_events(spark, d), U)


def _prof_lineitem(spark, d):
    return _profile_spark(_lineitem(spark, d), U)


register("R1_badges", _badges_sql(_PROFILE_EVENTS))(lambda spark, d: R.badges(_prof_events(spark, d), U))
register("R1_badges_lineitem", _badges_sql(_PROFILE_LINEITEM))(
    lambda spark, d: R.badges(_prof_lineitem(spark, d), U))
register("R2_R3_R4_levels", _levels_sql(_PROFILE_EVENTS))(lambda spark, d: R.levels(_prof_events(spark, d), U))
register("R5_archetype", _archetype_sql(_PROFILE_EVENTS))(lambda spark, d: R.archetype(_prof_events(spark, d), U))
register("R5_archetype_lineitem", _archetype_sql(_PROFILE_LINEITEM))(
    lambda spark, d: R.archetype(_prof_lineitem(spark, d), U))
register("R6_radar", _radar_sql(_PROFILE_EVENTS))(lambda spark, d: R.radar(_prof_events(spark, d), U))
register("R7_loyal_artists", with_plays(
    "SELECT a.user_id, count(*) FILTER (WHERE date_diff('microsecond', f.first_ts, l.last_ts) // 86400000000 >= 1825 "
    "AND a.plays >= 20) AS loyal_artists_5yr FROM (SELECT user_id, artist, count(*) AS plays FROM plays GROUP BY ALL) a "
    "JOIN (SELECT user_id, artist, min(ts) AS first_ts FROM plays GROUP BY ALL) f USING (user_id, artist) "
    "JOIN (SELECT user_id, max(ts) AS last_ts FROM plays GROUP BY ALL) l USING (user_id) GROUP BY ALL",
    "plays_lineitem"))(lambda spark, d: M.loyal_artists(_lineitem(spark, d), U))


# ------------------------------------------- S8 / W6 / W7 / J7 / A21: pool
from cadenza.operators import percentiles as PC  # noqa: E402
from cadenza.session import cut_lineage  # noqa: E402
from cadenza.sources import pool as POOL  # noqa: E402

_VEC_COLS = ", ".join(C.METRIC_KEYS)


def _vectors_sql(prof: str) -> str:
    return f"SELECT user_id, {_VEC_COLS} FROM ({prof}) AS v"


def _pool_events(spark, d):
    return M.user_vector(_prof_events(spark, d), U)


def _pctl_sql() -> str:
    return (f"WITH pool AS ({_vectors_sql(_PROFILE_EVENTS)}), "
            f"long AS (UNPIVOT pool ON {_VEC_COLS} INTO NAME metric VALUE value)\n"
            "SELECT user_id, metric, value, CASE WHEN count(*) OVER (PARTITION BY metric) < 2 THEN 50.0 "
            "ELSE CAST(100 AS DOUBLE) * (rank() OVER (PARTITION BY metric ORDER BY value) - 1) "
            "/ count(*) OVER (PARTITION BY metric) END AS percentile FROM long")


register("W6_percentiles", _pctl_sql())(lambda spark, d: PC.percentiles(_pool_events(spark, d), U))


def _labels_sql() -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.METRIC_LABEL_SUFFIX.items())
    return (f"SELECT user_id, metric, concat('%', CAST(CAST(round_even(round_even(percentile, 1), 0) AS BIGINT) AS VARCHAR), "
            f"' ', CASE metric {cases} END) AS label FROM ({_pctl_sql()}) AS p")


register("W7_percentile_labels", _labels_sql())(
    lambda spark, d: PC.percentile_labels(PC.percentiles(_pool_events(spark, d), U), U))


def _against_sql() -> str:
    return (f"WITH pool AS ({_vectors_sql(_PROFILE_EVENTS)}), users AS ({_vectors_sql(_PROFILE_LINEITEM)}), "
            f"pl AS (UNPIVOT pool ON {_VEC_COLS} INTO NAME metric VALUE value), "
            f"ul AS (UNPIVOT users ON {_VEC_COLS} INTO NAME metric VALUE value), "
            "n AS (SELECT count(*) AS n FROM pool)\n"
            "SELECT user_id, metric, value, CASE WHEN (SELECT n FROM n) < 2 THEN 50.0 ELSE CAST(100 AS DOUBLE) * "
            "(SELECT count(*) FROM pl WHERE pl.metric = ul.metric AND pl.value < ul.value) / (SELECT n FROM n) END "
            "AS percentile FROM ul")


register("J7_percentiles_against_pool", _against_sql())(
    lambda spark, d: PC.percentiles_against(M.user_vector(_prof_lineitem(spark, d), U), _pool_events(spark, d), U))

register("A21_pool_averages", "SELECT count(*) AS total_users, " + ", ".join(
    f"round(coalesce(avg({m}), 0.0), 9) AS {m}" for m in C.METRIC_KEYS) + f" FROM ({_vectors_sql(_PROFILE_EVENTS)}) AS v")(
    lambda spark, d: PC.pool_averages(_pool_events(spark, d)).select(
        "total_users", *[_r9(m) for m in C.METRIC_KEYS]))


@register("S8_pool_append_scan", f"SELECT user_id AS id, {_VEC_COLS} FROM ({_vectors_sql(_PROFILE_EVENTS)}) AS a "
                                 f"UNION ALL SELECT user_id AS id, {_VEC_COLS} FROM ({_vectors_sql(_PROFILE_LINEITEM)}) AS b")
def q_pool(spark, d):
    from cadenza.session import scratch_path

    path = scratch_path(spark, "pool")
    POOL.append_pool(_pool_events(spark, d), path)
    POOL.append_pool(M.user_vector(_prof_lineitem(spark, d), U), path)
    return POOL.read_pool(spark, path).drop("created_at")


# ------------------------------------------------------- C: clustering
from cadenza.operators import cluster as CL  # noqa: E402


register("C7_label_rules_on_vectors", f"SELECT user_id, {_first_rule_sql(C.CLUSTER_LABELS, C.CLUSTER_LABEL_DEFAULT)} AS label "
         f"FROM (SELECT user_id, " + ", ".join(f"round_even({m}, 3) AS {m}" for m in C.METRIC_KEYS)
         + f" FROM ({_vectors_sql(_PROFILE_EVENTS)}) AS v) AS r")(
    lambda spark, d: R.cluster_label(_pool_events(spark, d), ["user_id"]))


_C2_SQL = (f"SELECT user_id, " + ", ".join(
    f"round(CASE WHEN stddev_pop({m}) OVER () = 0 THEN 0.0 ELSE ({m} - avg({m}) OVER ()) / stddev_pop({m}) OVER () END, 6) AS {m}"
    for m in C.METRIC_KEYS) + f" FROM ({_vectors_sql(_PROFILE_EVENTS)}) AS v")


@register("C2_standardized_vectors", _C2_SQL)
def q_standardized(spark, d):
    from pyspark.ml.functions import vector_to_array

    v = _pool_events(spark, d)
    z = CL.standardize(v, CL.scaler_stats(v)).select("user_id", vector_to_array("features").alias("z"))
    return z.select("user_id", *[F.round(F.col("z")[i], 6).alias(m) for i, m in enumerate(C.METRIC_KEYS)])




_Z = [f"z{i}" for i in range(len(C.METRIC_KEYS))]


def _scaled_sql(rows: str) -> str:
    """Rows in the units of the pool's scaler."""
    return f"SELECT user_id, {', '.join(f'CASE WHEN s{i} = 0 THEN 0.0 ELSE (coalesce({m}, 0.0) - m{i}) / s{i} END AS z{i}' for i, m in enumerate(C.METRIC_KEYS))} FROM {rows}, sc"


def _gap_sql(a: str, b: str) -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in _Z)


def _kmeans_sql(starts: int) -> str:
    """CTEs of all fits: x (scaled pool), c (drawn centres), l (centres by
    round), a (rows placed by the last centres), b (cheapest start of the
    sweep per k) and sweep."""
    z = ", ".join(_Z)
    ctes = [f"pool AS MATERIALIZED ({_vectors_sql(_PROFILE_EVENTS)})",
            "sc AS MATERIALIZED (SELECT " + ", ".join(f"avg(coalesce({m}, 0.0)) AS m{i}, stddev_pop(coalesce({m}, 0.0)) AS s{i}" for i, m in enumerate(C.METRIC_KEYS)) + " FROM pool)",
            f"x AS MATERIALIZED ({_scaled_sql('pool')})", f"st AS (SELECT unnest(range({starts})) AS s)"]
    for t in range(C.KMEANS_K_MAX):
        w = "SELECT s, user_id, 1.0 AS w FROM x, st" if t == 0 else (
            f"SELECT c{t - 1}.s, x.user_id, min({_gap_sql('x', f'c{t - 1}')}) AS w FROM x, c{t - 1} GROUP BY ALL")
        u = f"(CAST('0x' || substr(md5(concat('{C.KMEANS_SEED}:', s, ':{t}:', user_id)), 1, 13) AS BIGINT) + 1)::DOUBLE / {1 << 52}"
        pick = f"SELECT p.s, {t} AS j, {z} FROM (SELECT s, arg_min(user_id, -ln({u}) / w) AS user_id FROM ({w}) WHERE w > {CL.APART} GROUP BY s) p JOIN x USING (user_id)"
        ctes.append(f"c{t} AS MATERIALIZED (" + (f"SELECT * FROM c{t - 1} UNION ALL " if t else "") + pick + ")")
    last = f"c{C.KMEANS_K_MAX - 1}"
    near = f"SELECT l.r, l.k, l.s, x.user_id, arg_min(l.j, {_gap_sql('x', 'l')}) AS j, min({_gap_sql('x', 'l')}) AS d FROM l, x"
    ctes += [
        f"l AS (SELECT 0 AS r, k, s, j, {z} FROM {last}, (SELECT unnest(range({C.KMEANS_K_MIN}, {C.KMEANS_K_MAX + 1})) AS k) WHERE j < k "
        f"UNION ALL SELECT r + 1, k, s, j, {', '.join(f'avg({c})' for c in _Z)} FROM ({near} WHERE l.r < {CL.ROUNDS} GROUP BY ALL) JOIN x USING (user_id) GROUP BY r, k, s, j)",
        f"a AS MATERIALIZED ({near} WHERE l.r = {CL.ROUNDS} GROUP BY ALL)",
        "i AS MATERIALIZED (SELECT k, s, sum(d) AS inertia, count(DISTINCT j) AS clusters FROM a GROUP BY ALL)",
        f"b AS MATERIALIZED (SELECT k, arg_min(s, inertia) AS s FROM i WHERE s < {C.KMEANS_SWEEP_RESTARTS} AND (k = 2 OR k < (SELECT count(*) FROM pool)) GROUP BY k)",
        "ba AS MATERIALIZED (SELECT k, user_id, j FROM a JOIN b USING (k, s))",
        "sizes AS (SELECT k, j, count(*) AS n FROM ba GROUP BY ALL)",
        f"pairs AS (SELECT p.k, p.user_id, p.j, q.j AS other, sum(g) AS g FROM ba p JOIN ba q USING (k) JOIN "
        f"(SELECT v.user_id AS u1, w.user_id AS u2, {_gap_sql('v', 'w')} AS g FROM x v, x w) ON u1 = p.user_id AND u2 = q.user_id GROUP BY ALL)",
        "ab AS (SELECT k, user_id, max(CASE WHEN pairs.j = other THEN g / nullif(n - 1, 0) END) AS a, min(CASE WHEN pairs.j <> other THEN g / n END) AS b "
        "FROM pairs JOIN (SELECT k, j AS other, n FROM sizes) USING (k, other) GROUP BY ALL)",
        "sil AS (SELECT k, avg(CASE WHEN a IS NULL THEN 0.0 WHEN a = b THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab GROUP BY k HAVING count(b) > 0)",
        "sweep AS MATERIALIZED (SELECT k, clusters, inertia, silhouette FROM b JOIN i USING (k, s) LEFT JOIN sil USING (k))"]
    return "WITH RECURSIVE " + ",\n".join(ctes)


def _segments_sql() -> str:
    """On top: the final fit (fs), its clusters by number (cl), rows (seg)."""
    return _kmeans_sql(C.KMEANS_RESTARTS) + f""",
fk AS (SELECT k FROM sweep ORDER BY silhouette DESC NULLS LAST, k LIMIT 1),
fs AS MATERIALIZED (SELECT k, arg_min(s, inertia) AS s FROM i JOIN fk USING (k) GROUP BY k),
cl AS MATERIALIZED (SELECT j, row_number() OVER (ORDER BY min(user_id)) - 1 AS cluster, count(*) AS size FROM a JOIN fs USING (k, s) GROUP BY j),
g AS (SELECT cluster, {", ".join(f"avg(coalesce({m}, 0.0)) AS {m}" for m in C.METRIC_KEYS)} FROM a JOIN fs USING (k, s) JOIN cl USING (j) JOIN pool USING (user_id) GROUP BY cluster),
lab AS (SELECT cluster, {_first_rule_sql(C.CLUSTER_LABELS, C.CLUSTER_LABEL_DEFAULT)} AS label FROM (
  SELECT cluster, {", ".join(f"round_even({m}, 3) AS {m}" for m in C.METRIC_KEYS)} FROM g)),
seg AS (SELECT CAST(cluster AS INTEGER) AS cluster, j, size, round(100.0::DOUBLE * size / (SELECT count(*) FROM pool), 9) AS share_pct, label FROM cl JOIN lab USING (cluster))"""


@register("C1_C10_segments", _segments_sql() + f"""
SELECT seg.cluster, size, share_pct, label, {", ".join(f"round({m}, 6) AS {m}" for m in C.METRIC_KEYS)} FROM seg JOIN g USING (cluster)""")
def q_segments(spark, d):
    """k-means over the listener pool, k by silhouette, starts drawn from
    hashes of the ids.  A pool that is too small gives its status row."""
    seg = CL.segment(_pool_events(spark, d), ["user_id"])
    if seg.clusters is None:
        return CL.status_row(spark, seg)
    return seg.clusters.select("cluster", "size", _r9("share_pct"), "label", *[F.round(m, 6).alias(m) for m in C.METRIC_KEYS])


@register("C9_J5_assign_new_listeners", _segments_sql() + f""",
new AS ({_vectors_sql(_PROFILE_LINEITEM)}), nx AS ({_scaled_sql('new')}),
near AS (SELECT nx.user_id, arg_min(l.j, {_gap_sql('nx', 'l')}) AS j FROM nx, l JOIN fs USING (k, s) WHERE l.r = {CL.ROUNDS} GROUP BY ALL)
SELECT cluster, user_id, label, size, share_pct FROM near JOIN seg USING (j)""")
def q_assign(spark, d):
    """Other listeners placed by the scaler and centres of the pool's fit."""
    seg = CL.segment(_pool_events(spark, d), ["user_id"])
    return CL.assign(seg, M.user_vector(_prof_lineitem(spark, d), U), ["user_id"]).withColumn("share_pct", _r9("share_pct"))


@register("C3_k_sweep", _kmeans_sql(C.KMEANS_SWEEP_RESTARTS) + """
SELECT CAST(k AS INTEGER) AS k, CAST(clusters AS INTEGER) AS clusters, round(inertia, 6) AS inertia, round(silhouette, 6) AS silhouette FROM sweep""")
def q_sweep(spark, d):
    """Diagnostics of every k, ten starts each."""
    _, n, _, scaled = CL.prepare_vectors(_pool_events(spark, d))
    out = spark.createDataFrame(CL.sweep(scaled, n), "k int, clusters int, inertia double, silhouette double")
    scaled.unpersist()
    return out.select("k", "clusters", F.round("inertia", 6).alias("inertia"), F.round("silhouette", 6).alias("silhouette"))


def _fixed_clusters(spark, d):
    """The listener pool with a given assignment: listener number mod 4."""
    return _pool_events(spark, d).withColumn("cluster", (F.col("user_id") % 4).cast("int"))


register("C6_C8_cluster_summary", f"""WITH pool AS ({_vectors_sql(_PROFILE_EVENTS)}),
g AS (SELECT CAST(user_id % 4 AS INTEGER) AS cluster, count(*) AS size, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM pool) AS share_pct,
  {", ".join(f"avg(coalesce({m}, 0.0)) AS {m}" for m in C.METRIC_KEYS)} FROM pool GROUP BY ALL),
l AS (SELECT cluster, {_first_rule_sql(C.CLUSTER_LABELS, C.CLUSTER_LABEL_DEFAULT)} AS label FROM (
  SELECT cluster, {", ".join(f"round_even({m}, 3) AS {m}" for m in C.METRIC_KEYS)} FROM g))
SELECT cluster, size, round(share_pct, 9) AS share_pct, label, {", ".join(f"round({m}, 6) AS {m}" for m in C.METRIC_KEYS)} FROM g JOIN l USING (cluster)""")(
    lambda spark, d: CL.cluster_summary(_fixed_clusters(spark, d)).select(
        "cluster", "size", _r9("share_pct"), "label", *[F.round(m, 6).alias(m) for m in C.METRIC_KEYS]))


@register("C5_silhouette", f"""WITH pool AS ({_vectors_sql(_PROFILE_EVENTS)}),
z AS (SELECT user_id, CAST(user_id % 4 AS INTEGER) AS cluster, {", ".join(
    f"CASE WHEN stddev_pop({m}) OVER () = 0 THEN 0.0 ELSE ({m} - avg({m}) OVER ()) / stddev_pop({m}) OVER () END AS {m}" for m in C.METRIC_KEYS)} FROM pool),
n AS (SELECT cluster, count(*) AS n FROM z GROUP BY ALL),
d AS (SELECT a.user_id, a.cluster, b.cluster AS other, sum({" + ".join(f"(a.{m} - b.{m}) ** 2" for m in C.METRIC_KEYS)}) AS s
  FROM z a, z b GROUP BY ALL),
ab AS (SELECT user_id, max(CASE WHEN d.cluster = other THEN s / nullif(n.n - 1, 0) END) AS a, min(CASE WHEN d.cluster <> other THEN s / n.n END) AS b
  FROM d JOIN n ON n.cluster = d.other GROUP BY ALL)
SELECT round(avg(CASE WHEN a IS NULL THEN 0.0 WHEN a = b THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab""")
def q_silhouette(spark, d):
    """Silhouette (squared Euclidean distance) of a given assignment."""
    v = _fixed_clusters(spark, d)
    s = CL.silhouette(CL.standardize(v, CL.scaler_stats(v)))
    return spark.createDataFrame([(round(s, 6),)], "silhouette double")


register("C10_status", f"""SELECT CASE WHEN count(*) < {C.KMEANS_MIN_ROWS} THEN 'insufficient_data' ELSE 'ok' END AS status,
  {C.KMEANS_MIN_ROWS} AS min_samples_required, count(*) AS current_samples FROM ({_vectors_sql(_PROFILE_EVENTS)}) AS v""")(
    lambda spark, d: CL.pool_status(_pool_events(spark, d)))


# ------------------------------------------------------------- G: graph
from cadenza.operators import graph as G  # noqa: E402
from cadenza.plans.oracle import plays_cte  # noqa: E402


def _graph_item(spark, d):
    return fixtures.plays(spark, d, "graph_item")


def _item_edges(spark, d):
    """graph_item edges: lag within each listener, pooled into one graph."""
    return S.transitions(_graph_item(spark, d), U, group_keys=ALL)


def _edges_cte(name: str = "graph_item", lag_key: str = "user_id", group_key: str = "") -> str:
    part = f"PARTITION BY {lag_key} " if lag_key else ""
    gsel = f"{group_key}, " if group_key else ""
    return (f"{plays_cte(name)},\ne AS (SELECT {gsel}prev_artist AS src, artist AS dst, count(*) AS weight FROM ("
            f"SELECT *, lag(artist) OVER w AS prev_artist, lag(ts) OVER w AS prev_ts FROM plays WHERE artist <> 'Unknown' "
            f"WINDOW w AS ({part}ORDER BY {_ORDER_SQL})) WHERE prev_ts IS NOT NULL AND "
            f"date_diff('microsecond', prev_ts, ts) <= 1800000000 GROUP BY ALL),\n"
            "v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),\n"
            "nb AS (SELECT src AS a, dst AS b FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst)")


register("G1_edges_graph_item", f"WITH {_edges_cte()} SELECT * FROM e")(_item_edges)
register("G1_edges_per_listener", f"WITH {_edges_cte('plays_events', 'user_id', 'user_id')} SELECT * FROM e")(
    lambda spark, d: S.transitions(_events(spark, d), U))
register("G1_edges_whole_input", f"WITH {_edges_cte('plays_events', '')} SELECT * FROM e")(
    lambda spark, d: S.transitions(_events(spark, d), ALL))
register("G1_edges_whole_input_split_by_day", f"WITH {_edges_cte('plays_events', '')} SELECT * FROM e")(
    lambda spark, d: S.transitions(_events(spark, d), ALL, hot_rows=0))
register("U2_vertices", f"WITH {_edges_cte()} SELECT id FROM v")(lambda spark, d: G.vertices(_item_edges(spark, d)))
register("G8_degrees", f"""WITH {_edges_cte()} SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree,
  CAST(sum(iw) AS BIGINT) AS in_weight, CAST(sum(ow) AS BIGINT) AS out_weight, CAST(sum(iw) + sum(ow) AS BIGINT) AS weighted_degree
FROM (SELECT src AS id, 0 AS i, 1 AS o, 0 AS iw, weight AS ow FROM e UNION ALL SELECT dst, 1, 0, weight, 0 FROM e) GROUP BY id""")(
    lambda spark, d: G.degrees(_item_edges(spark, d)))
register("J8_reciprocal_edges", f"WITH {_edges_cte()} SELECT e.* FROM e WHERE src <> dst AND EXISTS "
         "(SELECT 1 FROM e r WHERE r.src = e.dst AND r.dst = e.src)")(
    lambda spark, d: G.reciprocal_edges(_item_edges(spark, d)))


def _summary_sql(name: str, lag_key: str, group_key: str) -> str:
    g = group_key
    gsel = f"{g}, " if g else ""
    gby = f"GROUP BY {g}" if g else ""
    using = f"USING ({g})" if g else "ON true"
    return (f"WITH {_edges_cte(name, lag_key, g)}, vv AS (SELECT {gsel}src AS id FROM e UNION SELECT {gsel}dst FROM e), "
            f"m AS (SELECT {gsel}count(*) AS edges, count(*) FILTER (WHERE src = dst) AS self_loops FROM e {gby}), "
            f"n AS (SELECT {gsel}count(*) AS nodes FROM vv {gby}), "
            f"r AS (SELECT {gsel}count(*) AS rc FROM e x WHERE src <> dst AND EXISTS (SELECT 1 FROM e y WHERE y.src = x.dst "
            f"AND y.dst = x.src{f' AND y.{g} = x.{g}' if g else ''}) {gby})\n"
            f"SELECT {'m.' + g + ', ' if g else ''}nodes, edges, coalesce(CAST(edges AS DOUBLE) / nullif(nodes * (nodes - 1), 0), 0.0) AS density, "
            "CAST(edges AS DOUBLE) / nodes AS avg_in_degree, CAST(edges AS DOUBLE) / nodes AS avg_out_degree, self_loops, "
            f"CAST(coalesce(rc, 0) AS DOUBLE) / edges AS reciprocity FROM m JOIN n {using} LEFT JOIN r {using}")


register("G7_summary", _summary_sql("graph_item", "user_id", ""))(lambda spark, d: G.summary(_item_edges(spark, d)))
register("G7_summary_per_listener", _summary_sql("plays_events", "user_id", "user_id"))(
    lambda spark, d: G.summary(S.transitions(_events(spark, d), U), U))


def _pagerank_ctes(iters: int, weighted: bool = True) -> str:
    w = "CAST(e.weight AS DOUBLE)" if weighted else "1.0"
    parts = ["nn AS (SELECT count(*) AS n FROM v)",
             f"ow AS (SELECT src, sum({w.replace('e.', '')}) AS w FROM e GROUP BY src)",
             f"ep AS (SELECT e.src, e.dst, {w} / ow.w AS p FROM e JOIN ow USING (src))",
             "vd AS (SELECT v.id, ow.src IS NULL AS dangling FROM v LEFT JOIN ow ON v.id = ow.src)",
             "r0 AS MATERIALIZED (SELECT id, 1.0 / (SELECT n FROM nn) AS r FROM v)"]
    for i in range(1, iters + 1):
        p = f"r{i - 1}"
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT vd.id, 0.85 * coalesce(c.s, 0) + 0.85 * (SELECT coalesce(sum(x.r), 0) FROM {p} x "
            f"JOIN vd y USING (id) WHERE y.dangling) / (SELECT n FROM nn) + 0.15 / (SELECT n FROM nn) AS r FROM vd LEFT JOIN "
            f"(SELECT ep.dst AS id, sum({p}.r * ep.p) AS s FROM ep JOIN {p} ON ep.src = {p}.id GROUP BY ep.dst) c USING (id))")
    return ",\n".join(parts)


register("G2_pagerank_20_rounds", f"WITH {_edges_cte()},\n{_pagerank_ctes(20)}\nSELECT id, round(r, 9) AS rank FROM r20")(
    lambda spark, d: G.pagerank(_item_edges(spark, d), iterations=20).select("id", _r9("rank")))
register("G2_pagerank_whole_input_20_rounds",
         f"WITH {_edges_cte('plays_events', '')},\n{_pagerank_ctes(20)}\nSELECT id, round(r, 9) AS rank FROM r20")(
    lambda spark, d: G.pagerank(S.transitions(_events(spark, d), ALL), iterations=20).select("id", _r9("rank")))
register("T3_W5_top_pagerank", f"WITH {_edges_cte()},\n{_pagerank_ctes(20)}\nSELECT CAST(row_number() OVER "
         "(ORDER BY r DESC, id) AS INTEGER) AS position, id, round(r, 9) AS rank FROM r20 QUALIFY position <= 20")(
    lambda spark, d: G.top_pagerank(G.pagerank(_item_edges(spark, d), iterations=20)).select(
        "position", "id", _r9("rank")))


def _pagerank_converged_ctes(max_iter: int = C.PAGERANK_MAX_ITER, tol: float = C.PAGERANK_TOL) -> str:
    """Unrolled rounds with a carried "converged" flag: once the L1 change of
    a round is below N * tol the ranks stay as they are (the Spark loop stops
    at that round)."""
    base = _pagerank_ctes(0).replace("r0 AS MATERIALIZED (SELECT id, 1.0 / (SELECT n FROM nn) AS r FROM v)",
                                     "r0 AS MATERIALIZED (SELECT id, 1.0 / (SELECT n FROM nn) AS r, false AS done FROM v)")
    parts = [base]
    for i in range(1, max_iter + 1):
        p = f"r{i - 1}"
        parts.append(
            f"s{i} AS MATERIALIZED (SELECT vd.id, 0.85 * coalesce(c.s, 0) + 0.85 * (SELECT coalesce(sum(x.r), 0) FROM {p} x "
            f"JOIN vd y USING (id) WHERE y.dangling) / (SELECT n FROM nn) + 0.15 / (SELECT n FROM nn) AS r FROM vd LEFT JOIN "
            f"(SELECT ep.dst AS id, sum({p}.r * ep.p) AS s FROM ep JOIN {p} ON ep.src = {p}.id GROUP BY ep.dst) c USING (id))")
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT q.id, CASE WHEN q.done THEN q.r ELSE t.r END AS r, q.done OR "
            f"(SELECT sum(abs(a.r - b.r)) FROM s{i} a JOIN {p} b USING (id)) < (SELECT n FROM nn) * {tol!r} AS done "
            f"FROM {p} q JOIN s{i} t USING (id))")
    return ",\n".join(parts)


@register("G2_pagerank_converged",
          f"WITH {_edges_cte()},\n{_pagerank_converged_ctes()}\nSELECT id, round(r, 9) AS rank FROM r{C.PAGERANK_MAX_ITER}")
def q_pr_conv(spark, d):
    """Weighted PageRank to tolerance (stops at the first round whose L1
    change is below N * tol)."""
    return G.pagerank(_item_edges(spark, d)).select("id", _r9("rank"))


def _graphx_ctes(iters: int) -> str:
    parts = ["od AS (SELECT src, count(*) AS d FROM (SELECT DISTINCT src, dst FROM e) GROUP BY src)",
             "ep AS (SELECT x.src, x.dst, 1.0 / od.d AS p FROM (SELECT DISTINCT src, dst FROM e) x JOIN od USING (src))",
             "g0 AS MATERIALIZED (SELECT id, 1.0 AS r FROM v)"]
    for i in range(1, iters + 1):
        p = f"g{i - 1}"
        parts.append(f"g{i} AS MATERIALIZED (SELECT v.id, 0.15 + 0.85 * coalesce(c.s, 0) AS r FROM v LEFT JOIN "
                     f"(SELECT ep.dst AS id, sum({p}.r * ep.p) AS s FROM ep JOIN {p} ON ep.src = {p}.id GROUP BY ep.dst) c USING (id))")
    return ",\n".join(parts)


register("G3_pagerank_unweighted", f"WITH {_edges_cte()},\n{_graphx_ctes(20)}\nSELECT id, round(r * (SELECT count(*) FROM g20) "
         "/ (SELECT sum(r) FROM g20), 9) AS rank FROM g20")(
    lambda spark, d: G.pagerank_unweighted(_item_edges(spark, d)).select("id", _r9("rank")))


def _lpa_ctes(rounds: int, self_vote: bool = True) -> str:
    parts = ["l0 AS MATERIALIZED (SELECT id, id AS label FROM v)"]
    for i in range(1, rounds + 1):
        p = f"l{i - 1}"
        own = f" UNION ALL SELECT id, label FROM {p}" if self_vote else ""
        parts.append(
            f"l{i} AS MATERIALIZED (SELECT {p}.id, coalesce(b.label, {p}.label) AS label FROM {p} LEFT JOIN (SELECT id, label FROM "
            f"(SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY c DESC, label) AS rn FROM (SELECT id, label, count(*) AS c "
            f"FROM (SELECT nb.a AS id, q.label FROM nb JOIN {p} q ON q.id = nb.b{own}) GROUP BY ALL)) WHERE rn = 1) b USING (id))")
    return ",\n".join(parts)


#: Rounds the oracles unroll: more than the data need (``converged`` tells).
#: The operator itself has no such number; it runs to the fixpoint.
LPA_ROUNDS = 40
register("G4_label_propagation", f"""WITH {_edges_cte()},
{_lpa_ctes(LPA_ROUNDS)}
SELECT id, label, (SELECT count(*) = 0 FROM l{LPA_ROUNDS} a JOIN l{LPA_ROUNDS - 1} b USING (id) WHERE a.label <> b.label) AS converged
FROM l{LPA_ROUNDS}""")(lambda spark, d: G.label_propagation(_item_edges(spark, d)))
register("G4_label_propagation_no_self_vote_5_rounds",
         f"WITH {_edges_cte()},\n{_lpa_ctes(5, False)}\nSELECT id, label FROM l5")(
    lambda spark, d: G.label_propagation(_item_edges(spark, d), max_iter=5, self_vote=False).select("id", "label"))


def _communities_sql() -> str:
    return f"""WITH {_edges_cte()},
{_lpa_ctes(LPA_ROUNDS)},
wd AS (SELECT id, sum(w) AS wdeg FROM (SELECT src AS id, weight AS w FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY id),
m AS (SELECT l.id, l.label, coalesce(wd.wdeg, 0) AS wdeg FROM l{LPA_ROUNDS} l LEFT JOIN wd USING (id)),
agg AS (SELECT label, count(*) AS size, CAST(sum(wdeg) AS BIGINT) AS weight FROM m GROUP BY label),
ranked AS (SELECT *, row_number() OVER (ORDER BY weight DESC, label) AS pos FROM agg),
tops AS (SELECT label, list(id ORDER BY r) AS top_members FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY wdeg DESC, id) AS r
  FROM m) WHERE r <= 8 GROUP BY label)
SELECT CAST(pos - 1 AS INTEGER) AS community, label, size, weight, top_members FROM ranked JOIN tops USING (label) WHERE pos <= 10"""


def _communities(spark, d):
    e = _item_edges(spark, d)
    return G.communities(e, G.label_propagation(e))


register("G5_T4_T5_communities", _communities_sql())(_communities)
register("A23_community_members", f"""WITH {_edges_cte()},
{_lpa_ctes(LPA_ROUNDS)},
sizes AS (SELECT label, count(*) AS size FROM l{LPA_ROUNDS} GROUP BY label),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY size DESC, label) AS INTEGER) AS position FROM sizes),
firsts AS (SELECT label, list(id ORDER BY id) AS members FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS r
  FROM l{LPA_ROUNDS}) WHERE r <= 8 GROUP BY label)
SELECT label, size, position, members FROM ranked JOIN firsts USING (label) WHERE position <= 20""")(
    lambda spark, d: G.community_members(G.label_propagation(_item_edges(spark, d))))


_CC_SQL = (f"WITH RECURSIVE {_edges_cte()},\nreach(id, lbl) AS (SELECT id, id FROM v UNION "
           "SELECT nb.a, reach.lbl FROM reach JOIN nb ON reach.id = nb.b),\ncc AS (SELECT id, min(lbl) AS component FROM reach GROUP BY id)\n")
register("G6_components", _CC_SQL + "SELECT id, component FROM cc")(
    lambda spark, d: G.components(_item_edges(spark, d)))
register("G6_T6_component_summary", _CC_SQL.replace("WITH RECURSIVE", "WITH RECURSIVE") + """, sizes AS (SELECT component, count(*) AS size FROM cc GROUP BY component)
SELECT component, size, position, sample_members, components, largest_size FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY size DESC, component) AS INTEGER) AS position FROM sizes) s
JOIN (SELECT component, list(id ORDER BY id) AS sample_members FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY id) AS r
  FROM cc) WHERE r <= 5 GROUP BY component) USING (component)
CROSS JOIN (SELECT count(*) AS components, max(size) AS largest_size FROM sizes) t WHERE position <= 5""")(
    lambda spark, d: G.component_summary(G.components(_item_edges(spark, d))))


# ------------------------------------------------- S / U: sources and sinks
from cadenza.session import scratch_path  # noqa: E402
from cadenza.sources import schema as SC  # noqa: E402
from cadenza.sources.synth import synthetic_plays  # noqa: E402

_NO_ID_COLS_SQL = PLAY_COLS_SQL.replace("play_id", "CAST(NULL AS BIGINT) AS play_id")


@register("S1_json_export_scan", with_plays(f"SELECT {_NO_ID_COLS_SQL} FROM plays"))
def q_json(spark, d):
    """Raw plays written as JSON export records (export field names, ISO ts
    text), then scanned back with the explicit export schema and cleaned."""
    path = scratch_path(spark, "json")
    SC.to_export(fixtures.raw_view(spark, d, "plays_events")).write.mode("overwrite").json(path)
    return SC.read_plays(spark, path, fmt="json", multiline=False)


_DIRTY = "second(ts) % 4 = 2"
_DIRTY_COLS = _NO_ID_COLS_SQL.replace("ms_played,", f"CASE WHEN {_DIRTY} THEN 0 ELSE ms_played END AS ms_played,")
for _flag in SC.FLAG_COLUMNS:
    _DIRTY_COLS = _DIRTY_COLS.replace(f"{_flag},", f"CASE WHEN {_DIRTY} THEN false ELSE {_flag} END AS {_flag},")


@register("S1_json_dirty_values", with_plays(f"SELECT {_DIRTY_COLS} FROM plays"))
def q_json_dirty(spark, d):
    """Export lines whose times and flags are spelt in four ways (by the
    second of the play): 1234.0 and 0/1; "1234" and "true"; "oops" and
    "maybe"; plain.  The scan coerces them (unreadable: 0 and false)."""
    raw = SC.to_export(fixtures.raw_view(spark, d, "plays_events"))
    kind = F.substring("ts", 18, 2).cast("int") % 4
    varied = ("ms_played", *SC.FLAG_COLUMNS)
    plain = [c for c in raw.columns if c not in varied]

    def line(ms, flag):
        return F.to_json(F.struct(*plain, ms(F.col("ms_played")).alias("ms_played"), *[flag(F.col(c)).alias(c) for c in SC.FLAG_COLUMNS]))

    text = (F.when(kind == 0, line(lambda c: c.cast("double"), lambda c: c.cast("int")))
            .when(kind == 1, line(lambda c: c.cast("string"), lambda c: c.cast("string")))
            .when(kind == 2, line(lambda c: F.lit("oops"), lambda c: F.lit("maybe")))
            .otherwise(line(lambda c: c, lambda c: c)))
    path = scratch_path(spark, "json-dirty")
    raw.select(text.alias("value")).write.text(path)
    return SC.read_plays(spark, path, fmt="json", multiline=False)


def _sink_round_trip(spark, d, fmt):
    path = scratch_path(spark, fmt)
    SC.write_table(SC.to_export(_lineitem(spark, d)), path, fmt)
    return SC.read_plays(spark, path, fmt=fmt, multiline=False)


for _fmt in ("json", "csv"):
    register(f"S6_flat_{_fmt}_sink", with_plays(f"SELECT {_NO_ID_COLS_SQL} FROM plays", "plays_lineitem"))(
        lambda spark, d, fmt=_fmt: _sink_round_trip(spark, d, fmt))


@register("S4_S5_partitioned_parquet_pruned", with_plays(
    f"SELECT {PLAY_COLS_SQL} FROM plays WHERE year IN (1995, 1996)", "plays_lineitem"))
def q_parquet(spark, d):
    """Clean plays written partitioned by (year, month), read back with a
    partition filter (PartitionFilters prune the other years' folders)."""
    path = scratch_path(spark, "plays")
    SC.write_plays(_lineitem(spark, d), path)
    return SC.read_plays_table(spark, path, years=[1995, 1996])


_CUT_SQL = "TIMESTAMP '2024-01-16 00:00:00'"
_U1_COLS = (_NO_ID_COLS_SQL
            .replace("skipped,", f"CASE WHEN ts < {_CUT_SQL} THEN skipped ELSE false END AS skipped,")
            .replace("conn_country, platform,",
                     f"CASE WHEN ts < {_CUT_SQL} THEN conn_country ELSE 'Unknown' END AS conn_country, "
                     f"CASE WHEN ts < {_CUT_SQL} THEN platform ELSE 'Unknown' END AS platform,"))
_U1_SQL = with_plays(f"SELECT {_U1_COLS} FROM plays")


@register("U1_union_differing_exports", _U1_SQL)
def q_union(spark, d):
    """Two export sets covering different periods, the later one without the
    skipped / country / platform fields, unioned by name (missing -> null)."""
    raw = SC.to_export(fixtures.raw_view(spark, d, "plays_events"))
    cut = "2024-01-16T00:00:00"
    early = raw.filter(F.col("ts") < cut)
    late = raw.filter(F.col("ts") >= cut).drop("skipped", "conn_country", "platform")
    return SC.clean_plays(SC.union_exports([early, late]))


@register("S7_synthetic_plays")
def q_synth(spark, d):
    """One synthetic play per event row (rows-only: a generator)."""
    ids = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"))
    return SC.clean_plays(SC.from_export(synthetic_plays(ids, seed=42)))


@register("S7_synthetic_invariants", "SELECT count(*) AS plays, " + ", ".join(f"0 AS {c}" for c in (
    "bad_ms", "bad_ts", "bad_names", "bad_choices", "repeated")) + " FROM events")
def q_synth_invariants(spark, d):
    """What holds for every synthetic play, whatever the draws: counted are
    the plays that break it."""
    from cadenza.sources import synth as SY

    ids = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"))
    p = SC.clean_plays(SC.from_export(synthetic_plays(ids, seed=42)))
    again = SC.clean_plays(SC.from_export(synthetic_plays(ids.repartition(3), seed=42)))
    low, high = F.when(F.col("skipped"), 1_000).otherwise(60_000), F.when(F.col("skipped"), 60_000).otherwise(300_000)
    choices = (F.col("reason_start").isin(SY.REASON_START) & F.col("reason_end").isin(SY.REASON_END)
               & F.col("conn_country").isin([c for c, _ in SY.COUNTRIES]) & F.col("platform").isin([c for c, _ in SY.PLATFORMS]))
    names = (F.col("artist").rlike("^Artist_[0-9]{5}$") & F.col("track").rlike("^Track_[0-9]{6}$")
             & (F.col("album") == F.concat(F.lit("Album_of_"), F.col("artist"))))
    out = p.agg(F.count(F.lit(1)).alias("plays"),
                F.count_if((F.col("ms_played") < low) | (F.col("ms_played") >= high)).alias("bad_ms"),
                F.count_if(~F.col("year").between(2018, 2026)).alias("bad_ts"),
                F.count_if(~names).alias("bad_names"), F.count_if(~choices).alias("bad_choices"),
                F.sum(F.xxhash64(*p.columns).cast("decimal(38,0)")).alias("_mark"))
    mark = again.agg(F.sum(F.xxhash64(*again.columns).cast("decimal(38,0)")).alias("_again"))
    # one row each: the table is the same however its ids are partitioned
    return out.join(F.broadcast(mark)).select(
        "plays", "bad_ms", "bad_ts", "bad_names", "bad_choices", F.when(F.col("_mark") == F.col("_again"), 0).otherwise(1).alias("repeated"))


_S7_RANKS = 20
_S7_SQL = "SELECT CAST(rank AS INTEGER) AS rank, kind, round(power(rank, -alpha) / total, 9) AS share, true AS as_expected FROM (" + " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, {alpha} AS alpha, (SELECT sum(power(k, -{alpha})) FROM range(1, 4097) AS t(k)) + power(4096.5, 1 - {alpha}) / ({alpha} - 1) AS total"
    for kind, alpha in (("artist", 1.15), ("track", 1.05))) + f"), range(1, {_S7_RANKS + 1}) AS r(rank)"


@register("S7_synthetic_popularity", _S7_SQL)
def q_synth_popularity(spark, d):
    """The most popular ranks: share of the plays the distribution gives
    them, and whether those drawn lie within five standard errors."""
    from cadenza.sources import synth as SY

    ids = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"))
    raw = synthetic_plays(ids, seed=42)
    drawn = raw.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.substring_index(c, "_", -1).cast("int") + 1).alias("rank")) for k, c in (
        ("artist", "master_metadata_album_artist_name"), ("track", "master_metadata_track_name"))])).alias("x")).select("x.*")
    counts = drawn.filter(F.col("rank") <= _S7_RANKS).groupBy("kind", "rank").agg(F.count(F.lit(1)).alias("n"))
    shares = spark.createDataFrame([(k, r, SY.zipf_share(r, a)) for k, a in (("artist", SY.ARTIST_ALPHA), ("track", SY.TRACK_ALPHA))
                                    for r in range(1, _S7_RANKS + 1)], "kind string, rank int, p double")
    plays = raw.agg(F.count(F.lit(1)).alias("plays"))
    off = F.abs(F.coalesce("n", F.lit(0)) - F.col("plays") * F.col("p"))
    near = off <= 5 * F.sqrt(F.col("plays") * F.col("p") * (1 - F.col("p"))) + 1
    return shares.join(counts, ["kind", "rank"], "left").join(F.broadcast(plays)).select(
        "kind", "rank", F.round("p", 9).alias("share"), near.alias("as_expected"))


# --------------------------------------------------------- R8 / G9 / G10
from cadenza.plans import report as RP  # noqa: E402


@register("R8_report")
def q_report(spark, d):
    """Whole per-listener report rows (rows-only: nested display structs)."""
    return RP.report(_events(spark, d), U)


_R8_SQL = f"""WITH lv AS ({_levels_sql(_PROFILE_EVENTS)}), ar AS ({_archetype_sql(_PROFILE_EVENTS)}), ra AS ({_radar_sql(_PROFILE_EVENTS)}),
pr AS (SELECT user_id, total_plays, round_even(total_hours, 2) AS total_hours, sessions, shuffle_pct, unique_artists, unique_tracks,
  first_year, last_year FROM ({_PROFILE_EVENTS}) AS p),
top AS ({with_plays("SELECT user_id, arg_max(artist, r) AS top_artist, count(*) AS n_artists FROM (SELECT *, -row_number() OVER "
                    "(PARTITION BY user_id ORDER BY ms DESC, artist) AS r FROM (SELECT user_id, artist, sum(ms_played) AS ms "
                    "FROM plays GROUP BY ALL)) WHERE r >= -20 GROUP BY ALL")})
SELECT user_id, total_plays, total_hours, sessions, round_even(shuffle_pct, 1) AS shuffle_pct, unique_artists, unique_tracks, first_year,
  last_year, badges_earned, level, title, next_threshold_hours, xp, archetype, patience, exploration, loyalty, focus, diversity, night,
  top_artist, n_artists, 24 AS n_hours, 7 AS n_weekdays, archetype AS json_archetype, title AS json_level
FROM pr JOIN lv USING (user_id) JOIN ar USING (user_id) JOIN ra USING (user_id) JOIN top USING (user_id)"""


_T8_TOP = ("SELECT user_id, '{name}' AS list, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, {cols}) - 1 AS position, {shown} AS bucket "
           "FROM (SELECT user_id, {cols}, sum(ms_played) AS ms FROM plays GROUP BY ALL) QUALIFY position < 20")
_T8_SQL = with_plays("SELECT user_id, list, CAST(position AS INTEGER) AS position, bucket FROM (" + " UNION ALL ".join((
    "SELECT user_id, 'years' AS list, row_number() OVER (PARTITION BY user_id ORDER BY year) - 1 AS position, CAST(year AS VARCHAR) AS bucket "
    "FROM (SELECT DISTINCT user_id, year FROM plays)",
    *(f"SELECT user_id, '{name}' AS list, b AS position, CAST(b AS VARCHAR) AS bucket FROM (SELECT DISTINCT user_id FROM plays), range({n}) AS t(b)"
      for name, n in (("weekdays", 7), ("circadian_hours", 24))),
    _T8_TOP.format(name="top_artists", cols="artist", shown="artist"),
    _T8_TOP.format(name="top_songs", cols="track, artist", shown="track || ' / ' || artist"))) + ")")


@register("T8_bucket_order", _T8_SQL)
def q_bucket_order(spark, d):
    """Every entry of the ordered lists of a report with its place: years,
    weekdays (Mon = 0), local hours, top artists and songs."""
    rows = RP.report(_events(spark, d), U)
    shown = {"years": lambda x: x["year"].cast("string"), "weekdays": lambda x: x["weekday"].cast("string"),
             "circadian_hours": lambda x: x["local_hour"].cast("string"), "top_artists": lambda x: x["artist"],
             "top_songs": lambda x: F.concat(x["track"], F.lit(" / "), x["artist"])}
    lists = F.array(*[F.struct(F.lit(name).alias("list"), F.transform(name, f).alias("v")) for name, f in shown.items()])
    return rows.select("user_id", F.explode(lists).alias("l")).select("user_id", "l.list", F.posexplode("l.v").alias("position", "bucket"))


@register("R8_report_flat", _R8_SQL)
def q_report_flat(spark, d):
    """The report rows flattened: summary, level, archetype, radar, the first
    top artist, list sizes, and two fields of the JSON payload."""
    r = RP.report(_events(spark, d), U)
    return r.select(
        "user_id", *[f"summary.{c}" for c in ("total_plays", "total_hours", "sessions", "shuffle_pct", "unique_artists",
                                              "unique_tracks", "first_year", "last_year")],
        F.size(F.filter("badges", lambda b: b["earned"])).alias("badges_earned"), "level", "title", "next_threshold_hours", "xp",
        "archetype", *[f"radar.{name}" for name, *_ in C.RADAR_AXES],
        F.get("top_artists", F.lit(0))["artist"].alias("top_artist"), F.size("top_artists").cast("long").alias("n_artists"),
        F.size("circadian_hours").alias("n_hours"), F.size("weekdays").alias("n_weekdays"),
        F.get_json_object("summary_json", "$.archetype").alias("json_archetype"),
        F.get_json_object("summary_json", "$.level").alias("json_level"))


@register("G10_graph_report_flat", f"""WITH RECURSIVE {_edges_cte()},
reach(id, lbl) AS (SELECT id, id FROM v UNION SELECT nb.a, reach.lbl FROM reach JOIN nb ON reach.id = nb.b),
cc AS (SELECT id, min(lbl) AS component FROM reach GROUP BY id), cs AS (SELECT component, count(*) AS size FROM cc GROUP BY component),
{_lpa_ctes(LPA_ROUNDS)},
wd AS (SELECT id, sum(w) AS wdeg FROM (SELECT src AS id, weight AS w FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY id),
agg AS (SELECT l.label, count(*) AS size, CAST(sum(coalesce(wd.wdeg, 0)) AS BIGINT) AS weight FROM l{LPA_ROUNDS} l LEFT JOIN wd USING (id) GROUP BY l.label),
best AS (SELECT list(size ORDER BY weight DESC, label) AS sizes, list(weight ORDER BY weight DESC, label) AS weights FROM (
  SELECT * FROM agg ORDER BY weight DESC, label LIMIT 10))
SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM cs) AS components,
  (SELECT max(size) FROM cs) AS largest_size, sizes AS community_sizes, weights AS community_weights FROM best""")
def q_graph_report_flat(spark, d):
    """Summary, components and communities of the graph report."""
    g = RP.graph_report(_item_edges(spark, d))
    return g.select("summary.nodes", "summary.edges", "components", "largest_size",
                    F.transform("communities", lambda c: c["size"]).alias("community_sizes"),
                    F.transform("communities", lambda c: c["weight"]).alias("community_weights"))


@register("G10_graph_report")
def q_graph_report(spark, d):
    return RP.graph_report(_item_edges(spark, d))


def _display_sql(part: str) -> str:
    head = f"""WITH {_edges_cte()},
{_pagerank_ctes(20)},
{_lpa_ctes(LPA_ROUNDS)},
wd AS (SELECT id, sum(w) AS wdeg FROM (SELECT src AS id, weight AS w FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY id),
m AS (SELECT l.id, l.label, coalesce(wd.wdeg, 0) AS wdeg FROM l{LPA_ROUNDS} l LEFT JOIN wd USING (id)),
agg AS (SELECT label, sum(wdeg) AS weight FROM m GROUP BY label),
ranked AS (SELECT *, row_number() OVER (ORDER BY weight DESC, label) - 1 AS community FROM agg),
mem AS (SELECT id, min(community) AS community FROM (SELECT m.id, ranked.community, row_number() OVER (PARTITION BY m.label ORDER BY wdeg DESC, m.id) AS r
  FROM m JOIN ranked USING (label) WHERE ranked.community < 10) WHERE r <= 8 GROUP BY id),
keep AS (SELECT id, round(r, 9) AS rank FROM r20 QUALIFY row_number() OVER (ORDER BY r DESC, id) <= 60)
"""
    if part == "nodes":
        return head + "SELECT keep.id, rank, CAST(coalesce(mem.community, -1) AS INTEGER) AS community FROM keep LEFT JOIN mem USING (id)"
    return head + ("SELECT src, dst, weight FROM e WHERE src <> dst AND src IN (SELECT id FROM keep) AND dst IN (SELECT id FROM keep) "
                   "QUALIFY row_number() OVER (ORDER BY weight DESC, src, dst) <= 120")


def _display(spark, d):
    # ranks, labels, communities and the subgraph read the edges, not the plays
    e = cut_lineage(_item_edges(spark, d))
    ranks = G.pagerank(e, iterations=20)
    return G.display_subgraph(e, ranks, G.communities(e, G.label_propagation(e)))


register("G9_J3_J4_display_nodes", _display_sql("nodes"))(
    lambda spark, d: _display(spark, d)[0].select("id", _r9("rank"), "community"))
register("G9_J3_T7_display_edges", _display_sql("edges"))(lambda spark, d: _display(spark, d)[1])

def queries() -> dict[str, QueryFn]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
