"""DuckDB SQL building blocks for the oracle strings.

``plays_cte(name)`` is the SQL twin of ``fixtures.plays(spark, dir, name)``:
the fixture view followed by the same cleaning rules as ``clean_plays``.
"""

from __future__ import annotations

from cadenza.sources.fixtures import oracle_raw

_RAW_COLS = {
    "plays_events": {"user_id", "play_id", "ts", "ms_played", "track", "artist", "album", "skipped",
                     "shuffle", "offline", "incognito_mode", "reason_start", "reason_end", "platform",
                     "conn_country"},
    "graph_item": {"user_id", "play_id", "ts", "ms_played", "track", "artist", "album", "skipped",
                   "shuffle", "offline", "incognito_mode", "reason_start", "reason_end", "platform",
                   "conn_country"},
    "plays_lineitem": {"user_id", "ts", "ms_played", "track", "artist", "skipped"},
}


def plays_cte(name: str = "plays_events", alias: str = "plays") -> str:
    have = _RAW_COLS[name]

    def col(c: str, default: str) -> str:
        return c if c in have else default

    flags = ",\n    ".join(
        f"coalesce({col(c, 'NULL::BOOLEAN')}, false) AS {c}"
        for c in ("skipped", "shuffle", "offline", "incognito_mode"))
    strs = ",\n    ".join(
        f"coalesce(nullif(CAST({col(c, 'NULL')} AS VARCHAR), ''), 'Unknown') AS {c}"
        for c in ("reason_start", "reason_end", "conn_country", "platform"))
    return f"""raw_{alias} AS ({oracle_raw(name)}),
{alias} AS (
  SELECT coalesce(TRY_CAST(user_id AS BIGINT), -1) AS user_id,
    CAST({col('play_id', 'NULL')} AS BIGINT) AS play_id,
    CAST(ts AS TIMESTAMP) AS ts,
    coalesce(TRY_CAST(ms_played AS BIGINT), 0) AS ms_played,
    CAST(track AS VARCHAR) AS track,
    coalesce(nullif(CAST({col('artist', 'NULL')} AS VARCHAR), ''), 'Unknown') AS artist,
    CAST({col('album', 'NULL')} AS VARCHAR) AS album,
    {flags},
    {strs},
    CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
    CAST(hour(ts) AS INTEGER) AS hour_utc, CAST(isodow(ts) - 1 AS INTEGER) AS weekday
  FROM raw_{alias}
  WHERE ts IS NOT NULL AND track IS NOT NULL AND length(track) > 0)"""


def with_plays(body: str, name: str = "plays_events", extra_ctes: str = "") -> str:
    ctes = plays_cte(name)
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"


# Expressions mirrored from cadenza.functions.expressions
PLATFORM_HEAD = "lower(trim(split_part(coalesce(platform, ''), '(', 1)))"


def platform_category_sql(head: str = PLATFORM_HEAD) -> str:
    return (f"CASE WHEN contains({head}, 'android') OR contains({head}, 'ios') OR contains({head}, 'iphone') THEN 'Mobile' "
            f"WHEN contains({head}, 'web') OR contains({head}, 'chrome') OR contains({head}, 'firefox') THEN 'Web' "
            f"WHEN contains({head}, 'desktop') OR contains({head}, 'windows') OR contains({head}, 'mac') THEN 'Desktop' "
            "ELSE 'Other' END")


def platform_label_sql(head: str = PLATFORM_HEAD) -> str:
    cat = platform_category_sql(head)
    return (f"CASE WHEN ({cat}) <> 'Other' THEN ({cat}) WHEN length({head}) = 0 THEN 'Other' "
            f"ELSE substring({head}, 1, 20) END")


def tz_offset_sql(country: str) -> str:
    from cadenza.functions.constants import DEFAULT_TZ_OFFSET, TZ_OFFSETS

    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in TZ_OFFSETS.items())
    return f"CAST(CASE {country} {whens} ELSE {DEFAULT_TZ_OFFSET} END AS INTEGER)"


def tz_label_sql(off: str) -> str:
    return f"CASE WHEN {off} >= 0 THEN concat('UTC+', CAST({off} AS VARCHAR)) ELSE concat('UTC', CAST({off} AS VARCHAR)) END"


def pct_sql(num: str, den: str) -> str:
    return f"coalesce(CAST(100 AS DOUBLE) * ({num}) / nullif({den}, 0), 0.0)"


def hours_sql(ms: str) -> str:
    return f"CAST({ms} AS DOUBLE) / 3600000"
