"""Play-shaped inputs over the driver's test tables.

Each view only maps test-table columns onto the raw play schema (with the
dirt the operators must handle); all cleaning and computing happens in the
library operators.  The SQL text is the same in Spark and DuckDB, so the
oracle queries embed exactly these strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.sources.schema import clean_plays

PLAYS_EVENTS_SQL = """
SELECT event_id AS play_id, user_id, ts,
  CAST(round(value * 1000) AS BIGINT) AS ms_played,
  concat('track_', lpad(CAST(k AS VARCHAR(3)), 2, '0')) AS track,
  CASE WHEN k = 99 THEN NULL ELSE concat('artist_', lpad(CAST(k % 20 AS VARCHAR(3)), 2, '0')) END AS artist,
  CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN '' ELSE concat('album_', CAST(k % 20 AS VARCHAR(3))) END AS album,
  CASE event_type WHEN 'error' THEN true WHEN 'signup' THEN NULL ELSE false END AS skipped,
  (k % 2 = 0) AS shuffle, (k % 10 = 3) AS offline, (k % 50 = 7) AS incognito_mode,
  CASE k % 3 WHEN 0 THEN 'clickrow' WHEN 1 THEN 'trackdone' ELSE 'fwdbtn' END AS reason_start,
  CASE event_type WHEN 'purchase' THEN 'EndPlay' WHEN 'view' THEN 'trackdone' WHEN 'error' THEN 'fwdbtn' ELSE NULL END AS reason_end,
  CASE event_id % 7 WHEN 0 THEN 'Android OS 13 API 33 (samsung)' WHEN 1 THEN 'iOS 16.1 (iPhone13,2)'
    WHEN 2 THEN 'web_player windows 10;chrome' WHEN 3 THEN 'Windows 10 (10.0.19045; x64)' WHEN 4 THEN 'osx'
    WHEN 5 THEN 'Partner google cast_tv;Chromecast;;' ELSE NULL END AS platform,
  CASE user_id % 6 WHEN 0 THEN 'TR' WHEN 1 THEN 'DE' WHEN 2 THEN 'US' WHEN 3 THEN 'IN' WHEN 4 THEN 'ZZ' ELSE NULL END AS conn_country
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) AS b
"""

PLAYS_LINEITEM_SQL = """
SELECT o_custkey AS user_id, l_shipdate AS ts,
  CAST(round(l_extendedprice * 5) AS BIGINT) AS ms_played,
  concat('part_', CAST(l_partkey AS VARCHAR(20))) AS track,
  concat('supp_', CAST(l_suppkey AS VARCHAR(20))) AS artist,
  (l_returnflag = 'R') AS skipped
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

GRAPH_ITEM_SQL = """
SELECT play_id, user_id, ts, ms_played, track,
  CASE WHEN artist IS NULL THEN NULL ELSE concat(artist, '@', CAST(user_id % 40 AS VARCHAR(3))) END AS artist,
  album, skipped, shuffle, offline, incognito_mode, reason_start, reason_end, platform, conn_country
FROM (""" + PLAYS_EVENTS_SQL + """) AS g
"""

_TABLES = {
    "plays_events": ("events",),
    "plays_lineitem": ("lineitem", "orders"),
    "graph_item": ("events",),
}
_SQL = {
    "plays_events": PLAYS_EVENTS_SQL,
    "plays_lineitem": PLAYS_LINEITEM_SQL,
    "graph_item": GRAPH_ITEM_SQL,
}


def _parameterised(sql: str, tables) -> str:  # noqa: ANN001
    """The shared SQL text with ``{table}`` references for ``spark.sql(**dfs)``."""
    import re

    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return sql


def raw_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The raw (uncleaned) play-shaped rows of fixture ``name``.

    The test tables are passed to ``spark.sql`` as DataFrame arguments, so no
    session-wide temporary view is created or replaced."""
    tables = _TABLES[name]
    dfs = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    return spark.sql(_parameterised(_SQL[name], tables), **dfs)


def plays(spark: SparkSession, sf_dir: str, name: str = "plays_events") -> DataFrame:
    """Fixture ``name`` passed through :func:`clean_plays`."""
    return clean_plays(raw_view(spark, sf_dir, name))


def oracle_raw(name: str) -> str:
    return _SQL[name]
