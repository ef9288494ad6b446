"""Small hand-made play tables for the edge cases of the operators."""

from __future__ import annotations

import pytest

from cadenza.operators import aggregates as A
from cadenza.operators import graph as G
from cadenza.operators import metrics as M
from cadenza.operators import rules as R
from cadenza.operators import sequence as S
from cadenza.sources.schema import from_records


def rec(ts, track="t1", artist="a1", ms=1000, user=1, **kw):
    r = {"user_id": user, "ts": ts, "ms_played": ms, "master_metadata_track_name": track,
         "master_metadata_album_artist_name": artist}
    r.update(kw)
    return r


def test_cleaning_drops_bad_rows_and_defaults(spark):
    df = from_records(spark, [
        rec("2024-01-01T10:00:00Z"),
        rec("not a time"),                          # bad ts -> dropped
        rec("2024-01-01T11:00:00Z", track=""),      # blank track -> dropped
        rec("2024-01-01T12:00:00Z", track=None),    # null track -> dropped
        rec("2024-01-01T13:00:00+03:00", artist=None, skipped=None, conn_country=None),
    ])
    rows = df.orderBy("ts").collect()
    assert len(rows) == 2
    assert str(rows[0].ts) == "2024-01-01 10:00:00" and rows[0].weekday == 0
    assert str(rows[1].ts) == "2024-01-01 10:00:00"  # +03:00 -> 10:00 UTC
    assert rows[1].artist == "Unknown" and rows[1].skipped is False and rows[1].conn_country == "Unknown"


def test_gap_of_exactly_30_minutes(spark):
    df = from_records(spark, [rec("2024-01-01T10:00:00Z", ms=0, artist="a"),
                              rec("2024-01-01T10:30:00Z", ms=0, artist="b"),
                              rec("2024-01-01T11:00:00.000001Z", ms=0, artist="c")])
    assert S.sessions(df, mode="end_to_end").count() == 2
    assert S.sessions(df, mode="end_to_start").count() == 2
    e = {(r.src, r.dst) for r in S.transitions(df).collect()}
    assert e == {("a", "b")}


def test_end_to_start_uses_play_start(spark):
    # second play ends 50 min later but started 40 min earlier: same session
    df = from_records(spark, [rec("2024-01-01T10:00:00Z", ms=0),
                              rec("2024-01-01T10:50:00Z", ms=40 * 60 * 1000)])
    assert S.sessions(df, mode="end_to_start").count() == 1
    assert S.sessions(df, mode="end_to_end").count() == 2


def test_sessions_across_midnight_buckets(spark):
    # plays every 20 minutes across a day border: one session in both modes
    recs = [rec(f"2024-01-01T23:{m:02d}:00Z", ms=0) for m in (0, 20, 40)]
    recs += [rec(f"2024-01-02T00:{m:02d}:00Z", ms=0) for m in (0, 20)]
    df = from_records(spark, recs)
    s = S.sessions(df).collect()
    assert len(s) == 1 and s[0].plays == 5


def test_ties_on_ts_are_ordered_by_track(spark):
    df = from_records(spark, [rec("2024-01-01T10:00:00Z", track="b"), rec("2024-01-01T10:00:00Z", track="a"),
                              rec("2024-01-01T10:01:00Z", track="c")])
    pairs = {(r.prev_track, r.track) for r in S.consecutive_pairs(df).collect()}
    assert pairs == {("a", "b"), ("b", "c")}


def test_one_play_listener(spark):
    df = from_records(spark, [rec("2024-01-01T10:00:00Z", ms=3_600_000)])
    p = M.user_profile(df).first()
    assert p.sessions == 1 and p.habit_loop_score_pct == 0.0 and p.calendar_days == 1
    assert p.listening_intensity_h_per_day == 1.0 and p.early_skip_rate_pct == 0.0
    assert p.skip_latency_ratio == 0.0 and p.exploration_score == 100.0


def test_null_skipped_counts_as_not_skipped_for_focus(spark):
    df = from_records(spark, [rec("2024-01-01T10:00:00Z", ms=300_000, skipped=None),
                              rec("2024-01-01T11:00:00Z", ms=300_000, skipped=False)])
    assert A.totals(df).first().focus_plays == 2


def test_empty_input(spark):
    df = from_records(spark, [rec("garbage")])
    assert df.count() == 0
    assert M.user_profile(df).count() == 0


def test_unknown_country_defaults_to_plus_three(spark):
    df = from_records(spark, [rec("2024-01-01T22:00:00Z", conn_country="ZZ", ms=1000)])
    p = M.user_profile(df).first()
    assert p.tz_offset == 3 and p.timezone == "UTC+3"
    assert p.night_listening_ratio_pct == 100.0  # 22h UTC = 01h local


def test_negative_offset_label(spark):
    df = from_records(spark, [rec("2024-01-01T03:00:00Z", conn_country="US")])
    p = M.user_profile(df).first()
    assert p.timezone == "UTC-5" and p.night_listening_ratio_pct == 0.0  # 22h local


def test_platform_categories(spark):
    from cadenza.functions.expressions import platform_category, platform_label

    rows = spark.createDataFrame([("Android OS 13 (x)",), ("web_player windows 10",), ("osx",), (None,),
                                  ("Partner google cast_tv;Chromecast;;",), ("A Very Long Platform Name Here",)],
                                 "platform string")
    got = rows.select(platform_category("platform"), platform_label("platform")).collect()
    assert [tuple(r) for r in got] == [
        ("Mobile", "Mobile"), ("Web", "Web"), ("Other", "osx"), ("Other", "Other"), ("Web", "Web"),
        ("Other", "a very long platform")]


def _profile_row(spark, **vals):
    from cadenza.functions import constants as C

    base = {m: 0.0 for m in C.METRIC_KEYS}
    base.update(dict(user_id=1, max_session_hours=0.0, top_song_hours=0.0, unique_artists=0, loyal_artists_5yr=0,
                     incognito_plays=0, known_countries=0, total_plays=0, offline_ratio_pct=0.0))
    base.update(vals)
    cols = list(base)
    return spark.createDataFrame([tuple(base[c] for c in cols)], cols)


@pytest.mark.parametrize("hours,level,title,nxt", [
    (10.0, 1, "Newbie", 50), (50.0, 1, "Casual", 200), (1234.5, 4, "Devotee", 1500), (5000.0, 10, "Transcendent", None),
])
def test_levels(spark, hours, level, title, nxt):
    r = R.levels(_profile_row(spark, total_hours=hours)).first()
    assert (r.level, r.title, r.next_threshold_hours) == (level, title, nxt)
    assert r.xp == int(hours * 10 + r.badges_earned * 50)


def test_badges_and_archetype_use_display_rounding(spark):
    # 25.04 shows as 25.0: not "> 25"
    p = _profile_row(spark, night_listening_ratio_pct=25.04, focus_session_score_pct=13.0, shuffle_pct=50.0,
                     impatience_score_pct=10.0)
    b = {r.badge: r.earned for r in R.badges(p).collect()}
    assert b["night_owl"] is False and len(b) == 15
    assert R.archetype(p).first().archetype == "The Deep Listener"
    p2 = _profile_row(spark, night_listening_ratio_pct=26.0, focus_session_score_pct=11.0)
    assert R.archetype(p2).first().archetype == "The Night Diver"


def test_radar_caps(spark):
    p = _profile_row(spark, impatience_score_pct=30.0, exploration_score=40.0, artist_diversity_entropy=5.0)
    r = R.radar(p).first()
    assert (r.patience, r.exploration, r.diversity) == (70.0, 100.0, 40.0)


def test_graph_summary_empty_and_reciprocity(spark):
    e = spark.createDataFrame([("a", "b", 2), ("b", "a", 1), ("a", "a", 1), ("b", "c", 1)],
                              "src string, dst string, weight bigint")
    s = G.summary(e).first()
    assert (s.nodes, s.edges, s.self_loops) == (3, 4, 1)
    assert s.reciprocity == 0.5 and s.density == 4 / 6
    deg = {r.id: r.weighted_degree for r in G.degrees(e).collect()}
    assert deg == {"a": 5, "b": 4, "c": 1}
