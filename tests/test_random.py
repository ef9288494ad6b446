"""Randomised checks against brute force: skewed keys, ties, sparse days."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cadenza.operators import percentiles as PC
from cadenza.operators import sequence as S
from cadenza.sources.schema import from_pandas, from_records

BASE = dt.datetime(2024, 1, 1)

plays_strategy = st.lists(
    st.tuples(
        st.sampled_from([1, 1, 1, 1, 2, 3]),          # user 1 is hot
        st.integers(0, 5 * 24 * 60),                   # minute offset over 5 days
        st.sampled_from(["a", "b", "c"]),              # track
        st.sampled_from(["x", "y"]),                   # artist
        st.integers(0, 3_600_000),                     # ms played
    ),
    min_size=1, max_size=60)


def _records(rows):
    return [{"user_id": u, "ts": (BASE + dt.timedelta(minutes=m)).isoformat() + "Z", "ms_played": ms,
             "master_metadata_track_name": t, "master_metadata_album_artist_name": a}
            for u, m, t, a, ms in rows]


def _brute_sessions(rows, mode):
    out = {}
    df = pd.DataFrame(rows, columns=["u", "m", "t", "a", "ms"]).sort_values(["u", "m", "t", "a", "ms"])
    for u, g in df.groupby("u"):
        n, prev = 0, None
        for r in g.itertuples():
            ts = BASE + dt.timedelta(minutes=r.m)
            start = ts - dt.timedelta(milliseconds=r.ms) if mode == "end_to_start" else ts
            if prev is None or (start - prev) > dt.timedelta(minutes=30):
                n += 1
            prev = ts
        out[u] = n
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=plays_strategy, hot=st.sampled_from([0, 5, None]), bucket=st.sampled_from(["hour", "day"]),
       mode=st.sampled_from(["end_to_start", "end_to_end"]))
def test_sessions_match_brute_force(spark, rows, hot, bucket, mode):
    df = from_records(spark, _records(rows))
    got = {r.user_id: r["count"] for r in
           S.sessions(df, ("user_id",), mode, bucket=bucket, hot_rows=hot).groupBy("user_id").count().collect()}
    assert got == _brute_sessions(rows, mode)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.sampled_from([0.0, 0.0, 0.0, 1.5, 2.0, -3.0, 7.25, 100.0]), min_size=1, max_size=80),
       buckets=st.sampled_from([2, 4, 16]))
def test_count_below_matches_brute_force(spark, values, buckets):
    df = spark.createDataFrame([("m", v) for v in values], "metric string, value double")
    got = {r.value: (r.below, r.total) for r in PC.count_below(df, buckets=buckets).collect()}
    for v in set(values):
        assert got[v] == (sum(1 for x in values if x < v), len(values))


def test_from_pandas_requires_derived_columns(spark):
    pdf = pd.DataFrame({"ts": ["2024-01-01T10:00:00Z"], "ms_played": [1000],
                        "master_metadata_track_name": ["t"], "master_metadata_album_artist_name": ["a"]})
    try:
        from_pandas(spark, pdf)
        raise AssertionError("expected a missing-column error")
    except ValueError as e:
        assert "year" in str(e)
    pdf = pdf.assign(year=2024, month=1, hour_utc=10, weekday=0)
    row = from_pandas(spark, pdf).first()
    assert row.track == "t" and row.weekday == 0 and row.hour_utc == 10
