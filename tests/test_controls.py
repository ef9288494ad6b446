"""Control values of the fixture views (FIXTURES.md §2.3 and §3)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from cadenza.operators import aggregates as A
from cadenza.operators import graph as G
from cadenza.operators import sequence as S
from cadenza.sources import fixtures


def _totals(df):
    return A.totals(df, ()).first()


def test_plays_events_controls_small(events_small):
    t = _totals(events_small)
    assert (t.total_plays, t.total_ms, t.skipped_plays, t.completed_plays, t.early_skips, t.focus_plays) == (
        1000, 50_050_190, 201, 202, 92, 7)
    d = A.distinct_counts(events_small, ()).first()
    assert (d.unique_tracks, d.unique_artists) == (100, 21)


def test_plays_lineitem_controls_small(spark):
    t = _totals(fixtures.plays(spark, SF_SMALL, "plays_lineitem"))
    assert (t.total_plays, t.total_ms, t.skipped_plays, t.early_skips, t.focus_plays) == (
        6000, 1_586_823_920, 1968, 108, 2214)


@pytest.mark.parametrize("keys,mode,expected", [
    (("user_id",), "end_to_start", 945), ((), "end_to_start", 467),
    (("user_id",), "end_to_end", 946), ((), "end_to_end", 481),
])
def test_session_counts_small(events_small, keys, mode, expected):
    assert S.sessions(events_small, keys, mode).count() == expected


def test_session_counts_mid(events_mid):
    assert S.sessions(events_mid, ("user_id",), "end_to_start").count() == 9529
    assert S.sessions(events_mid, (), "end_to_start").count() == 12
    assert S.sessions(events_mid, (), "end_to_end").count() == 13


def _edge_stats(e):
    r = e.agg(F.count(F.lit(1)), F.sum("weight"), F.count_if(F.col("src") == F.col("dst"))).first()
    return tuple(r)


def test_edge_controls_small(events_small):
    assert _edge_stats(S.transitions(events_small, ("user_id",), group_keys=())) == (45, 51, 2)
    assert _edge_stats(S.transitions(events_small, ())) == (285, 513, 10)
    assert G.reciprocal_edges(S.transitions(events_small, ("user_id",), group_keys=())).count() == 2
    assert G.reciprocal_edges(S.transitions(events_small, ())).count() == 192


def test_pair_controls_small(events_small):
    per = S.habit_loop(events_small, ("user_id",)).agg(F.sum("repeated_pairs"), F.sum("all_pairs")).first()
    assert tuple(per) == (7, 985)
    whole = S.habit_loop(events_small, ()).first()
    assert (whole.repeated_pairs, whole.all_pairs) == (51, 999)


@pytest.mark.parametrize("sf,edges,weight,loops,nodes,sinks,comps,largest,lpa,lpa_largest", [
    (SF_SMALL, 51, 51, 2, 85, 39, 36, 8, 36, 8),
    (SF_MID, 433, 437, 17, 523, 181, 132, 18, 188, 9),
])
def test_graph_item_controls(spark, sf, edges, weight, loops, nodes, sinks, comps, largest, lpa, lpa_largest):
    e = S.transitions(fixtures.plays(spark, sf, "graph_item"), ("user_id",), group_keys=())
    assert _edge_stats(e) == (edges, weight, loops)
    deg = G.degrees(e)
    assert deg.count() == nodes
    assert deg.filter("out_degree = 0").count() == sinks
    cs = G.components(e).groupBy("component").count()
    assert cs.count() == comps and cs.agg(F.max("count")).first()[0] == largest
    ls = G.label_propagation(e).groupBy("label").count()
    assert ls.count() == lpa and ls.agg(F.max("count")).first()[0] == lpa_largest


def test_graph_item_lpa_without_own_vote_small(spark):
    e = S.transitions(fixtures.plays(spark, SF_SMALL, "graph_item"), ("user_id",), group_keys=())
    ls = G.label_propagation(e, max_iter=5, self_vote=False).groupBy("label").count()
    assert ls.count() == 72 and ls.agg(F.max("count")).first()[0] == 3


def test_pagerank_artist_graph_mid(events_mid):
    e = S.transitions(events_mid, ("user_id",), group_keys=())
    pr = G.pagerank(e, iterations=20)
    assert abs(pr.agg(F.sum("rank")).first()[0] - 1.0) < 1e-9
    top = G.top_pagerank(pr, 1).first()
    assert top.id == "artist_01" and round(top["rank"], 6) == 0.070973
