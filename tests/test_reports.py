"""R8 / G10 report rows agree with the (oracle-checked) standalone operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import SF_SMALL
from cadenza.operators import aggregates as A
from cadenza.operators import graph as G
from cadenza.operators import metrics as M
from cadenza.operators import rules as R
from cadenza.operators import sequence as S
from cadenza.plans.report import graph_report, report
from cadenza.sources import fixtures


def test_report_pieces_match_operators(events_small):
    rep = {r.user_id: r for r in report(events_small).collect()}
    prof = {r.user_id: r for r in M.user_profile(events_small).collect()}
    assert set(rep) == set(prof)
    top = {}
    for r in A.top_artists(events_small, 20).collect():
        top.setdefault(r.user_id, []).append((r["rank"], r.artist, r.plays))
    circ = {}
    for r in M.circadian(events_small).collect():
        circ.setdefault(r.user_id, {})[r.local_hour] = round(r.hours, 1)
    wd = {}
    for r in M.weekday_profile(events_small).collect():
        wd.setdefault(r.user_id, {})[r.weekday] = round(r.hours, 1)
    arch = {r.user_id: r.archetype for r in R.archetype(M.user_profile(events_small)).collect()}
    for uid, r in rep.items():
        assert [(a["rank"], a.artist, a.plays) for a in r.top_artists] == sorted(top[uid])
        assert {h.local_hour: h.hours for h in r.circadian_hours} == circ[uid]
        assert {h.weekday: h.hours for h in r.weekdays} == wd[uid]
        assert len(r.badges) == 15 and r.archetype == arch[uid]
        assert r.summary.total_plays == prof[uid].total_plays
        assert r.summary_json.startswith("{") and '"top5_artists"' in r.summary_json


def test_report_years_and_growth(spark):
    plays = fixtures.plays(spark, SF_SMALL, "plays_lineitem")
    rep = report(plays, ()).first()
    ys = A.by_dimension(plays, ["year"], ()).orderBy("year").collect()
    assert [(y.year, y.plays) for y in rep.years] == [(y.year, y.plays) for y in ys]
    g = S.yearly_growth(plays, ()).orderBy("year").collect()
    assert [x.year for x in rep.yearly_growth_pct] == [x.year for x in g]


def test_graph_report_pieces(spark):
    e = S.transitions(fixtures.plays(spark, SF_SMALL, "graph_item"), ("user_id",), group_keys=())
    rep = graph_report(e).first()
    s = G.summary(e).first()
    assert rep.summary.nodes == s.nodes and rep.summary.edges == s.edges
    comps = G.components(e).groupBy("component").count()
    assert rep.components == comps.count() and rep.largest_size == comps.agg(F.max("count")).first()[0]
    assert len(rep.pagerank) == 20 and len(rep.top_components) == 5
    assert abs(sum(p.score for p in rep.pagerank) - G.top_pagerank(G.pagerank(e)).agg(F.sum("rank")).first()[0]) < 1e-4
    assert len(rep.display_nodes) <= 60 and all(x.src != x.dst for x in rep.display_edges)
