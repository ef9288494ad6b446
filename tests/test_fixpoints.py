"""Label propagation to its fixpoint, clustering diagnostics, time buckets."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import constants as C
from cadenza.operators import cluster as CL
from cadenza.operators import graph as G
from cadenza.operators import sequence as S


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, weight long")


def test_chain_of_fifty_is_one_community(spark):
    e = _edges(spark, [(f"v{i:02d}", f"v{i + 1:02d}") for i in range(49)])
    rows = G.label_propagation(e).collect()
    assert {r.label for r in rows} == {"v00"} and len(rows) == 50 and all(r.converged for r in rows)
    cut = G.label_propagation(e, max_iter=10).collect()
    assert len({r.label for r in cut}) == 40 and not any(r.converged for r in cut)


def _labels_by_hand(pairs, self_vote, rounds):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set())
        near.setdefault(b, set())
        if a != b:
            near[a].add(b)
            near[b].add(a)
    label = {v: v for v in near}
    for _ in range(rounds):
        new = {}
        for v in near:
            votes = [label[u] for u in near[v]] + ([label[v]] if self_vote else [])
            new[v] = min(votes, key=lambda x: (-votes.count(x), x)) if votes else label[v]
        label = new
    return label


@pytest.mark.parametrize("self_vote", [True, False])
@pytest.mark.parametrize("share", [1.0, 0.0])
def test_frontier_gives_the_labels_of_full_rounds(spark, monkeypatch, self_vote, share):
    monkeypatch.setattr(G, "FRONTIER_SHARE", share)
    rng = np.random.default_rng(11)
    pairs = [(f"v{a:02d}", f"v{b:02d}") for a, b in rng.integers(0, 40, (60, 2))] + [(f"w{i}", f"w{i + 1}") for i in range(8)]
    rows = G.label_propagation(_edges(spark, pairs), max_iter=6, self_vote=self_vote).collect()
    assert {r.id: r.label for r in rows} == _labels_by_hand(pairs, self_vote, 6)


def test_frontier_is_what_lies_beside_a_change(spark):
    e = _edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")])
    lab = spark.createDataFrame([(x, "c" if x == "b" else x, x) for x in "abcde"], "id string, label string, _old string")
    e, ks = G.prepare(e, ())
    lab, _ = G.prepare(lab, ())
    for own, want in ((True, set("abc")), (False, set("ac"))):
        assert {r.id for r in G._frontier(G.undirected_neighbours(e, ks), lab, ks, own).collect()} == want


def test_oscillation_ends_and_is_told(spark):
    e = _edges(spark, [("a", "b")]).withColumn("g", F.lit(1)).union(
        _edges(spark, [("c", "d"), ("d", "e"), ("c", "e")]).withColumn("g", F.lit(2)))
    rows = {(r.g, r.id): (r.label, r.converged) for r in G.label_propagation(e, ("g",), self_vote=False).collect()}
    assert rows[1, "a"] == rows[1, "b"] == ("a", False)
    assert {rows[2, x] for x in "cde"} == {("c", True)}


def test_rounds_without_fixpoint_raise(spark):
    e = _edges(spark, [(f"v{i:02d}", f"v{i + 1:02d}") for i in range(30)])
    for method in ("star", "propagate"):
        with pytest.raises(RuntimeError):
            G.components(e, max_iter=1, method=method)
    with pytest.raises(RuntimeError):
        G.pagerank(e, max_iter=1)


def test_checkpoint_spacing_does_not_change_results(spark):
    e = _edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "f")])
    one = sorted((r.id, round(r["rank"], 12)) for r in G.pagerank(e, iterations=7).collect())
    two = sorted((r.id, round(r["rank"], 12)) for r in G.pagerank(e, iterations=7, checkpoint_every=3).collect())
    assert one == two
    assert sorted(G.components(e).collect()) == sorted(G.components(e, checkpoint_every=2).collect())


def test_sweep_and_choice(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(20 * (i % 3), 0.5, 15))) for i in range(30)]
    v = spark.createDataFrame(rows, ["user_id", *C.METRIC_KEYS])
    _, n, _, scaled = CL.prepare_vectors(v)
    table = CL.sweep(scaled, n, 2, 4, starts=2)
    assert [d["k"] for d in table] == [2, 3, 4] and all(d["clusters"] == d["k"] for d in table)
    assert CL.choose_k(table)[0] == 3
    assert CL.choose_k([{"k": 2, "silhouette": None}, {"k": 3, "silhouette": 0.5}, {"k": 4, "silhouette": 0.5}]) == (3, 0.5)
    assert CL.choose_k([]) == (2, None)
    assert [d["k"] for d in CL.sweep(scaled, 4, 2, 8, starts=1)] == [2, 3]
    few = CL.status_row(spark, CL.segment(v.limit(3))).first()
    assert tuple(few) == ("insufficient_data", 4, 3) == tuple(CL.pool_status(v.limit(3)).first())


def test_hot_keys_take_the_coarsest_unit_that_fits(spark):
    rows = [(1, f"2024-01-01 {h:02d}:{m:02d}:00") for h in range(24) for m in range(60)]          # 1,440 in a day
    rows += [(2, f"2024-{mo:02d}-{d:02d} 00:00:00") for mo in range(1, 13) for d in range(1, 28)]  # 27 a month
    rows += [(3, "2024-01-01 00:00:00")] * 5
    p = spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    units = {r.user_id: r["_unit"] for r in S.hot_units(p, ("user_id",), 60).collect()}
    assert units == {1: "hour", 2: "month"}
    assert {r.user_id: r["_unit"] for r in S.hot_units(p, ("user_id",), 1500).collect()} == {}
    assert {r.user_id: r["_unit"] for r in S.hot_units(p, ("user_id",), 4).collect()} == {1: "minute", 2: "day", 3: "minute"}


@pytest.mark.parametrize("hot", [0, 3, 40, 10 ** 6])
def test_buckets_do_not_change_sessions(spark, events_small, hot):
    want = S.sessions(events_small, ()).orderBy("start_ts", "end_ts").collect()
    assert S.sessions(events_small, (), hot_rows=hot).orderBy("start_ts", "end_ts").collect() == want


def test_building_a_sequence_runs_no_job(spark, events_small):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build-only", "plan building")
    S.gaps(events_small, ())
    S.sessions(events_small, ("user_id",))
    S.transitions(events_small, ("user_id",))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("build-only")) == 0


def test_fits_do_not_depend_on_partitions(spark):
    """Same centres however the rows are dealt; each fit is a fixpoint: rows
    at their nearest centre, centres at their rows' mean."""
    rng = np.random.default_rng(5)
    data = rng.normal(0, 1, (60, 15))
    rows = [(i, *map(float, x)) for i, x in enumerate(data)]
    seen = []
    for parts in (1, 7):
        v = spark.createDataFrame(rows, ["user_id", *C.METRIC_KEYS]).repartition(parts)
        _, n, stats, scaled = CL.prepare_vectors(v)
        fit = CL._lowest_cost(scaled.repartition(parts), 3, 3, 42, ["user_id"])
        seen.append([[round(x, 9) for x in c] for c in fit.centres])
        x = (data - data.mean(axis=0)) / data.std(axis=0)
        c = np.array(fit.centres)
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        assert abs(fit.cost - d.min(axis=1).sum()) < 1e-6 and fit.sizes == np.bincount(near).tolist()
        assert all(np.allclose(x[near == j].mean(axis=0), c[j], atol=1e-6) for j in range(3))
        assert [int(np.flatnonzero(near == j)[0]) for j in range(3)] == sorted(int(np.flatnonzero(near == j)[0]) for j in range(3))
        assert {r.user_id: r.cluster for r in CL.place(scaled, fit).collect()} == dict(enumerate(near.tolist()))
        scaled.unpersist()
    assert seen[0] == seen[1]


def test_fewer_values_than_centres(spark):
    """Six rows of two different vectors: no third centre can be drawn."""
    v = spark.createDataFrame([(i, *([float(i % 2)] * 15)) for i in range(6)], ["user_id", *C.METRIC_KEYS])
    seg = CL.segment(v, restarts=2, sweep_restarts=2)
    assert seg.k == 2 and seg.silhouette > 0.999 and [r["clusters"] for r in seg.diagnostics] == [2] * 4
    assert sorted(r.size for r in seg.clusters.collect()) == [3, 3]
    alike = CL.segment(spark.createDataFrame([(i, *([1.0] * 15)) for i in range(5)], ["user_id", *C.METRIC_KEYS]), restarts=1, sweep_restarts=1)
    assert alike.k == 2 and alike.silhouette is None and alike.clusters.count() == 1
