"""The artist transition graph.

Graphs are edge tables ``(keys..., src, dst, weight)``; ``keys=()`` is one
pooled graph, ``keys=("user_id",)`` one graph per listener — every algorithm
runs all graphs of the table at once, keys are part of every join key.

Iterative algorithms are DataFrame loops: each round is a join of the (static,
written or persisted) edge table with the current vertex state followed by a
grouped aggregate, so hub vertices are pre-aggregated map-side and a hub's
edges are not gathered in one partition beforehand (AQE can split that join).
The state is cut from its lineage with ``checkpoint()`` (reliable, written to
the shared ``spark.checkpoint.dir``) every ``checkpoint_every`` rounds, so
plans stay small and a lost executor replays a few rounds at most; rounds
between are persisted and released.  Only per-round convergence scalars reach
the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import constants as C
from cadenza.operators.aggregates import top_k
from cadenza.operators.keys import finish, join_per_key, prepare
from cadenza.operators.skew import HOT_ROWS, hot_splits, split_join
from cadenza.session import cut_lineage

GRAPH_KEYS: tuple[str, ...] = ()


_cut = cut_lineage
#: Rounds between two checkpoints of an iterative operator; the rounds between
#: are persisted and released once a later one is written.  Nested persisted
#: plans cost the driver more than a checkpoint of the vertex state does
#: (measured with 1, 2 and 3), so the default is every round.
CHECKPOINT_EVERY = 1


class _Rounds:
    """State tables of a loop: every ``every``-th is checkpointed (plans stay
    small, a lost executor replays a few rounds at most), the others are
    persisted until the next checkpoint holds what follows from them."""

    def __init__(self, every: int):
        self.every, self.n, self.held = every, 0, []

    def keep(self, df: DataFrame, last: bool = False) -> DataFrame:
        self.n += 1
        if last or self.n % self.every == 0:
            out = _cut(df)
            self.release()
            return out
        out = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.held.append(out)
        return out

    def release(self) -> None:
        for x in self.held:
            x.unpersist()
        self.held = []


def vertices(edges: DataFrame, keys: Sequence[str] = GRAPH_KEYS) -> DataFrame:
    """distinct(src ∪ dst)."""
    e, ks = prepare(edges, keys)
    out = e.select(*ks, F.col("src").alias("id")).union(e.select(*ks, F.col("dst").alias("id"))).distinct()
    return finish(out, keys)


def undirected_neighbours(edges: DataFrame, keys: Sequence[str] = GRAPH_KEYS) -> DataFrame:
    """Distinct neighbour pairs ``(a, b)``, both directions, no self pairs."""
    e, ks = prepare(edges, keys)
    nb = e.filter(F.col("src") != F.col("dst"))
    out = nb.select(*ks, F.col("src").alias("a"), F.col("dst").alias("b")).union(
        nb.select(*ks, F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    return finish(out, keys)


def degrees(edges: DataFrame, keys: Sequence[str] = GRAPH_KEYS) -> DataFrame:
    """in/out degree (edge counts), in/out weight and undirected weighted
    degree (both directions summed; a self-loop counts twice)."""
    e, ks = prepare(edges, keys)
    ends = e.select(*ks, F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"),
                    F.col("weight").alias("ow"), F.lit(0).cast("bigint").alias("iw")).union(
        e.select(*ks, F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"),
                 F.lit(0).cast("bigint").alias("ow"), F.col("weight").alias("iw")))
    out = ends.groupBy(*ks, "id").agg(
        F.sum("i").cast("bigint").alias("in_degree"), F.sum("o").cast("bigint").alias("out_degree"),
        F.sum("iw").alias("in_weight"), F.sum("ow").alias("out_weight"),
        (F.sum("iw") + F.sum("ow")).alias("weighted_degree"))
    return finish(out, keys)


def reciprocal_edges(edges: DataFrame, keys: Sequence[str] = GRAPH_KEYS) -> DataFrame:
    """Non-loop edges whose reverse edge exists (self equi-join)."""
    e, ks = prepare(edges, keys)
    fwd = e.filter(F.col("src") != F.col("dst"))
    rev = fwd.select(*ks, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return finish(fwd.join(rev, [*ks, "src", "dst"], "left_semi"), keys)


def summary(edges: DataFrame, keys: Sequence[str] = GRAPH_KEYS) -> DataFrame:
    """Nodes, edges, density, average in/out degree, self-loops,
    reciprocity; zeros for an empty graph."""
    e, ks = prepare(edges, keys)
    m = e.groupBy(*ks).agg(F.count(F.lit(1)).alias("edges"),
                           F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))
    n = vertices(e, ks).groupBy(*ks).agg(F.count(F.lit(1)).alias("nodes"))
    r = reciprocal_edges(e, ks).groupBy(*ks).agg(F.count(F.lit(1)).alias("_recip"))
    s = m.join(n, ks).join(r, ks, "left")
    out = s.select(
        *ks, "nodes", "edges",
        F.coalesce(F.try_divide(F.col("edges").cast("double"), F.col("nodes") * (F.col("nodes") - 1)),
                   F.lit(0.0)).alias("density"),
        (F.col("edges") / F.col("nodes")).alias("avg_in_degree"),
        (F.col("edges") / F.col("nodes")).alias("avg_out_degree"),
        "self_loops",
        (F.coalesce(F.col("_recip"), F.lit(0)) / F.col("edges")).alias("reciprocity"))
    return finish(out, keys)


# ------------------------------------------------------------------ PageRank
def _blocked(edges: DataFrame, degree: DataFrame, ks: list[str], at: str, n: str,
             hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges with ``_block``, and the blocks of each vertex that has several
    (None if none has): the edges at a hub (more than ``hot_rows``) are dealt
    over blocks by a hash, once for all rounds; a round sends the hub's state
    to each."""
    hubs = _cut(hot_splits(degree, [*ks, at], n, hot_rows))
    if hubs.isEmpty():
        return edges.withColumn("_block", F.lit(0)), None
    block = F.when(F.col("_splits").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*edges.columns), F.col("_splits")).cast("int"))
    blocked = edges.join(F.broadcast(hubs), [*ks, at], "left").withColumn("_block", block).drop("_splits")
    return blocked, hubs.select(*ks, at, F.explode(F.sequence(F.lit(1), F.col("_splits") - 1)).alias("_block"))


def _meet(edges: DataFrame, state: DataFrame, more: DataFrame | None, ks: list[str], at: str) -> DataFrame:
    """Blocked edges joined with ``state`` (one row per vertex), which goes to
    block 0 and, for hubs, to their others."""
    if more is None:
        return edges.join(state, [*ks, at])
    spread = state.withColumn("_block", F.lit(0)).unionByName(state.join(F.broadcast(more), [*ks, at]))
    return edges.join(spread, [*ks, at, "_block"])


def pagerank(edges: DataFrame, keys: Sequence[str] = GRAPH_KEYS, damping: float = C.PAGERANK_DAMPING,
             max_iter: int = C.PAGERANK_MAX_ITER, tol: float = C.PAGERANK_TOL, iterations: int | None = None,
             weighted: bool = True, checkpoint_every: int = CHECKPOINT_EVERY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Weighted PageRank, ranks sum to 1 per graph.

    ``x' = d * sum(x[u] * w(u,v) / outw(u)) + d * dangling_mass / N + (1-d) / N``.
    Each graph keeps the ranks of the first round whose L1 change is below
    ``N * tol`` (graphs of one table converge independently); the loop ends
    when all have converged and raises after ``max_iter`` rounds without.
    ``iterations`` runs exactly that many rounds.
    ``weighted=False`` treats every edge as weight 1.

    A round is one join of the edges with the ranks and one grouped sum.  The
    edges are laid out once by source and, for sources with more than
    ``hot_rows`` edges, block, so a round moves the ranks and the partial sums
    of each part, not the edges.
    """
    e, ks = prepare(edges, keys)
    # the edge table feeds vertices, out-weights and the normalised edges:
    # materialise it once instead of replaying the plan that built it
    e = _cut(e.select(*ks, "src", "dst", (F.col("weight") if weighted else F.lit(1)).alias("weight")))
    v = vertices(e, ks)
    n = v.groupBy(*ks).agg(F.count(F.lit(1)).alias("_n"))
    outw = e.groupBy(*ks, "src").agg(F.sum("weight").alias("_ow"), F.count(F.lit(1)).alias("_od"))
    blocked, more = _blocked(e, outw, ks, "src", "_od", hot_rows)
    en = (_meet(blocked, outw.select(*ks, "src", "_ow"), more, ks, "src")
          .select(*ks, "src", "_block", "dst", (F.col("weight") / F.col("_ow")).alias("_p"))
          .repartition(*ks, "src", *(["_block"] if more else [])).persist(StorageLevel.MEMORY_AND_DISK))
    r = _cut(join_per_key(v, n, ks, keys).join(
        outw.select(*ks, F.col("src").alias("id"), F.lit(False).alias("_dangling")), [*ks, "id"], "left").select(
        *ks, "id", "_n", F.coalesce("_dangling", F.lit(True)).alias("_dangling"),
        (F.lit(1.0) / F.col("_n")).alias("rank"), F.lit(False).alias("_done")))
    rounds, state = iterations if iterations is not None else max_iter, _Rounds(checkpoint_every)
    converged = iterations is not None or r.isEmpty()
    for i in range(0 if converged and iterations is None else rounds):
        contrib = _meet(en, r.select(*ks, F.col("id").alias("src"), "rank"), more, ks, "src").groupBy(
            *ks, F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("_p")).alias("_c"))
        dm = r.filter("_dangling").groupBy(*ks).agg(F.sum("rank").alias("_dm"))
        step = (F.lit(damping) * F.coalesce("_c", F.lit(0.0))
                + F.lit(damping) * F.coalesce("_dm", F.lit(0.0)) / F.col("_n")
                + F.lit(1.0 - damping) / F.col("_n"))
        new = join_per_key(r.select(*ks, "id", "_n", "_dangling", "_done", F.col("rank").alias("_old")).join(
            contrib, [*ks, "id"], "left"), dm, ks, keys, "left").select(
            *ks, "id", "_n", "_dangling", "_done", "_old",
            # a graph that has converged keeps the ranks of its converging round
            F.when(F.col("_done"), F.col("_old")).otherwise(step).alias("rank"))
        new = state.keep(new, last=i + 1 == rounds)
        if iterations is not None:
            r = new.drop("_old")
            continue
        # per graph: converged once its L1 change is below N * tol
        conv = new.groupBy(*ks).agg(
            (F.sum(F.abs(F.col("rank") - F.col("_old"))) < F.first("_n") * F.lit(tol)).alias("_now")).persist(
            StorageLevel.MEMORY_AND_DISK)
        state.held.append(conv)
        if conv.filter(~F.col("_now")).isEmpty():
            r, converged = new.drop("_old"), True
            break
        r = join_per_key(new.drop("_old", "_done"), conv.withColumnRenamed("_now", "_done"), ks, keys)
    if not converged:
        raise RuntimeError(f"pagerank: not converged after {max_iter} rounds")
    out = _cut(r.select(*ks, "id", "rank"))
    state.release()
    en.unpersist()
    return finish(out, keys)


def pagerank_unweighted(edges: DataFrame, keys: Sequence[str] = GRAPH_KEYS, reset: float = 0.15,
                        iterations: int = 20, checkpoint_every: int = CHECKPOINT_EVERY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The GraphFrames/GraphX static PageRank: weights ignored, start at 1,
    ``x' = reset + (1 - reset) * sum(x[u] / outdeg(u))``, then scaled so the
    ranks of each graph sum to N."""
    e, ks = prepare(edges, keys)
    e = _cut(e.select(*ks, "src", "dst").distinct())
    v = vertices(e, ks)
    outd = e.groupBy(*ks, "src").agg(F.count(F.lit(1)).alias("_od"))
    blocked, more = _blocked(e, outd, ks, "src", "_od", hot_rows)
    en = _meet(blocked, outd, more, ks, "src").select(
        *ks, "src", "_block", "dst", (F.lit(1.0) / F.col("_od")).alias("_p")).repartition(*ks, "src", *(["_block"] if more else [])).persist(
        StorageLevel.MEMORY_AND_DISK)
    r = _cut(v.select(*ks, "id", F.lit(1.0).alias("rank")))
    state = _Rounds(checkpoint_every)
    for i in range(iterations):
        contrib = _meet(en, r.select(*ks, F.col("id").alias("src"), "rank"), more, ks, "src").groupBy(
            *ks, F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("_p")).alias("_c"))
        new = r.select(*ks, "id").join(contrib, [*ks, "id"], "left").select(
            *ks, "id", (F.lit(reset) + F.lit(1.0 - reset) * F.coalesce("_c", F.lit(0.0))).alias("rank"))
        r = state.keep(new, last=i + 1 == iterations)
    en.unpersist()
    tot = r.groupBy(*ks).agg(F.sum("rank").alias("_s"), F.count(F.lit(1)).alias("_n"))
    out = join_per_key(r, tot, ks, keys).select(*ks, "id", (F.col("rank") * F.col("_n") / F.col("_s")).alias("rank"))
    return finish(out, keys)


def top_pagerank(ranks: DataFrame, k: int = C.PAGERANK_TOP_K, keys: Sequence[str] = GRAPH_KEYS) -> DataFrame:
    """Top-k vertices by rank (ties by id), ranked 1..k."""
    return top_k(ranks, "rank", k, keys, tiebreak=["id"], rank_col="position")


# ---------------------------------------------------- label propagation / WCC
#: Only vertices beside a change vote once at most this share of them changed.
FRONTIER_SHARE = 0.25


def _frontier(nb: DataFrame, lab: DataFrame, ks: list[str], self_vote: bool) -> DataFrame:
    """(keys, id) of the vertices whose vote may differ in the next round: the
    neighbours of those whose label changed and, where they vote for their own
    label, these themselves."""
    moved = lab.filter(F.col("label") != F.col("_old")).select(*ks, "id")
    beside = nb.join(moved.withColumnRenamed("id", "b"), [*ks, "b"], "left_semi").select(*ks, F.col("a").alias("id"))
    return (beside.union(moved) if self_vote else beside).distinct()


def label_propagation(edges: DataFrame, keys: Sequence[str] = GRAPH_KEYS, max_iter: int | None = None,
                      self_vote: bool = True, checkpoint_every: int = CHECKPOINT_EVERY) -> DataFrame:
    """Synchronous label propagation on the undirected graph:
    (keys, id, label, converged).

    Every vertex starts with its own id; each round it takes the label most
    frequent among its distinct neighbours (plus one vote for its own label
    when ``self_vote``), ties to the smallest label.  A vertex beside no change
    would vote as before, so once few labels change only the others vote.
    Rounds go on to the fixpoint, however many it takes.  Synchronous rounds can also swing for
    ever (the GraphFrames form ``self_vote=False`` does on any edge): when the
    whole labelling was seen before, the loop ends, and in the graphs that
    still change each vertex takes the smaller of its last two labels and
    ``converged`` is false.  ``max_iter`` runs that many rounds instead, if no
    fixpoint comes first (graphs that changed in the last one are not
    converged)."""
    e, ks = prepare(edges, keys)
    # read by neighbours and vertices: materialised once, as in pagerank
    e = _cut(e.select(*ks, "src", "dst"))
    nb = _cut(undirected_neighbours(e, ks))
    lab = _cut(vertices(e, ks).select(*ks, "id", F.col("id").alias("label"), F.col("id").alias("_old")))
    state, seen, cycle, i, active = _Rounds(checkpoint_every), set(), False, 0, None
    while max_iter is None or i < max_iter:
        before = lab.select(*ks, "id", "label")
        asked, own = nb, before
        if active is not None:
            asked = nb.join(active.withColumnRenamed("id", "a"), [*ks, "a"], "left_semi")
            own = before.join(active, [*ks, "id"], "left_semi")
        votes = asked.join(before.select(*ks, F.col("id").alias("b"), "label"), [*ks, "b"]).select(
            *ks, F.col("a").alias("id"), "label")
        if self_vote:
            votes = votes.union(own)
        counts = votes.groupBy(*ks, "id", "label").agg(F.count(F.lit(1)).alias("_v"))
        best = counts.groupBy(*ks, "id").agg(
            F.min_by("label", F.struct((-F.col("_v")).alias("v"), F.col("label").alias("l"))).alias("_new"))
        lab = state.keep(before.join(best, [*ks, "id"], "left").select(
            *ks, "id", F.coalesce("_new", "label").alias("label"), F.col("label").alias("_old")))
        i += 1
        changed, mark, n = lab.agg(F.count_if(F.col("label") != F.col("_old")),
                                   F.sum(F.xxhash64(*ks, "id", "label").cast("decimal(38,0)")), F.count(F.lit(1))).first()
        if not changed:
            break
        if max_iter is None and mark in seen:
            cycle = True
            break
        seen.add(mark)
        active = _frontier(nb, lab, ks, self_vote) if changed <= n * FRONTIER_SHARE else None
    moving = lab.filter(F.col("label") != F.col("_old")).select(*ks).distinct().withColumn("_moving", F.lit(True))
    lab = lab.withColumn("label", F.least("label", "_old")) if cycle else lab
    out = _cut(join_per_key(lab.select(*ks, "id", "label"), moving, ks, keys, "left").select(
        *ks, "id", "label", F.col("_moving").isNull().alias("converged")))
    state.release()
    return finish(out, keys)


def components(edges: DataFrame, keys: Sequence[str] = GRAPH_KEYS, max_iter: int = 1000,
               method: str = "star", checkpoint_every: int = CHECKPOINT_EVERY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Weakly connected components; ``component`` = smallest vertex id of
    the component.

    ``method="star"`` (default) alternates the large-star and small-star edge
    rewrites of Kiveris et al. (2014): every round is a grouped min plus one
    join that emits at most one edge per input edge, and the number of rounds
    grows with log(n) instead of the graph diameter.  A vertex with more than
    ``hot_rows`` edges, the centre of a giant component in the end, is split
    by the counts of each round (:func:`split_join`).  ``method="propagate"``
    is plain min-label propagation (rounds = diameter)."""
    if method == "propagate":
        return _components_by_propagation(edges, keys, max_iter, checkpoint_every)
    e, ks = prepare(edges, keys)
    # undirected simple edges as (a, b) with a > b
    cur = _cut(e.filter(F.col("src") != F.col("dst")).select(
        *ks, F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    state, seen, done = _Rounds(checkpoint_every), _edge_mark(cur, ks), False
    for _ in range(max_iter):
        both = cur.select(*ks, F.col("a").alias("u"), F.col("b").alias("v")).union(
            cur.select(*ks, F.col("b").alias("u"), F.col("a").alias("v")))
        # large star: connect every larger neighbour of u to min(u, neighbours of u)
        m = both.groupBy(*ks, "u").agg(F.min("v").alias("_mv"), F.count(F.lit(1)).alias("_n")).select(
            *ks, "u", F.least("u", "_mv").alias("_m"), "_n")
        large = split_join(both, m, [*ks, "u"], "_n", hot_rows).filter(F.col("v") > F.col("u")).select(
            *ks, F.col("v").alias("a"), F.col("_m").alias("b")).distinct()
        # small star: connect u and its smaller neighbours to the smallest of them
        both = large.select(*ks, F.col("a").alias("u"), F.col("b").alias("v"))  # a > b: v < u
        m = both.groupBy(*ks, "u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n"))
        small = split_join(both, m, [*ks, "u"], "_n", hot_rows).select(*ks, F.col("v").alias("x"), "_m", "u")
        emitted = small.select(*ks, F.col("x").alias("a"), F.col("_m").alias("b")).union(
            small.select(*ks, F.col("u").alias("a"), F.col("_m").alias("b")))
        cur = state.keep(emitted.filter(F.col("a") != F.col("b")).distinct())
        mark = _edge_mark(cur, ks)
        if mark == seen:
            done = True
            break
        seen = mark
    if not done:
        raise RuntimeError(f"components: no fixpoint after {max_iter} rounds")
    # stars: every non-centre vertex points at its component's smallest id
    centre = cur.groupBy(*ks, F.col("a").alias("id")).agg(F.min("b").alias("_c"))
    out = _cut(vertices(e, ks).join(centre, [*ks, "id"], "left").select(
        *ks, "id", F.coalesce("_c", "id").alias("component")))
    state.release()
    return finish(out, keys)


def _edge_mark(edges: DataFrame, ks: Sequence[str]) -> tuple:
    """Count and summed hash of distinct edges: equal marks, equal tables."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*ks, "a", "b").cast("decimal(38,0)"))).first())


def _components_by_propagation(edges: DataFrame, keys: Sequence[str], max_iter: int,
                               checkpoint_every: int) -> DataFrame:
    e, ks = prepare(edges, keys)
    nb = _cut(undirected_neighbours(e, ks))
    comp = _cut(vertices(e, ks).select(*ks, "id", F.col("id").alias("component")))
    state = _Rounds(checkpoint_every)
    for _ in range(max_iter):
        cand = nb.join(comp.select(*ks, F.col("id").alias("b"), "component"), [*ks, "b"]).groupBy(
            *ks, F.col("a").alias("id")).agg(F.min("component").alias("_m"))
        new = state.keep(comp.join(cand, [*ks, "id"], "left").select(
            *ks, "id", F.least("component", F.coalesce("_m", "component")).alias("component"),
            F.col("component").alias("_old")))
        comp = new.drop("_old")
        if new.filter(F.col("component") != F.col("_old")).isEmpty():
            out = _cut(comp)
            state.release()
            return finish(out, keys)
    raise RuntimeError(f"components: no fixpoint after {max_iter} rounds")


def _collect_top(df: DataFrame, group: Sequence[str], order: list[Column], k: int, value: str,
                 out: str) -> DataFrame:
    """The first ``k`` values of each group in ``order`` as an array (k is a
    small fixed bound, applied before collecting)."""
    w = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return ranked.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", value))), lambda s: s[value]).alias(out))


def communities(edges: DataFrame, labels: DataFrame, keys: Sequence[str] = GRAPH_KEYS,
                top: int = C.COMMUNITY_TOP_K, members: int = C.COMMUNITY_MEMBERS) -> DataFrame:
    """Per community: size, weight (sum of members' weighted degree),
    top members by weighted degree (ties by id); the ``top`` heaviest
    communities are kept and numbered 0.. in that order (``community``)."""
    e, ks = prepare(edges, keys)
    lab, _ = prepare(labels, keys)
    wd = degrees(e, ks).select(*ks, "id", "weighted_degree")
    m = lab.join(wd, [*ks, "id"], "left").fillna(0, ["weighted_degree"])
    agg = m.groupBy(*ks, "label").agg(F.count(F.lit(1)).alias("size"),
                                      F.sum("weighted_degree").alias("weight"))
    tops = _collect_top(m, [*ks, "label"], [F.col("weighted_degree").desc(), F.col("id")], members, "id",
                        "top_members")
    ranked = top_k(agg, "weight", top, ks, tiebreak=["label"], rank_col="_pos")
    out = ranked.join(tops, [*ks, "label"]).select(
        *ks, (F.col("_pos") - 1).alias("community"), "label", "size", "weight", "top_members")
    return finish(out, keys)


def community_members(labels: DataFrame, keys: Sequence[str] = GRAPH_KEYS, top: int = 20,
                      members: int = C.COMMUNITY_MEMBERS) -> DataFrame:
    """The ``top`` largest communities (ties by label) with their size and
    first ``members`` member ids in id order."""
    lab, ks = prepare(labels, keys)
    sizes = lab.groupBy(*ks, "label").agg(F.count(F.lit(1)).alias("size"))
    ranked = top_k(sizes, "size", top, ks, tiebreak=["label"], rank_col="position")
    first = _collect_top(lab, [*ks, "label"], [F.col("id")], members, "id", "members")
    return finish(ranked.join(first, [*ks, "label"]), keys)


def component_summary(comps: DataFrame, keys: Sequence[str] = GRAPH_KEYS, top: int = C.COMPONENT_TOP_K,
                      sample: int = C.COMPONENT_SAMPLE) -> DataFrame:
    """Count and largest size per graph, plus the ``top`` largest
    components with ``sample`` member ids in alphabetical order."""
    c, ks = prepare(comps, keys)
    sizes = c.groupBy(*ks, "component").agg(F.count(F.lit(1)).alias("size"))
    stats = sizes.groupBy(*ks).agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("largest_size"))
    ranked = top_k(sizes, "size", top, ks, tiebreak=["component"], rank_col="position")
    samples = _collect_top(c, [*ks, "component"], [F.col("id")], sample, "id", "sample_members")
    out = join_per_key(ranked.join(samples, [*ks, "component"]), stats, ks, keys)
    return finish(out, keys)


def display_subgraph(edges: DataFrame, ranks: DataFrame, comms: DataFrame, keys: Sequence[str] = GRAPH_KEYS,
                     top_n: int = C.DISPLAY_TOP_N) -> tuple[DataFrame, DataFrame]:
    """nodes = top-``top_n`` PageRank vertices with the number of
    the heaviest listed community naming them among its top members (else -1);
    edges = their non-loop edges, heaviest ``max(80, 2*top_n)`` (ties by ids)."""
    e, ks = prepare(edges, keys)
    r, _ = prepare(ranks, keys)
    cm, _ = prepare(comms, keys)
    keep = top_pagerank(r, top_n, ks).select(*ks, "id", "rank")
    member_of = cm.select(*ks, "community", F.explode("top_members").alias("id")).groupBy(*ks, "id").agg(
        F.min("community").alias("community"))
    nodes = keep.join(member_of, [*ks, "id"], "left").select(
        *ks, "id", "rank", F.coalesce("community", F.lit(-1)).alias("community"))
    k_src = keep.select(*ks, F.col("id").alias("src"))
    k_dst = keep.select(*ks, F.col("id").alias("dst"))
    sub = e.filter(F.col("src") != F.col("dst")).join(k_src, [*ks, "src"], "left_semi").join(
        k_dst, [*ks, "dst"], "left_semi")
    w = Window.partitionBy(*ks).orderBy(F.col("weight").desc(), "src", "dst")
    cap = max(C.DISPLAY_MIN_EDGES, 2 * top_n)
    sub = sub.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_r")
    return finish(nodes, keys), finish(sub, keys)
