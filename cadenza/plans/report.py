"""Whole reports, one row per key.

Report rows are assembled from the operator outputs by joins on the keys.
Every list inside a row has a fixed bound (top 20 artists/songs, 24 hours,
7 weekdays, 15 badges, years of the time span), and is collected only after
that bound is applied, so no unbounded group is gathered into one task.
Rounding for display happens here and only here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import constants as C
from cadenza.operators import aggregates as A
from cadenza.operators import graph as G
from cadenza.operators import metrics as M
from cadenza.operators import rules as R
from cadenza.operators.keys import DEFAULT_KEYS, finish, prepare
from cadenza.operators.rules import DISPLAY_DIGITS
from cadenza.session import cut_lineage


def _listed(df: DataFrame, ks: list[str], order: str, fields: Sequence[Column | str], name: str) -> DataFrame:
    """Bounded rows per key -> one array sorted by ``order``."""
    return df.groupBy(*ks).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("v")))),
                    lambda s: s["v"]).alias(name))


def report(plays: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Per key: summary, metrics (display rounding), top lists, years,
    weekdays, local circadian hours, yearly growth, badges, level, archetype,
    radar, plus ``summary_json`` (the compact payload as JSON text).

    Everything is derived from the three passes of
    :func:`metrics.profile_tables` (no further scans of the plays)."""
    d, ks = prepare(plays, keys)
    t = M.profile_tables(d, ks)
    # one row per key, read by five consumers (display, badges, levels,
    # archetype, radar): written once instead of re-assembled by each
    prof = cut_lineage(M.user_profile(d, ks, tables=t))
    shown = R.displayed(prof)
    h2 = lambda c: F.bround(F.col(c), 2)
    h1 = lambda c: F.bround(F.col(c), 1)
    top_a = A.top_k(t["artists"], "ms", C.TOP_LIST_SIZE, ks, tiebreak=["artist"]).withColumn(
        "hours", F.col("ms") / F.lit(3_600_000.0)).withColumn(
        "skip_pct", F.lit(100.0) * F.col("skips") / F.col("plays"))
    top_a = _listed(top_a, ks, "rank",
                    ["rank", "artist", h1("hours").alias("hours"), "plays", h1("skip_pct").alias("skip_pct")],
                    "top_artists")
    top_s = A.top_k(t["tracks"], "ms", C.TOP_LIST_SIZE, ks, tiebreak=["track", "artist"]).withColumn(
        "hours", F.col("ms") / F.lit(3_600_000.0))
    top_s = _listed(top_s, ks, "rank", ["rank", "track", "artist", h1("hours").alias("hours")], "top_songs")
    years = _listed(M.years(t), ks, "year", ["year", "plays", h1("hours").alias("hours")], "years")
    wdays = _listed(M.weekdays(t), ks, "weekday", ["weekday", h1("hours").alias("hours")], "weekdays")
    circ = _listed(M.local_hours(t, keys), ks, "local_hour", ["local_hour", h1("hours").alias("hours")],
                   "circadian_hours")
    growth = _listed(M.growth(t), ks, "year", ["year", h1("growth_pct").alias("growth_pct")],
                     "yearly_growth_pct")
    badges = _listed(R.badges(prof, ks), ks, "badge_order", ["badge", "name", "description", "earned"], "badges")
    lvl = R.levels(prof, ks)
    arch = R.archetype(prof, ks)
    radar = R.radar(prof, ks)
    radar = radar.select(*ks, F.struct(*[c for c in radar.columns if c not in ks]).alias("radar"))
    summary_cols = [
        "total_plays", h2("total_hours").alias("total_hours"), h1("day_equivalent").alias("day_equivalent"),
        "completed_plays", "skipped_plays", "sessions", h2("avg_session_hours").alias("avg_session_hours"),
        "shuffle_pct", h1("offline_hours").alias("offline_hours"), "offline_ratio_pct", "incognito_plays",
        "calendar_days", "first_year", "last_year", "unique_artists", "unique_tracks"]
    metric_cols = [c for c in DISPLAY_DIGITS if c not in ("shuffle_pct", "offline_ratio_pct")] + ["timezone"]
    base = shown.select(*ks, F.struct(*summary_cols).alias("summary"), F.struct(*metric_cols).alias("metrics"))
    out = base
    for part in (top_a, top_s, years, wdays, circ, growth, badges, lvl, arch, radar):
        out = out.join(part, ks, "left")
    compact = F.struct(
        F.col("summary.total_hours").alias("total_hours"), F.col("summary.total_plays").alias("total_plays"),
        F.col("title").alias("level"), F.col("archetype"),
        *[F.col(f"metrics.{m}").alias(m) for m in (
            "impatience_score_pct", "completion_rate_pct", "exploration_score", "artist_diversity_entropy",
            "night_listening_ratio_pct", "focus_session_score_pct", "artist_loyalty_score_pct",
            "habit_loop_score_pct", "listening_intensity_h_per_day", "mobile_usage_ratio_pct")],
        F.col("summary.shuffle_pct").alias("shuffle_pct"),
        F.col("metrics.music_novelty_rate_pct").alias("music_novelty_rate_pct"),
        F.col("metrics.early_skip_rate_pct").alias("early_skip_rate_pct"),
        F.slice(F.transform("top_artists", lambda x: x["artist"]), 1, 5).alias("top5_artists"),
        F.slice(F.transform("top_songs", lambda x: x["track"]), 1, 5).alias("top5_songs"),
        F.transform(F.filter("badges", lambda b: b["earned"]), lambda b: b["name"]).alias("badges"),
        F.col("radar"))
    return finish(out.withColumn("summary_json", F.to_json(compact)), keys)


def graph_report(edges: DataFrame, keys: Sequence[str] = G.GRAPH_KEYS, pagerank_top_k: int = C.PAGERANK_TOP_K,
                 community_top_k: int = C.COMMUNITY_TOP_K, display_top_n: int = C.DISPLAY_TOP_N) -> DataFrame:
    """Per graph: summary, top PageRank, communities, components and the
    display subgraph (nodes, edges), each list bounded by its k."""
    e, ks = prepare(edges, keys)
    e = G._cut(e)  # reused by every algorithm below
    ranks = G.pagerank(e, ks)
    labels = G.label_propagation(e, ks)
    comms = G.communities(e, labels, ks, top=community_top_k)
    comps = G.components(e, ks)
    csum = G.component_summary(comps, ks)
    nodes, sub = G.display_subgraph(e, ranks, comms, ks, display_top_n)
    summ = G.summary(e, ks)
    out = summ.select(*ks, F.struct(*[c for c in summ.columns if c not in ks]).alias("summary"))
    parts = [
        _listed(G.top_pagerank(ranks, pagerank_top_k, ks), ks, "position",
                ["position", "id", F.bround("rank", 6).alias("score")], "pagerank"),
        _listed(comms, ks, "community", ["community", "size", "weight", "top_members"], "communities"),
        csum.groupBy(*ks).agg(F.first("components").alias("components"), F.first("largest_size").alias("largest_size"))
        .join(_listed(csum, ks, "position", ["size", "sample_members"], "top_components"), ks),
        _listed(nodes.withColumn("_o", -F.col("rank")), ks, "_o",
                ["id", F.bround("rank", 6).alias("score"), "community"], "display_nodes"),
        _listed(sub.withColumn("_o", -F.col("weight")), ks, "_o", ["src", "dst", "weight"], "display_edges"),
    ]
    for p in parts:
        out = out.join(p, ks, "left")
    return finish(out, keys)
