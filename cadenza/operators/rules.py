"""Rule layers over the per-listener profile (pure column expressions).

Rules are evaluated on the metric values as they are displayed (rounded
half-even to the digits of the report), because that is what the thresholds
are compared with; raw hour totals and session lengths stay unrounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import constants as C
from cadenza.operators.keys import DEFAULT_KEYS

# Digits each metric is shown with (and compared at).
DISPLAY_DIGITS = {
    "impatience_score_pct": 1, "completion_rate_pct": 1, "avg_listen_sec": 1, "avg_listening_ratio": 3,
    "exploration_score": 1, "artist_diversity_entropy": 2, "skip_latency_ratio": 3, "early_skip_rate_pct": 1,
    "listening_intensity_h_per_day": 2, "night_listening_ratio_pct": 1, "mobile_usage_ratio_pct": 1,
    "album_listening_ratio_pct": 1, "focus_session_score_pct": 1, "music_novelty_rate_pct": 1,
    "artist_loyalty_score_pct": 1, "song_replay_density_pct": 1, "listening_fragmentation_index": 1,
    "habit_loop_score_pct": 1, "shuffle_pct": 1, "offline_ratio_pct": 1,
}


def displayed(profile: DataFrame) -> DataFrame:
    """Metric columns rounded half-even to their display digits."""
    return profile.select(*[
        F.bround(F.col(c), DISPLAY_DIGITS[c]).alias(c) if c in DISPLAY_DIGITS else F.col(c)
        for c in profile.columns])


def _badge_description(badge: str) -> Column:
    """The badge's fixed text with the profile value it names."""
    text, column, digits = C.BADGE_DESCRIPTIONS[badge]
    if column is None:
        return F.lit(text)
    shown = (F.format_number(F.col(column), 0) if digits == ","
             else F.bround(F.col(column).cast("double"), int(digits)).cast(f"decimal(38,{digits})").cast("string"))
    before, after = text.split("{}")
    return F.concat(F.lit(before), shown, F.lit(after))


def badges(profile: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """One row per (key, badge) with ``earned`` and its description."""
    d = displayed(profile)
    stack = F.explode(F.array(*[
        F.struct(F.lit(i).alias("badge_order"), F.lit(bid).alias("badge"), F.lit(name).alias("name"),
                 _badge_description(bid).alias("description"),
                 F.coalesce(F.expr(cond), F.lit(False)).alias("earned"))
        for i, (bid, name, cond) in enumerate(C.BADGES)]))
    return d.select(*keys, stack.alias("b")).select(*keys, "b.*")


def _earned(d: DataFrame) -> Column:
    return sum(F.coalesce(F.expr(cond), F.lit(False)).cast("int") for _, _, cond in C.BADGES)


def badge_counts(profile: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """R2: badges earned / total per key (no explode needed)."""
    d = displayed(profile)
    return d.select(*keys, _earned(d).alias("badges_earned"), F.lit(len(C.BADGES)).alias("badges_total"))


def _level_exprs(hours: Column) -> tuple[Column, Column, Column]:
    level, title, nxt = None, None, None
    for thr, name, lvl in reversed(C.LEVELS):
        cond = hours >= thr
        level = F.when(cond, F.lit(lvl)) if level is None else level.when(cond, F.lit(lvl))
        title = F.when(cond, F.lit(name)) if title is None else title.when(cond, F.lit(name))
    level = level.otherwise(F.lit(C.LEVEL_BELOW_FIRST[1]))
    title = title.otherwise(F.lit(C.LEVEL_BELOW_FIRST[0]))
    for thr, _, _ in C.LEVELS:  # first threshold not reached; null at the top
        cond = hours < thr
        nxt = F.when(cond, F.lit(thr)) if nxt is None else nxt.when(cond, F.lit(thr))
    return level, title, nxt


def levels(profile: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Badges earned, level, title, next threshold hours, XP (on the
    unrounded total hours)."""
    d = displayed(profile)
    d = d.select(*keys, "total_hours", _earned(d).alias("badges_earned"),
                 F.lit(len(C.BADGES)).alias("badges_total"))
    level, title, nxt = _level_exprs(F.col("total_hours"))
    xp = F.floor(F.col("total_hours") * C.XP_PER_HOUR + F.col("badges_earned") * C.XP_PER_BADGE).cast("bigint")
    return d.select(*keys, "badges_earned", "badges_total", level.alias("level"), title.alias("title"),
                    nxt.alias("next_threshold_hours"), xp.alias("xp"))


def _first_rule(rules: Sequence[tuple[str, str]], default: str) -> Column:
    out = None
    for cond, name in rules:
        c = F.coalesce(F.expr(cond), F.lit(False))
        out = F.when(c, F.lit(name)) if out is None else out.when(c, F.lit(name))
    return out.otherwise(F.lit(default))


def archetype(profile: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """First matching archetype rule, with the archetype's description."""
    d = displayed(profile).select(*keys, _first_rule(C.ARCHETYPES, C.ARCHETYPE_DEFAULT).alias("archetype"))
    texts = F.create_map(*[F.lit(x) for pair in C.ARCHETYPE_DESCRIPTIONS.items() for x in pair])
    return d.withColumn("archetype_description", texts[F.col("archetype")])


def cluster_label(centroids: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """First matching centroid rule (centroid values rounded to 3 digits)."""
    d = centroids.select(*id_cols, *[F.bround(F.col(c), 3).alias(c) for c in C.METRIC_KEYS])
    return d.select(*id_cols, _first_rule(C.CLUSTER_LABELS, C.CLUSTER_LABEL_DEFAULT).alias("label"))


def radar(profile: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Six axes, ``least(metric * factor, 100)``; patience = 100 - impatience."""
    d = displayed(profile)
    cols = []
    for name, metric, factor, capped in C.RADAR_AXES:
        v = (F.lit(100.0) - F.col(metric)) if factor is None else F.col(metric) * F.lit(float(factor))
        if capped:
            v = F.least(v, F.lit(100.0))
        cols.append(F.bround(v, 1).alias(name))
    return d.select(*keys, *cols)
