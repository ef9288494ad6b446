"""Fixed values.

Every value in this module is a fixed value that must equal the behaviour
being matched (offset table, thresholds, names, label texts).  They are
listed plainly, in their natural order, and are not derived from anything.
"""

from __future__ import annotations

# --- fixed values: timing -------------------------------------------------
SESSION_GAP_MINUTES = 30
AVG_TRACK_SECONDS = 210
EARLY_SKIP_MS = 30_000
FOCUS_MS = 240_000
COMPLETED_REASON = "endplay"
UNKNOWN = "Unknown"
DEFAULT_TZ_OFFSET = 3
NIGHT_LOCAL_HOURS = 6  # local hours 0..5 count as night
TOP_LIST_SIZE = 20
LOYALTY_TOP_ARTISTS = 10

# --- fixed values: country -> whole-hour UTC offset -----------------------
TZ_OFFSETS = {
    "TR": 3, "DE": 1, "FR": 1, "NL": 1, "GB": 0, "US": -5,
    "CA": -5, "AT": 1, "CZ": 1, "IT": 1, "ES": 1, "SE": 1,
    "NO": 1, "DK": 1, "FI": 2, "PL": 1, "BE": 1, "CH": 1,
    "PT": 0, "GR": 2, "RO": 2, "BG": 2, "JP": 9, "KR": 9,
    "AU": 10, "NZ": 12, "BR": -3, "MX": -6, "AR": -3, "IN": 5,
}

# --- fixed values: platform categories (first match wins) -----------------
PLATFORM_RULES = [
    ("Mobile", ("android", "ios", "iphone")),
    ("Web", ("web", "chrome", "firefox")),
    ("Desktop", ("desktop", "windows", "mac")),
]
PLATFORM_OTHER = "Other"
PLATFORM_LABEL_MAX_CHARS = 20

# --- fixed values: the 15-number user vector, in order --------------------
METRIC_KEYS = [
    "impatience_score_pct",
    "completion_rate_pct",
    "exploration_score",
    "artist_diversity_entropy",
    "early_skip_rate_pct",
    "listening_intensity_h_per_day",
    "night_listening_ratio_pct",
    "mobile_usage_ratio_pct",
    "focus_session_score_pct",
    "music_novelty_rate_pct",
    "artist_loyalty_score_pct",
    "habit_loop_score_pct",
    "listening_fragmentation_index",
    "total_hours",
    "shuffle_pct",
]

# --- fixed values: percentile label suffixes (metric -> text) -------------
METRIC_LABEL_SUFFIX = {
    "impatience_score_pct": "kullanıcıdan daha sabırsız",
    "completion_rate_pct": "kullanıcıdan daha fazla şarkı bitiriyor",
    "exploration_score": "kullanıcıdan daha fazla keşfediyor",
    "artist_diversity_entropy": "kullanıcıdan daha eklektik",
    "early_skip_rate_pct": "kullanıcıdan daha hızlı atlıyor",
    "listening_intensity_h_per_day": "kullanıcıdan daha yoğun dinliyor",
    "night_listening_ratio_pct": "kullanıcıdan daha çok gece dinliyor",
    "mobile_usage_ratio_pct": "kullanıcıdan daha çok mobil kullanıyor",
    "focus_session_score_pct": "kullanıcıdan daha odaklı",
    "music_novelty_rate_pct": "kullanıcıdan daha çok yeni parça keşfediyor",
    "artist_loyalty_score_pct": "kullanıcıdan daha sadık",
    "habit_loop_score_pct": "kullanıcıdan daha alışkanlık odaklı",
    "listening_fragmentation_index": "kullanıcıdan daha parçalı dinliyor",
    "total_hours": "kullanıcıdan daha çok dinlemiş",
    "shuffle_pct": "kullanıcıdan daha çok shuffle kullanıyor",
}
PERCENTILE_SMALL_POOL = 50.0  # pools with fewer than 2 users

# --- fixed values: badges (id, name, rule on the profile) -----------------
BADGES = [
    ("night_owl", "Night Owl", "night_listening_ratio_pct > 25"),
    ("marathon", "Marathon Listener", "max_session_hours >= 4"),
    ("one_track_mind", "One Track Mind", "top_song_hours >= 20"),
    ("shuffle_addict", "Shuffle Addict", "shuffle_pct > 80"),
    ("album_purist", "Album Purist", "shuffle_pct < 20"),
    ("explorer", "Explorer", "unique_artists >= 1000"),
    ("deep_focus", "Deep Focus", "focus_session_score_pct > 15"),
    ("impatient", "Impatient", "early_skip_rate_pct > 50"),
    ("loyal_fan", "Loyal Fan", "loyal_artists_5yr >= 1"),
    ("ghost", "Ghost Listener", "incognito_plays >= 100"),
    ("world_traveler", "World Traveler", "known_countries >= 3"),
    ("centurion", "Centurion", "total_plays >= 100000"),
    ("dedication", "Dedication", "total_hours >= 3000"),
    ("offline_warrior", "Offline Warrior", "offline_ratio_pct > 10"),
    ("creature_of_habit", "Creature of Habit", "habit_loop_score_pct > 10"),
]
# Badge descriptions by badge id: text, the profile column whose
# value stands for {} in it (None: no value), and how that value is written
# (digits after the point; "," = with thousands separators).
BADGE_DESCRIPTIONS = {
    "night_owl": ("Gece dinleme > %25", None, None),
    "marathon": ("Tek oturumda {} saat", "max_session_hours", "1"),
    "one_track_mind": ("Bir şarkıyı {}+ saat", "top_song_hours", "0"),
    "shuffle_addict": ("Shuffle > %80", None, None),
    "album_purist": ("Shuffle < %20", None, None),
    "explorer": ("{} benzersiz sanatçı", "unique_artists", ","),
    "deep_focus": ("Odak skoru > %15", None, None),
    "impatient": ("Erken atlama > %50", None, None),
    "loyal_fan": ("{} sanatçıyı 5+ yıl", "loyal_artists_5yr", "0"),
    "ghost": ("{} gizli dinleme", "incognito_plays", "0"),
    "world_traveler": ("{} ülke", "known_countries", "0"),
    "centurion": ("100.000+ dinleme", None, None),
    "dedication": ("3.000+ saat", None, None),
    "offline_warrior": ("Çevrimdışı > %10", None, None),
    "creature_of_habit": ("Alışkanlık > %10", None, None),
}
LOYAL_ARTIST_DAYS = 5 * 365
LOYAL_ARTIST_MIN_PLAYS = 20

# --- fixed values: levels (hours threshold, title, level) -----------------
LEVELS = [
    (50, "Casual", 1),
    (200, "Listener", 2),
    (500, "Enthusiast", 3),
    (1000, "Devotee", 4),
    (1500, "Addict", 5),
    (2000, "Obsessed", 6),
    (2500, "Maniac", 7),
    (3000, "Legendary", 8),
    (4000, "Mythic", 9),
    (5000, "Transcendent", 10),
]
LEVEL_BELOW_FIRST = ("Newbie", 1)
XP_PER_HOUR = 10
XP_PER_BADGE = 50

# --- fixed values: archetypes (rule, name), first match wins ---------------
ARCHETYPES = [
    ("night_listening_ratio_pct > 25 AND focus_session_score_pct > 10", "The Night Diver"),
    ("impatience_score_pct > 40 AND exploration_score > 12", "The Restless Explorer"),
    ("artist_loyalty_score_pct > 18 AND music_novelty_rate_pct < 7", "The Loyal Guardian"),
    ("artist_diversity_entropy > 10 AND exploration_score > 8", "The Eclectic Mind"),
    ("focus_session_score_pct > 12 AND impatience_score_pct < 25", "The Deep Listener"),
    ("impatience_score_pct > 35 AND music_novelty_rate_pct < 6", "The Picky Repeater"),
    ("night_listening_ratio_pct > 20 AND artist_diversity_entropy > 9", "The Midnight Wanderer"),
]
ARCHETYPE_DEFAULT = "The Balanced Listener"
# Archetype descriptions.
ARCHETYPE_DESCRIPTIONS = {
    "The Night Diver": "Gece saatlerinde derinlere dalan, odaklı bir dinleyici.",
    "The Restless Explorer": "Sürekli yeni şeyler arıyor, beğenmediklerini anında geçiyor.",
    "The Loyal Guardian": "Sevdiği sanatçılara sadık, güvendiği limandan ayrılmıyor.",
    "The Eclectic Mind": "Çok geniş bir müzik yelpazesi, türler arası rahatça geziniyor.",
    "The Deep Listener": "Sabırlı, odaklı, şarkıları sonuna kadar dinleyen bir ruh.",
    "The Picky Repeater": "Seçici ama keşfetmekten çok tekrar eden.",
    "The Midnight Wanderer": "Gece saatlerinde farklı türler arasında dolaşan bir gezgin.",
    "The Balanced Listener": "Dengeli bir dinleyici — keşfetme, sadakat ve sabır arasında denge.",
}

# --- fixed values: cluster centroid labels (rule, name), first match wins --
CLUSTER_LABELS = [
    ("night_listening_ratio_pct > 25 AND exploration_score > 10", "Night Explorers"),
    ("impatience_score_pct > 35 AND exploration_score > 12", "Impatient Skippers"),
    ("artist_loyalty_score_pct > 18 AND music_novelty_rate_pct < 7", "Loyal Repeaters"),
    ("focus_session_score_pct > 12 AND impatience_score_pct < 25", "Deep Listeners"),
    ("listening_intensity_h_per_day > 3 AND exploration_score > 8", "Heavy Discoverers"),
    ("night_listening_ratio_pct > 20", "Late Night Listeners"),
    ("artist_loyalty_score_pct > 25", "Devoted Fans"),
]
CLUSTER_LABEL_DEFAULT = "Balanced Listeners"

# --- fixed values: radar axes (name, metric, factor, capped at 100) --------
RADAR_AXES = [
    ("patience", "impatience_score_pct", None, False),
    ("exploration", "exploration_score", 5, True),
    ("loyalty", "artist_loyalty_score_pct", 5, True),
    ("focus", "focus_session_score_pct", 5, True),
    ("diversity", "artist_diversity_entropy", 8, True),
    ("night", "night_listening_ratio_pct", 4, True),
]

# --- fixed values: graph algorithms ----------------------------------------
PAGERANK_DAMPING = 0.85
PAGERANK_TOL = 1e-7
PAGERANK_MAX_ITER = 200
PAGERANK_TOP_K = 20
COMMUNITY_TOP_K = 10
COMMUNITY_MEMBERS = 8
COMPONENT_TOP_K = 5
COMPONENT_SAMPLE = 5
DISPLAY_TOP_N = 60
DISPLAY_MIN_EDGES = 80

# --- fixed values: clustering ----------------------------------------------
KMEANS_SEED = 42
KMEANS_K_MIN = 2
KMEANS_K_MAX = 8
KMEANS_RESTARTS = 20  # starts of the final fit
KMEANS_SWEEP_RESTARTS = 10  # starts for each k of the sweep
KMEANS_MIN_ROWS = 4
