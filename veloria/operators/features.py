"""The 33-feature vector: fusion of vision, market and community facts on the item."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The features in their order, by group.
GROUPS = {
    "aesthetic": ("vlm_art_quality", "vlm_effect_score", "vlm_color_harmony", "vlm_composition", "official_tier", "has_voice_pack", "has_custom_anim", "skin_age_days"),
    "belonging": ("baidu_index_7d", "weibo_followers", "ip_source_type", "ip_popularity", "character_usage_rate", "character_win_rate", "community_post_count", "bilibili_video_views"),
    "showing_off": ("lobby_display_level", "battle_effect_visibility", "kill_broadcast_type", "has_leaderboard_bonus", "is_giftable", "gift_popularity_rank"),
    "collection": ("series_membership", "series_completion_bonus", "is_limited", "limited_type", "rerun_count", "days_since_last_rerun", "ownership_rate"),
    "surprise": ("acquisition_method", "gacha_pity_amount", "drop_rate_percentile", "avg_spend_to_obtain"),
}
FEATURES = tuple(f for g in GROUPS.values() for f in g)


def fuse(base: DataFrame, by_skin: list[DataFrame], by_hero: list[DataFrame]) -> DataFrame:
    """Left joins of facts that have one row per skin_id or hero_name; missing facts stay null."""
    out = reduce(lambda a, b: a.join(b, "skin_id", "left"), by_skin, base)
    return reduce(lambda a, b: a.join(b, "hero_name", "left"), by_hero, out)


def filled(features: DataFrame) -> DataFrame:
    """Missing features as 0."""
    kinds = dict(features.dtypes)
    return features.na.fill({f: False if kinds[f] == "boolean" else 0 for f in FEATURES if f in kinds})


def vector(features: DataFrame) -> DataFrame:
    """All features in their order as one array of doubles; missing ones as 0."""
    return features.withColumn("vector", F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in FEATURES]))


def grouped(features: DataFrame) -> DataFrame:
    """One struct per dimension."""
    return features.select("skin_id", "hero_name", *[F.struct(*names).alias(g) for g, names in GROUPS.items()])


def bundle(official: DataFrame, community: DataFrame, market: DataFrame, as_of) -> DataFrame:
    """What was collected of each item from the three sources, missing sources as null, with the time."""
    c = community.select("hero_name", F.struct(*[x for x in community.columns if x != "hero_name"]).alias("community"))
    m = market.select("skin_id", F.struct(*[x for x in market.columns if x != "skin_id"]).alias("market"))
    return official.join(m, "skin_id", "left").join(c, "hero_name", "left").withColumn("collected_at", as_of)
