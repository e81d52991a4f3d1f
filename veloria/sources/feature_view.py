"""The feature vector over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import facts, features
from . import adapters as A
from .files import kept

AS_OF = "2001-12-01"


def base(rows: DataFrame) -> DataFrame:
    """What the catalogue itself tells of an item; codes are derived from its numbers."""
    k = F.col("skin_id")
    size = F.col("p_size")
    rows = rows.withColumn("acquisition", codes.label_of(k % 5, codes.ACQUISITION))
    return rows.select(
        "skin_id", "hero_name", "skin_name", "genre", "series", "official_price", "acquisition",
        (k % 41 / F.lit(4.0)).alias("vlm_art_quality"), (k % 37 / F.lit(4.0)).alias("vlm_effect_score"), (k % 17 / F.lit(16.0)).alias("vlm_color_harmony"), (size % 21 / F.lit(2.0)).alias("vlm_composition"),
        "official_tier", (k % 2 == 0).alias("has_voice_pack"), (k % 3 == 0).alias("has_custom_anim"), (k * 13).alias("weibo_followers"), (k % 4).cast("int").alias("ip_source_type"),
        (size % 4).alias("lobby_display_level"), (k % 4).cast("int").alias("battle_effect_visibility"), (k % 3).cast("int").alias("kill_broadcast_type"), (k % 7 == 0).alias("has_leaderboard_bonus"), (k % 5 != 0).alias("is_giftable"),
        (size % 2 == 0).alias("series_completion_bonus"), (k % 4 == 1).alias("is_limited"), (k % 5).cast("int").alias("limited_type"), codes.code_of(F.col("acquisition"), codes.ACQUISITION).alias("acquisition_method"), F.col("acquisition").alias("acquisition_method_score"),
        F.when(F.col("acquisition") == "gacha", F.col("official_price") / 4).alias("gacha_pity_amount"),
    )


def feature_view(spark: SparkSession, d: str) -> DataFrame:
    """One row per item: the 33 features, the item's own columns and the scored acquisition label.

    Each fact table is read once and grouped by what its facts share; an item meets a row of each by two joins on its id and two
    on its hero. Ranks in a genre and the size of a series come from counts.
    """
    skins, listings, events, posts = A.skins(spark, d), A.listings(spark, d), A.hero_events(spark, d), A.posts(spark, d)
    sales = kept(A.sales(spark, d).select("skin_id", "user_id", "spend"), "sales")  # joined once for its facts and the number of players
    as_of = F.lit(AS_OF).cast("date")
    community = posts.groupBy("hero_name").agg(F.count(F.lit(1)).alias("community_post_count"))
    most = community.agg(F.max("community_post_count").alias("_most"))
    community = community.join(F.broadcast(most)).select("hero_name", "community_post_count", F.round(F.col("community_post_count") / F.col("_most"), 6).alias("ip_popularity"))
    heroes = facts.hero_facts(events).select("hero_name", F.col("index_7d").alias("baidu_index_7d"), F.col("usage_rate").alias("character_usage_rate"), F.col("win_rate").alias("character_win_rate"), F.col("views").alias("bilibili_video_views"))
    listed = facts.listing_facts(listings, as_of).withColumnRenamed("age_days", "skin_age_days")
    sold = facts.sales_facts(sales).withColumnRenamed("mean_spend", "avg_spend_to_obtain")
    series = skins.groupBy("series").agg(F.count(F.lit(1)).alias("series_membership"))
    out = features.fuse(base(skins), [listed, sold], [heroes, community]).na.fill(0, ["gifts", "drops"]).join(series, "series", "left")
    out = kept(out, "fused")  # read once for each rank and once for the result
    gifts = facts.counts_by_value(out, "genre", "gifts").select("_g", "_v", facts.rank_down().alias("gift_popularity_rank"))
    drops = facts.counts_by_value(out, "genre", "drops").select(F.col("_g").alias("_h"), F.col("_v").alias("_w"), facts.share_below().alias("drop_rate_percentile"))
    out = out.join(gifts, F.col("genre").eqNullSafe(F.col("_g")) & (F.col("gifts") == F.col("_v"))).join(drops, F.col("genre").eqNullSafe(F.col("_h")) & (F.col("drops") == F.col("_w")))
    own = ["skin_id", "hero_name", "skin_name", "genre", "series", "official_price", "acquisition", "acquisition_method_score"]
    return out.select(*own, *features.FEATURES)


_HERO_FACTS = """daily AS (SELECT hero_name, CAST(ts AS DATE) AS day, avg(value) AS value FROM hero_events GROUP BY 1, 2),
idx AS (SELECT hero_name, day, round(avg(value) OVER (PARTITION BY hero_name ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 4) AS index_7d FROM daily),
latest AS (SELECT hero_name, arg_max(index_7d, day) AS baidu_index_7d FROM idx GROUP BY 1),
community AS (SELECT hero_name, count(*) AS community_post_count FROM posts GROUP BY 1),
usage AS (SELECT hero_name, round(count(*) / (SELECT count(*) FROM hero_events)::DOUBLE, 6) AS character_usage_rate, round(count(*) FILTER (WHERE event_type = 'purchase') / count(*)::DOUBLE, 6) AS character_win_rate,
  round(sum(value) FILTER (WHERE event_type = 'view'), 2) AS bilibili_video_views FROM hero_events GROUP BY 1)"""
_SKIN_FACTS = f"""release AS (SELECT skin_id, date_diff('day', CAST(min(listed_at) AS DATE), DATE '{AS_OF}') AS skin_age_days FROM listings GROUP BY 1),
gifts AS (SELECT s.skin_id, rank() OVER (PARTITION BY genre ORDER BY count(l.skin_id) DESC) AS gift_popularity_rank FROM skins s LEFT JOIN (SELECT skin_id FROM listings WHERE flag = 'N') l ON s.skin_id = l.skin_id GROUP BY s.skin_id, genre),
series_n AS (SELECT series, count(*) AS series_membership FROM skins GROUP BY 1),
episodes AS (SELECT DISTINCT skin_id, CAST(date_trunc('month', listed_at) AS DATE) AS start FROM listings),
reruns AS (SELECT skin_id, count(*) - 1 AS rerun_count, CASE WHEN count(*) > 1 THEN date_diff('day', max(start), DATE '{AS_OF}') END AS days_since_last_rerun FROM episodes GROUP BY 1),
owned AS (SELECT skin_id, round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM sales)::DOUBLE, 6) AS ownership_rate FROM sales GROUP BY 1),
drops AS (SELECT s.skin_id, round(percent_rank() OVER (PARTITION BY genre ORDER BY count(x.skin_id)), 6) AS drop_rate_percentile FROM skins s LEFT JOIN sales x ON s.skin_id = x.skin_id GROUP BY s.skin_id, genre),
spends AS (SELECT skin_id, sum(cents)::DOUBLE / (count(*) * 100.0::DOUBLE) AS avg_spend_to_obtain FROM (SELECT skin_id, user_id, sum(CAST(round_even(spend * 100, 0) AS BIGINT)) AS cents FROM sales GROUP BY 1, 2) GROUP BY 1)"""
FEATURE_SQL = ",\n".join([A.SKINS, A.LISTINGS, A.SALES, A.HERO_EVENTS, A.POSTS, _HERO_FACTS, _SKIN_FACTS]) + """,
features AS (SELECT s.skin_id, s.hero_name, skin_name, genre, s.series, official_price, ['direct','gacha','battle_pass','shard','event'][s.skin_id % 5 + 1] AS acquisition,
  s.skin_id % 41 / 4.0::DOUBLE AS vlm_art_quality, s.skin_id % 37 / 4.0::DOUBLE AS vlm_effect_score, s.skin_id % 17 / 16.0::DOUBLE AS vlm_color_harmony, p_size % 21 / 2.0::DOUBLE AS vlm_composition, official_tier,
  s.skin_id % 2 = 0 AS has_voice_pack, s.skin_id % 3 = 0 AS has_custom_anim, skin_age_days, baidu_index_7d, s.skin_id * 13 AS weibo_followers, s.skin_id % 4 AS ip_source_type,
  round(community_post_count / (SELECT max(community_post_count) FROM community)::DOUBLE, 6) AS ip_popularity, character_usage_rate, character_win_rate, community_post_count, bilibili_video_views,
  p_size % 4 AS lobby_display_level, s.skin_id % 4 AS battle_effect_visibility, s.skin_id % 3 AS kill_broadcast_type, s.skin_id % 7 = 0 AS has_leaderboard_bonus, s.skin_id % 5 <> 0 AS is_giftable, gift_popularity_rank,
  series_membership, p_size % 2 = 0 AS series_completion_bonus, s.skin_id % 4 = 1 AS is_limited, s.skin_id % 5 AS limited_type, rerun_count, days_since_last_rerun, ownership_rate, s.skin_id % 5 AS acquisition_method,
  CASE WHEN s.skin_id % 5 = 1 THEN official_price / 4 END AS gacha_pity_amount, drop_rate_percentile, avg_spend_to_obtain
  FROM skins s LEFT JOIN release r ON s.skin_id = r.skin_id LEFT JOIN gifts g ON s.skin_id = g.skin_id LEFT JOIN series_n n ON s.series = n.series LEFT JOIN reruns u ON s.skin_id = u.skin_id
  LEFT JOIN owned o ON s.skin_id = o.skin_id LEFT JOIN drops d ON s.skin_id = d.skin_id LEFT JOIN spends p ON s.skin_id = p.skin_id LEFT JOIN latest i ON s.hero_name = i.hero_name
  LEFT JOIN community c ON s.hero_name = c.hero_name LEFT JOIN usage w ON s.hero_name = w.hero_name)"""
