"""Registered queries over posts, events, listings and sales."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts
from ..sources import adapters as A

KEYWORDS = "(^| )(the|que)( |$)"


def _day(x: str):
    return F.lit(x).cast("date")


def sentiment_30d(spark, d):
    return facts.sentiment(A.posts(spark, d), _day("2024-02-29"))


def mentions(spark, d):
    names = A.skins(spark, d).select(F.element_at(F.split("skin_name", " "), 1).alias("name")).distinct().unionByName(spark.createDataFrame([("the",), ("que",), ("der",)], "name string"))
    return facts.mentions(A.posts(spark, d), names)


def heat_index(spark, d):
    return facts.heat(A.posts(spark, d), _day("2024-02-29"), KEYWORDS)


def search_index_7d(spark, d):
    return facts.search_index(A.hero_events(spark, d))


def view_totals(spark, d):
    return facts.view_totals(A.hero_events(spark, d))


def usage_rate(spark, d):
    return facts.usage(A.hero_events(spark, d))


def gift_rank(spark, d):
    return facts.gift_rank(A.listings(spark, d).where("flag = 'N'"), A.skins(spark, d))


def drop_rate_pct(spark, d):
    return facts.drop_rate(A.sales(spark, d), A.skins(spark, d))


def rerun_stats(spark, d):
    return facts.rerun_stats(facts.episodes(A.listings(spark, d)), _day("2001-12-01"))


def rerun_gaps(spark, d):
    return facts.rerun_gaps(facts.episodes(A.listings(spark, d)))


def ownership(spark, d):
    return facts.ownership(A.sales(spark, d))


def avg_spend(spark, d):
    return facts.mean_spend(A.sales(spark, d))


def series_size(spark, d):
    return facts.series_size(A.skins(spark, d))


def resale_premium(spark, d):
    return facts.resale(A.listings(spark, d), A.skins(spark, d))


def price_history(spark, d):
    return facts.price_history(facts.daily_prices(A.listings(spark, d)))


def price_asof(spark, d):
    asked = A.sales(spark, d).select("skin_id", F.date_add(F.to_date("day"), 30).alias("day")).distinct()
    return facts.price_as_of(facts.daily_prices(A.listings(spark, d)), asked)


def market_trends(spark, d):
    return facts.market_trends(A.listings(spark, d), A.skins(spark, d))


def recent_posts(spark, d):
    return facts.newest(A.posts(spark, d)).select("post_id", "hero_name", "day", "place")


def quality_rank(spark, d):
    return facts.quality_rank(A.posts(spark, d))


def release_order(spark, d):
    return facts.release_order(A.listings(spark, d), A.skins(spark, d), _day("2001-12-01"))


QUERIES = {f.__name__: f for f in (
    sentiment_30d, mentions, heat_index, search_index_7d, view_totals, usage_rate, gift_rank, drop_rate_pct, rerun_stats, rerun_gaps, ownership, avg_spend, series_size, resale_premium, price_history, price_asof, market_trends, recent_posts, quality_rank, release_order,
)}

_EPISODES = f"WITH {A.LISTINGS}, episodes AS (SELECT DISTINCT skin_id, CAST(date_trunc('month', listed_at) AS DATE) AS start FROM listings)"
_DAILY = f"WITH {A.LISTINGS}, daily AS (SELECT skin_id, CAST(listed_at AS DATE) AS day, min(price) AS price FROM listings GROUP BY 1, 2)"
SQL = {
    "sentiment_30d": f"WITH {A.POSTS} SELECT hero_name, count(*) AS posts, round(count(*) FILTER (WHERE sentiment = 'positive') / count(*)::DOUBLE, 6) AS positive, round(count(*) FILTER (WHERE sentiment = 'negative') / count(*)::DOUBLE, 6) AS negative FROM posts WHERE day > DATE '2024-01-30' GROUP BY 1",
    "mentions": f"WITH {A.SKINS}, {A.POSTS}, n AS (SELECT DISTINCT lower(split_part(skin_name, ' ', 1)) AS name FROM skins UNION SELECT unnest(['the', 'que', 'der'])), w AS (SELECT post_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'))) AS name FROM posts) SELECT name, count(*) AS posts FROM w JOIN n USING (name) GROUP BY 1",
    "heat_index": f"WITH {A.POSTS}, p AS (SELECT hero_name, count(*) FILTER (WHERE day > DATE '2024-02-22') AS week_posts, round(count(*) FILTER (WHERE regexp_matches(text, '{KEYWORDS}')) / count(*)::DOUBLE, 6) AS intent FROM posts GROUP BY 1) SELECT hero_name, week_posts, intent, round(ln(1 + week_posts) / ln(1 + (SELECT max(week_posts) FROM p)), 6) AS heat FROM p",
    "search_index_7d": f"WITH {A.HERO_EVENTS}, daily AS (SELECT hero_name, CAST(ts AS DATE) AS day, avg(value) AS value FROM hero_events GROUP BY 1, 2) SELECT hero_name, day, round(avg(value) OVER (PARTITION BY hero_name ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 4) AS index_7d FROM daily",
    "view_totals": f"WITH {A.HERO_EVENTS} SELECT hero_name, round(sum(value) FILTER (WHERE event_type = 'view'), 2) AS views, count(*) FILTER (WHERE event_type = 'click') AS comments FROM hero_events GROUP BY 1",
    "usage_rate": f"WITH {A.HERO_EVENTS} SELECT hero_name, count(*) AS matches, round(count(*) / (SELECT count(*) FROM hero_events)::DOUBLE, 6) AS usage_rate, round(count(*) FILTER (WHERE event_type = 'purchase') / count(*)::DOUBLE, 6) AS win_rate FROM hero_events GROUP BY 1",
    "gift_rank": f"WITH {A.SKINS}, {A.LISTINGS}, g AS (SELECT s.skin_id, genre, count(l.skin_id) AS gifts FROM skins s LEFT JOIN (SELECT skin_id FROM listings WHERE flag = 'N') l ON s.skin_id = l.skin_id GROUP BY 1, 2) SELECT *, CAST(rank() OVER (PARTITION BY genre ORDER BY gifts DESC) AS INTEGER) AS gift_rank FROM g",
    "drop_rate_pct": f"WITH {A.SKINS}, {A.SALES}, g AS (SELECT s.skin_id, genre, count(x.skin_id) AS drops FROM skins s LEFT JOIN sales x ON s.skin_id = x.skin_id GROUP BY 1, 2) SELECT *, round(percent_rank() OVER (PARTITION BY genre ORDER BY drops), 6) AS drop_rate FROM g",
    "rerun_stats": f"{_EPISODES} SELECT skin_id, count(*) - 1 AS rerun_count, CASE WHEN count(*) > 1 THEN CAST(date_diff('day', max(start), DATE '2001-12-01') AS INTEGER) END AS days_since_last_rerun FROM episodes GROUP BY 1",
    "rerun_gaps": f"{_EPISODES} SELECT skin_id, start, CAST(date_diff('day', lag(start) OVER (PARTITION BY skin_id ORDER BY start), start) AS INTEGER) AS gap_days FROM episodes",
    "ownership": f"WITH {A.SALES} SELECT skin_id, count(DISTINCT user_id) AS owners, round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM sales)::DOUBLE, 6) AS ownership_rate FROM sales GROUP BY 1",
    "avg_spend": f"WITH {A.SALES} SELECT skin_id, sum(cents)::DOUBLE / (count(*) * 100.0::DOUBLE) AS mean_spend, count(*) AS buyers FROM (SELECT skin_id, user_id, sum(CAST(round_even(spend * 100, 0) AS BIGINT)) AS cents FROM sales GROUP BY 1, 2) GROUP BY 1",
    "series_size": f"WITH {A.SKINS} SELECT skin_id, series, count(*) OVER (PARTITION BY series) AS series_membership FROM skins",
    "resale_premium": f"WITH {A.SKINS}, {A.LISTINGS} SELECT l.skin_id, count(*) AS listings, round(median(price), 9) AS median_price, round(avg((price - official_price) / official_price), 4) AS resale_premium FROM listings l JOIN skins s ON l.skin_id = s.skin_id GROUP BY 1",
    "price_history": f"{_DAILY} SELECT skin_id, day, price, lag(price) OVER w AS previous, price - lag(price) OVER w AS change FROM daily WINDOW w AS (PARTITION BY skin_id ORDER BY day)",
    "price_asof": f"{_DAILY}, {A.SALES}, asked AS (SELECT DISTINCT skin_id, CAST(CAST(day AS DATE) + 30 AS DATE) AS day FROM sales) SELECT a.skin_id, a.day, p.price FROM asked a ASOF LEFT JOIN daily p ON a.skin_id = p.skin_id AND a.day >= p.day",
    "market_trends": f"WITH {A.SKINS}, {A.LISTINGS}, m AS (SELECT genre, CAST(date_trunc('month', listed_at) AS DATE) AS month, count(*) AS volume, round(avg(price), 4) AS mean_price FROM listings l JOIN skins s ON l.skin_id = s.skin_id GROUP BY 1, 2) SELECT *, round(mean_price - lag(mean_price) OVER (PARTITION BY genre ORDER BY month), 4) AS change FROM m",
    "recent_posts": f"WITH {A.POSTS} SELECT * FROM (SELECT post_id, hero_name, day, CAST(row_number() OVER (PARTITION BY hero_name ORDER BY day DESC, post_id DESC) AS INTEGER) AS place FROM posts) WHERE place <= 50",
    "quality_rank": f"WITH {A.POSTS}, q AS (SELECT lang, source, count(*) AS reviews, round(avg(quality), 6) AS score FROM posts WHERE quality IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3) SELECT *, CAST(dense_rank() OVER (PARTITION BY lang ORDER BY score DESC) AS INTEGER) AS place FROM q",
    "release_order": f"WITH {A.SKINS}, {A.LISTINGS}, f AS (SELECT skin_id, CAST(min(listed_at) AS DATE) AS released FROM listings GROUP BY 1) SELECT s.skin_id, genre, released, CAST(date_diff('day', released, DATE '2001-12-01') AS INTEGER) AS age_days, CAST(row_number() OVER (PARTITION BY genre ORDER BY released, s.skin_id) AS INTEGER) AS release_no FROM skins s JOIN f ON s.skin_id = f.skin_id",
}
