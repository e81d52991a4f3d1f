"""Facts to features: posts, events, listings, sales. Facts are aggregated to their key before they are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def sentiment(posts: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Posts per hero in the last ``days`` and the shares that are positive and negative, among all of them."""
    recent = posts.where(F.col("day") > F.date_sub(as_of, days))
    return recent.groupBy("hero_name").agg(
        F.count(F.lit(1)).alias("posts"), F.round(F.count_if(F.col("sentiment") == "positive") / F.count(F.lit(1)), 6).alias("positive"), F.round(F.count_if(F.col("sentiment") == "negative") / F.count(F.lit(1)), 6).alias("negative")
    )


def mentions(posts: DataFrame, names: DataFrame) -> DataFrame:
    """(name, posts): posts that have the name among their words; each post counts once for a name."""
    words = posts.select("post_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("name"))
    counts = words.groupBy("name").agg(F.count(F.lit(1)).alias("posts"))  # combines on the map side, before any join
    return counts.join(names.select(F.lower("name").alias("name")).distinct().hint("merge"), "name")


def search_index(events: DataFrame) -> DataFrame:
    """Mean daily value per hero over the seven days up to each day; days without events are no rows and no zeros."""
    daily = events.groupBy("hero_name", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    week = W.partitionBy("hero_name").orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return daily.select("hero_name", "day", F.round(F.avg("value").over(week), 4).alias("index_7d"))


def heat(posts: DataFrame, as_of: Column, keywords: str) -> DataFrame:
    """Per hero: posts of the last 7 days on a logarithmic scale of the busiest hero, and the share that names a keyword."""
    week = F.count_if(F.col("day") > F.date_sub(as_of, 7))
    per = posts.groupBy("hero_name").agg(week.alias("week_posts"), F.round(F.count_if(F.col("text").rlike(keywords)) / F.count(F.lit(1)), 6).alias("intent"))
    most = per.agg(F.max("week_posts").alias("most"))
    scaled = F.when(F.col("most") == 0, F.lit(0.0)).otherwise(F.log1p("week_posts") / F.log1p("most"))
    return per.join(F.broadcast(most)).select("hero_name", "week_posts", "intent", F.round(scaled, 6).alias("heat"))


def view_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("hero_name").agg(F.round(F.sum(F.when(F.col("event_type") == "view", F.col("value"))), 2).alias("views"), F.count_if(F.col("event_type") == "click").alias("comments"))


def usage(events: DataFrame, won: str = "purchase") -> DataFrame:
    """Share of all matches that a hero is in, and of those the share won."""
    per = events.groupBy("hero_name").agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.col("event_type") == won).alias("wins"))
    everything = per.agg(F.sum("matches").alias("every"))
    return per.join(F.broadcast(everything)).select("hero_name", "matches", F.round(F.col("matches") / F.col("every"), 6).alias("usage_rate"), F.round(F.col("wins") / F.col("matches"), 6).alias("win_rate"))


def counts_by_value(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(_g, _v, before, ties, of): how many rows of a group have a smaller ``value`` (null smallest), how many each has, and all.

    Counts come first, so what is put in order within a group is a row a distinct value and not a row an item.
    """
    counts = rows.groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("ties"))
    before = F.coalesce(F.sum("ties").over(W.partitionBy("_g").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumns({"before": before, "of": F.sum("ties").over(W.partitionBy("_g"))})


def ranked(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``rows`` with ``before``, ``ties`` and ``of`` of their value in their group."""
    return rows.join(counts_by_value(rows, group, value), F.col(group).eqNullSafe(F.col("_g")) & F.col(value).eqNullSafe(F.col("_v"))).drop("_g", "_v")


def rank_down() -> Column:
    """Rank by descending value, from ``ranked``: 1 the largest."""
    return (F.col("of") - F.col("before") - F.col("ties") + 1).cast("int")


def share_below() -> Column:
    """Percent rank, from ``ranked``."""
    return F.round(F.when(F.col("of") > 1, F.col("before") / (F.col("of") - 1)).otherwise(F.lit(0.0)), 6)


def gift_rank(gifts: DataFrame, skins: DataFrame) -> DataFrame:
    """Rank within the genre, 1 the most gifted; never gifted skins rank by 0."""
    per = gifts.groupBy("skin_id").agg(F.count(F.lit(1)).alias("gifts"))
    rows = skins.select("skin_id", "genre").join(per, "skin_id", "left").na.fill(0, ["gifts"])
    return ranked(rows, "genre", "gifts").select("skin_id", "genre", "gifts", rank_down().alias("gift_rank"))


def drop_rate(sales: DataFrame, skins: DataFrame) -> DataFrame:
    """Percent rank within the genre of a skin's share of drops."""
    per = sales.groupBy("skin_id").agg(F.count(F.lit(1)).alias("drops"))
    rows = skins.select("skin_id", "genre").join(per, "skin_id", "left").na.fill(0, ["drops"])
    return ranked(rows, "genre", "drops").select("skin_id", "genre", "drops", share_below().alias("drop_rate"))


def episodes(listings: DataFrame) -> DataFrame:
    """Months in which a skin was on sale."""
    return listings.select("skin_id", F.to_date(F.date_trunc("month", "listed_at")).alias("start")).distinct()


def rerun_stats(episodes: DataFrame, as_of: Column) -> DataFrame:
    """Reruns (episodes after the first) and days since the last; null days if there was none."""
    out = episodes.groupBy("skin_id").agg((F.count(F.lit(1)) - 1).alias("rerun_count"), F.max("start").alias("last"))
    return out.select("skin_id", "rerun_count", F.when(F.col("rerun_count") > 0, F.datediff(as_of, "last")).alias("days_since_last_rerun"))


def rerun_gaps(episodes: DataFrame) -> DataFrame:
    before = F.lag("start").over(W.partitionBy("skin_id").orderBy("start"))
    return episodes.select("skin_id", "start", F.datediff("start", before).alias("gap_days"))


def ownership(sales: DataFrame, approximate: bool = False) -> DataFrame:
    """Owners of a skin among all sampled players."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    everyone = sales.agg(count("user_id").alias("players"))
    per = sales.groupBy("skin_id").agg(count("user_id").alias("owners"))
    return per.join(F.broadcast(everyone)).select("skin_id", "owners", F.round(F.col("owners") / F.col("players"), 6).alias("ownership_rate"))


def mean_spend(sales: DataFrame) -> DataFrame:
    """Mean over a skin's buyers of what each spent on it, from sums of whole cents."""
    cents = F.sum(F.rint(F.col("spend") * 100).cast("long"))
    per = sales.groupBy("skin_id", "user_id").agg(cents.alias("cents"))
    return per.groupBy("skin_id").agg((F.sum("cents") / (F.count(F.lit(1)) * F.lit(100.0))).alias("mean_spend"), F.count(F.lit(1)).alias("buyers"))


def series_size(skins: DataFrame) -> DataFrame:
    size = skins.groupBy("series").agg(F.count(F.lit(1)).alias("series_membership"))
    return skins.select("skin_id", "series").join(size, "series")


def resale(listings: DataFrame, skins: DataFrame) -> DataFrame:
    """Per skin: listings, median price, mean premium of resale over the official price; a zero price has no premium."""
    rows = listings.join(skins.select("skin_id", "official_price"), "skin_id")
    premium = F.try_divide(F.col("price") - F.col("official_price"), F.col("official_price"))
    return rows.groupBy("skin_id").agg(F.count(F.lit(1)).alias("listings"), F.round(F.median("price"), 9).alias("median_price"), F.round(F.avg(premium), 4).alias("resale_premium"))


def daily_prices(listings: DataFrame) -> DataFrame:
    """One price a skin and day: its lowest."""
    return listings.groupBy("skin_id", F.to_date("listed_at").alias("day")).agg(F.min("price").alias("price"))


def price_history(daily: DataFrame) -> DataFrame:
    """The price before and the change from it."""
    before = F.lag("price").over(W.partitionBy("skin_id").orderBy("day"))
    return daily.select("skin_id", "day", "price", before.alias("previous"), (F.col("price") - before).alias("change"))


def listing_facts(listings: DataFrame, as_of: Column, gift: str = "N") -> DataFrame:
    """Per skin, in one grouping: age in days, gifts, reruns and days since the last, as ``release_order``, ``gift_rank`` and ``rerun_stats`` have them."""
    month = F.to_date(F.date_trunc("month", "listed_at"))
    per = listings.groupBy("skin_id").agg(F.to_date(F.min("listed_at")).alias("_first"), F.count_if(F.col("flag") == gift).alias("gifts"), F.size(F.collect_set(month)).alias("_months"), F.max(month).alias("_last"))
    days = F.when(F.col("_months") > 1, F.datediff(as_of, "_last"))
    return per.select("skin_id", F.datediff(as_of, "_first").alias("age_days"), "gifts", (F.col("_months") - 1).cast("long").alias("rerun_count"), days.alias("days_since_last_rerun"))


def sales_facts(sales: DataFrame) -> DataFrame:
    """Per skin, in one grouping by buyer and one by skin: drops, ownership and mean spend, as ``drop_rate``, ``ownership`` and ``mean_spend`` have them."""
    cents = F.sum(F.rint(F.col("spend") * 100).cast("long"))
    per = sales.groupBy("skin_id", "user_id").agg(cents.alias("cents"), F.count(F.lit(1)).alias("n"))
    per = per.groupBy("skin_id").agg(F.sum("n").alias("drops"), F.count("user_id").alias("owners"), (F.sum("cents") / (F.count(F.lit(1)) * F.lit(100.0))).alias("mean_spend"))
    everyone = sales.agg(F.count_distinct("user_id").alias("players"))
    return per.join(F.broadcast(everyone)).select("skin_id", "drops", F.round(F.col("owners") / F.col("players"), 6).alias("ownership_rate"), "mean_spend")


def hero_facts(events: DataFrame, won: str = "purchase") -> DataFrame:
    """Per hero, from one grouping by day: the last search index, usage, win rate and views, as ``search_index``, ``usage`` and ``view_totals`` have them."""
    daily = events.groupBy("hero_name", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("matches"), F.count_if(F.col("event_type") == won).alias("wins"), F.sum(F.when(F.col("event_type") == "view", F.col("value"))).alias("views"))
    week = W.partitionBy("hero_name").orderBy(F.unix_date("day")).rangeBetween(-6, 0)  # a row a day
    daily = daily.withColumn("index_7d", F.round(F.avg("value").over(week), 4))
    per = daily.groupBy("hero_name").agg(F.max_by("index_7d", "day").alias("index_7d"), F.sum("matches").alias("matches"), F.sum("wins").alias("wins"), F.round(F.sum("views"), 2).alias("views"))
    everything = events.agg(F.count(F.lit(1)).alias("every"))
    return per.join(F.broadcast(everything)).select("hero_name", "index_7d", F.round(F.col("matches") / F.col("every"), 6).alias("usage_rate"), F.round(F.col("wins") / F.col("matches"), 6).alias("win_rate"), "views")


def price_as_of(daily: DataFrame, asked: DataFrame) -> DataFrame:
    """The last price at or before each asked (skin_id, day): both sides stand in one order, the last known price is carried on."""
    both = daily.select("skin_id", "day", "price", F.lit(0).alias("_asked")).unionByName(asked.select("skin_id", "day", F.lit(None).cast("double").alias("price"), F.lit(1).alias("_asked")))
    carried = F.last("price", ignorenulls=True).over(W.partitionBy("skin_id").orderBy("day", "_asked").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("price", carried).where("_asked = 1").select("skin_id", "day", "price")


def market_trends(listings: DataFrame, skins: DataFrame) -> DataFrame:
    """Listings and mean price by genre and month, and the change of the mean from the month before."""
    rows = listings.join(skins.select("skin_id", "genre"), "skin_id")
    per = rows.groupBy("genre", F.to_date(F.date_trunc("month", "listed_at")).alias("month")).agg(F.count(F.lit(1)).alias("volume"), F.round(F.avg("price"), 4).alias("mean_price"))
    return per.withColumn("change", F.round(F.col("mean_price") - F.lag("mean_price").over(W.partitionBy("genre").orderBy("month")), 4))


def scaled_target(skins: DataFrame, spend: DataFrame | None, premium: DataFrame) -> DataFrame:
    """Training target: official price (mean spend for gacha skins), raised by a positive resale premium, over the genre's largest.

    Without ``spend`` the skins have their own mean_spend.
    """
    if spend is not None:
        skins = skins.select("skin_id", "genre", "official_price", "acquisition").join(spend.select("skin_id", "mean_spend"), "skin_id", "left")
    rows = skins.join(premium.select("skin_id", "resale_premium"), "skin_id", "left")
    base = F.when((F.col("acquisition") == "gacha") & F.col("mean_spend").isNotNull(), F.col("mean_spend")).otherwise(F.col("official_price"))
    rows = rows.withColumn("price", base * (1 + F.greatest(F.coalesce("resale_premium", F.lit(0.0)), F.lit(0.0))))
    most = rows.groupBy("genre").agg(F.max("price").alias("most"))
    return rows.join(most, "genre").select("skin_id", "genre", F.round(F.col("price") / F.col("most"), 6).alias("target"))  # sent whole if it turns out small


def newest(posts: DataFrame, k: int = 50) -> DataFrame:
    """The k newest posts of each hero, ties by larger id."""
    n = F.row_number().over(W.partitionBy("hero_name").orderBy(F.desc("day"), F.desc("post_id")))
    return posts.withColumn("place", n).where(F.col("place") <= k)


def quality_rank(posts: DataFrame, least: int = 3) -> DataFrame:
    """Sources by mean review score within a language; fewer than ``least`` reviews do not rank."""
    per = posts.where("quality IS NOT NULL").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("reviews"), F.round(F.avg("quality"), 6).alias("score")).where(F.col("reviews") >= least)
    return per.withColumn("place", F.dense_rank().over(W.partitionBy("lang").orderBy(F.desc("score"))))


def release_order(listings: DataFrame, skins: DataFrame, as_of: Column) -> DataFrame:
    """First day on sale, age in days and the order of release within the genre."""
    first = listings.groupBy("skin_id").agg(F.to_date(F.min("listed_at")).alias("released"))
    rows = ranked(skins.select("skin_id", "genre").join(first, "skin_id"), "genre", "released")
    day = F.row_number().over(W.partitionBy("genre", "released").orderBy("skin_id"))
    return rows.select("skin_id", "genre", "released", F.datediff(as_of, "released").alias("age_days"), (F.col("before") + day).cast("int").alias("release_no"))
