"""The driver's tables in the roles of a virtual-goods catalogue, as DataFrames and as the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("ECONOMY", "SMALL", "MEDIUM", "STANDARD", "LARGE", "PROMO")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skins_of(table(spark, sf_dir, "part"))


def skins_of(part: DataFrame) -> DataFrame:
    tier = (F.array_position(F.array(*map(F.lit, KINDS)), F.col("p_type")) - 1).cast("int")
    return part.select(
        F.col("p_partkey").alias("skin_id"), F.col("p_brand").alias("hero_name"), F.col("p_name").alias("skin_name"), tier.alias("official_tier"), F.col("p_retailprice").alias("official_price"),
        F.regexp_extract("p_name", r"(\w+)$", 1).alias("series"), F.concat(F.lit("G"), (F.col("p_size") % 4).cast("string")).alias("genre"), F.col("p_size"),
    )


SKINS = """skins AS (SELECT p_partkey AS skin_id, p_brand AS hero_name, p_name AS skin_name,
  CAST(list_position(['ECONOMY','SMALL','MEDIUM','STANDARD','LARGE','PROMO'], p_type) - 1 AS INTEGER) AS official_tier, p_retailprice AS official_price,
  regexp_extract(p_name, '(\\w+)$', 1) AS series, 'G' || CAST(p_size % 4 AS VARCHAR) AS genre, p_size FROM part)"""


def heroes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested: one row per hero with its skins in order; heroes stand in the order of their first skin."""
    ordered = F.array_sort(F.collect_list(F.struct("skin_id", "skin_name", "p_size")))
    rows = skins(spark, sf_dir).groupBy("hero_name").agg(ordered.alias("s"))
    kind = F.get(F.array(*map(F.lit, ("mage", "tank", "archer"))), (F.length("hero_name") % 4).cast("int"))
    return rows.select(
        F.col("hero_name").alias("cname"), F.regexp_extract("hero_name", r"(\d+)$", 1).cast("int").alias("ename"), kind.alias("heroType"), F.get("s", F.lit(0))["skin_id"].alias("hero_pos"),
        F.transform("s", lambda x: x["skin_name"]).alias("skins"), F.transform(F.filter("s", lambda x, i: i % 3 != 2), lambda x: F.concat(F.lit("//img.example.org/"), x["skin_id"].cast("string"), F.lit(".jpg"))).alias("urls"),
        F.array_join(F.transform(F.filter("s", lambda x: x["p_size"] > 1), lambda x: x["skin_name"]), "|").alias("skinName"),
    )


HEROES = SKINS + """, heroes AS (SELECT hero_name AS cname, CAST(regexp_extract(hero_name, '(\\d+)$', 1) AS INTEGER) AS ename,
  ['mage','tank','archer'][length(hero_name) % 4 + 1] AS heroType, min(skin_id) AS hero_pos, list(skin_name ORDER BY skin_id) AS skins,
  list('//img.example.org/' || skin_id || '.jpg' ORDER BY skin_id) FILTER (WHERE pos % 3 <> 2) AS urls,
  string_agg(skin_name, '|' ORDER BY skin_id) FILTER (WHERE p_size > 1) AS skinName
  FROM (SELECT *, row_number() OVER (PARTITION BY hero_name ORDER BY skin_id) - 1 AS pos FROM skins) GROUP BY hero_name)"""


def hero_skins(nested: DataFrame) -> DataFrame:
    """(cname, heroType, hero_pos, skin, skin_index from 1, total, url) from nested heroes; a url beyond the list is null."""
    rows = nested.select("cname", "heroType", "hero_pos", F.size("skins").alias("total"), "urls", F.posexplode("skins").alias("pos", "skin"))
    return rows.select("cname", "heroType", "hero_pos", "skin", (F.col("pos") + 1).alias("skin_index"), "total", F.get("urls", F.col("pos")).alias("url"))


HERO_SKINS = HEROES + """, hero_skins AS (SELECT cname, heroType, hero_pos, unnest(skins) AS skin, CAST(generate_subscripts(skins, 1) AS INTEGER) AS skin_index, CAST(len(skins) AS INTEGER) AS total, urls FROM heroes)"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_partkey").alias("skin_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_shipdate").alias("listed_at"), F.col("l_returnflag").alias("flag"))


LISTINGS = "listings AS (SELECT l_partkey AS skin_id, l_extendedprice / l_quantity AS price, l_shipdate AS listed_at, l_returnflag AS flag FROM lineitem)"


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("skin_id"), F.col("o_custkey").alias("user_id"), F.col("l_extendedprice").alias("spend"), F.col("l_shipdate").alias("day"))


SALES = "sales AS (SELECT l_partkey AS skin_id, o_custkey AS user_id, l_extendedprice AS spend, l_shipdate AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def hero_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(table(spark, sf_dir, "events"))


def events_of(events: DataFrame) -> DataFrame:
    hero = F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string"))
    return events.select("event_id", "ts", hero.alias("hero_name"), "event_type", "value", "props")


HERO_EVENTS = "hero_events AS (SELECT event_id, ts, 'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR) AS hero_name, event_type, value, props FROM events)"


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts: hero by source, sentiment by labels where there are any, a day by id."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    hero = F.concat(F.lit("Brand#"), (F.regexp_extract("source", r"(\d+)$", 1).cast("int") + 1).cast("string"))
    feeling = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "neutral")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int"))
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("post_id"), hero.alias("hero_name"), "source", "lang", day.alias("day"), "text", feeling.alias("sentiment"), "quality")


POSTS = """posts AS (SELECT d.doc_id AS post_id, 'Brand#' || CAST(CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) + 1 AS VARCHAR) AS hero_name, source, lang,
  CAST(DATE '2024-01-01' + CAST(d.doc_id % 60 AS INTEGER) AS DATE) AS day, text, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN 'neutral' END AS sentiment, quality
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored model answers over the items: JSON in a fence, in prose, bare, or cut off."""
    rows = skins(spark, sf_dir)
    k = F.col("skin_id")
    body = F.concat(
        F.lit('{"rarity_tier":"'), F.get(F.array(*map(F.lit, ("勇者", "史诗", "传说", "无双", "荣耀典藏", "?"))), (k % 6).cast("int")), F.lit('","dominant_colors":["#'), F.lower(F.lpad(F.hex(k * 7919 % 16777216), 6, "0")),
        F.lit('","#00ff00","#0000ff","#102030","#a0b0c0"],"scene_type":"indoor","character_ratio":'), (k % 12).cast("string"), F.lit('e-1,"effect_density":"'), F.get(F.array(*map(F.lit, ("low", "mid", "high", "extreme"))), (k % 4).cast("int")),
        F.lit('","model_detail":'), (k % 10).cast("string"), F.lit('.5,"effect_quality":'), (k % 9).cast("string"), F.lit('.25,"color_scheme":'), (k % 7).cast("string"), F.lit('.0,"composition":'), (k % 8).cast("string"),
        F.lit('.0,"similar":"'), F.col("hero_name"), F.lit("-"), F.col("skin_name"), F.lit('"}'),
    )
    way = k % 5
    text = F.when(way == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(way == 1, F.concat(F.lit("Here it is: "), body, F.lit(" Done."))).when(way == 2, body).when(way == 3, F.substring(body, 1, 40)).otherwise(F.lit(""))
    model = F.get(F.array(*map(F.lit, ("vl-a", "vl-b", "vl-c"))), (F.col("p_size") % 3).cast("int"))
    return rows.select("skin_id", "hero_name", model.alias("model"), (k % 700 / F.lit(32.0)).alias("elapsed"), text.alias("response"))


ANSWERS = SKINS + """, bodies AS (SELECT skin_id, hero_name, p_size, '{"rarity_tier":"' || ['勇者','史诗','传说','无双','荣耀典藏','?'][skin_id % 6 + 1] || '","dominant_colors":["#' || lower(lpad(printf('%x', skin_id * 7919 % 16777216), 6, '0'))
  || '","#00ff00","#0000ff","#102030","#a0b0c0"],"scene_type":"indoor","character_ratio":' || (skin_id % 12) || 'e-1,"effect_density":"' || ['low','mid','high','extreme'][skin_id % 4 + 1]
  || '","model_detail":' || (skin_id % 10) || '.5,"effect_quality":' || (skin_id % 9) || '.25,"color_scheme":' || (skin_id % 7) || '.0,"composition":' || (skin_id % 8) || '.0,"similar":"' || hero_name || '-' || skin_name || '"}' AS body FROM skins),
answers AS (SELECT skin_id, hero_name, ['vl-a','vl-b','vl-c'][p_size % 3 + 1] AS model, skin_id % 700 / 32.0::DOUBLE AS elapsed,
  CASE skin_id % 5 WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 1 THEN 'Here it is: ' || body || ' Done.' WHEN 2 THEN body WHEN 3 THEN substr(body, 1, 40) ELSE '' END AS response FROM bodies)"""


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw feed entries (source_index, raw) shaped as the landed feed, with empty, null, absent and odd cells and a key that is not the feed's."""
    k = F.col("skin_id")
    rows = skins(spark, sf_dir)
    cells = {
        "pfidlb_3934": (k % 1000).cast("string"), "yxmclb_9965": F.col("hero_name"), "pfmclb_7523": F.concat(F.col("skin_name"), F.when(k % 11 == 0, F.lit(' : "x" ')).otherwise(F.lit(""))),
        "pfpzlb_3289": F.when(k % 13 != 0, F.col("official_tier").cast("string")), "sxsjlb_1516": F.lit("2024-01-01"),
        "hqfs_8609": F.when(k % 4 == 0, F.concat(F.lit("直购"), k.cast("string"), F.lit("点券 或 3.5 荣耀积分"))).when(k % 4 == 1, F.lit("活动赠送")).when(k % 4 == 2, F.concat((k % 90).cast("string"), F.lit("皮肤碎片"))),
        "fmlb_4536": F.lit(""), "fmb1lb_5300": F.when(k % 3 == 0, F.concat(F.lit("//img.example.org/a/"), k.cast("string"), F.lit(".PNG?x=1"))).when(k % 3 == 1, F.lit("")), "yxtxlb_8443": F.concat(F.lit("https://h/"), k.cast("string"), F.lit(".tiff")),
        "added_1": (k % 7).cast("int"),
    }
    text = lambda names: F.to_json(F.struct(*[cells[n].alias(n) for n in names]), {"ignoreNullFields": "false"})
    raw = F.when(k % 4 == 3, text([n for n in cells if n != "hqfs_8609"])).otherwise(text(list(cells)))
    return rows.select((k + 1).cast("int").alias("source_index"), F.parse_json(raw).alias("raw"))


FEED = SKINS + """, feed AS (SELECT CAST(skin_id + 1 AS INTEGER) AS source_index, CAST(skin_id % 1000 AS VARCHAR) AS id, hero_name, skin_name || CASE WHEN skin_id % 11 = 0 THEN ' : "x" ' ELSE '' END AS skin_name,
  CASE WHEN skin_id % 13 <> 0 THEN CAST(official_tier AS VARCHAR) END AS quality, '2024-01-01' AS online_date,
  CASE WHEN skin_id % 4 = 0 THEN '直购' || skin_id || '点券 或 3.5 荣耀积分' WHEN skin_id % 4 = 1 THEN '活动赠送' WHEN skin_id % 4 = 2 THEN (skin_id % 90) || '皮肤碎片' ELSE '' END AS acquire,
  '' AS image_a, CASE WHEN skin_id % 3 = 0 THEN '//img.example.org/a/' || skin_id || '.PNG?x=1' WHEN skin_id % 3 = 1 THEN '' END AS image_b, 'https://h/' || skin_id || '.tiff' AS image_c FROM skins)"""
