"""Registered queries over the feature vector: scores, prices, risks, neighbours, regression, the whole evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, features, learning, scoring, similar
from ..functions import text
from ..sources import adapters as A
from ..sources.feature_view import FEATURE_SQL, feature_view
from ..sources.files import kept

DIMENSIONS = tuple(scoring.WEIGHTS)


def feature_table(spark, d):
    """The feature view, written once: bounds, scores and comparisons all read it."""
    return kept(feature_view(spark, d), "features")


def _scored(spark, d):
    view = feature_table(spark, d)
    return scoring.scorecard(view, scoring.fit(view))


def feature_fusion(spark, d):
    view = features.filled(feature_view(spark, d))
    return view.select("skin_id", "hero_name", *[F.col(f).cast("double").alias(f) for f in features.FEATURES])


def feature_groups(spark, d):
    rows = features.grouped(feature_view(spark, d))
    return rows.select("skin_id", F.col("aesthetic.official_tier").alias("tier"), F.col("belonging.community_post_count").alias("posts"), F.col("collection.series_membership").alias("series"), F.col("surprise.acquisition_method").alias("method"))


def feature_vector(spark, d):
    """The features as one array in their order: its length and some of its places."""
    rows = features.vector(feature_view(spark, d))
    return rows.select("skin_id", F.size("vector").alias("length"), F.col("vector")[4].alias("tier"), F.col("vector")[14].alias("posts"), F.col("vector")[32].alias("spend"))


def bundle(spark, d):
    community = facts.sentiment(A.posts(spark, d), F.lit("2024-02-29").cast("date"))
    market = facts.resale(A.listings(spark, d), A.skins(spark, d))
    out = features.bundle(A.skins(spark, d).select("skin_id", "hero_name", "skin_name", "official_price"), community, market, F.lit("2024-02-29").cast("date"))
    return out.select("skin_id", "hero_name", "official_price", F.col("community.posts").alias("posts"), F.col("market.listings").alias("listings"), F.col("market.median_price").alias("median_price"), "collected_at")


def normalizers(spark, d):
    view = feature_table(spark, d)
    rows = scoring.with_normals(view, scoring.fit(view))
    return rows.select("skin_id", *[F.round(f"n_{r.feature}", 6).alias(r.feature) for r in scoring.RULES])


def scorecard(spark, d):
    return _scored(spark, d).select("skin_id", *DIMENSIONS, "total_premium")


def scorecard_neutral(spark, d):
    """Missing features count as the middle, not as 0."""
    view = feature_table(spark, d)
    return scoring.scorecard(view, scoring.fit(view), missing="neutral").select("skin_id", *DIMENSIONS, "total_premium")


def scorecard_long(spark, d):
    view = feature_table(spark, d)
    return scoring.scorecard_long(view, scoring.fit(view)).groupBy("skin_id", "dimension").agg(F.round(F.sum("points"), 4).alias("points"), F.count(F.lit(1)).alias("features"))


def what_if(spark, d):
    view = feature_table(spark, d)
    scenarios = spark.createDataFrame([("voice", True, None), ("top_tier", None, 5), ("both", True, 5)], "scenario string, has_voice_pack boolean, official_tier int")
    return scoring.what_if(view, scenarios, scoring.fit(view)).select("skin_id", "scenario", "aesthetic", "total_premium")


def price_range(spark, d):
    return scoring.with_prices(_scored(spark, d)).select("skin_id", "total_premium", "price_min", "price_max", "confidence", "per_point")


def premium_bands(spark, d):
    return _scored(spark, d).groupBy(scoring.band(F.col("total_premium")).alias("band")).agg(F.count(F.lit(1)).alias("skins"))


def risk_alerts(spark, d):
    return scoring.risks(scoring.with_prices(_scored(spark, d)))


def risk_counts(spark, d):
    return risk_alerts(spark, d).groupBy("level", "type").agg(F.count(F.lit(1)).alias("alerts"))


def radar_long(spark, d):
    return scoring.radar(_scored(spark, d))


def comparables(spark, d):
    return similar.comparables(_scored(spark, d)).select("target_id", "place", "skin_id", "total_premium", "gap")


def _items(spark, d):
    rows = A.table(spark, d, "embeddings")
    return rows.select(F.col("vec_id").alias("skin_id"), F.concat(F.lit("G"), (F.col("vec_id") % 2).cast("string")).alias("genre"), F.col("label").alias("official_tier"), F.col("embedding").alias("vector"))


def competitors(spark, d):
    return similar.competitors(_items(spark, d)).select("target_id", "place", "skin_id", "similarity")


def comparison_lines(spark, d):
    """One text per item: its five competitors with their totals and differences."""
    found = similar.competitors(_items(spark, d))
    total = (F.col("vec_id") * 37 % 101).cast("int")
    totals = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("_id"), total.alias("total"))
    rows = found.join(totals.withColumnRenamed("total", "own").hint("merge"), F.col("target_id") == F.col("_id")).drop("_id").join(totals.hint("merge"), F.col("skin_id") == F.col("_id"))
    line = text.comparison_line(F.concat(F.lit("G "), F.col("skin_id").cast("string")), F.col("total"), F.col("own"))
    lines = rows.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    return lines.select("target_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def peers(spark, d):
    return similar.peers(A.skins(spark, d)).select("target_id", "place", "skin_id", "ways", "gap")


def lsh_neighbors(spark, d):
    return similar.nearest(_items(spark, d)).select("target_id", "place", "skin_id", "similarity")


def _pairs(spark, d):
    """Pairwise comparisons of the five item kinds, one matrix per brand, from mean prices and sizes."""
    rows = A.table(spark, d, "part").where("p_type <> 'PROMO'").groupBy("p_brand", "p_type").agg(F.avg("p_size").alias("m"))
    b = rows.select(F.col("p_brand").alias("_b"), F.col("p_type").alias("j"), F.col("m").alias("_m"))
    return rows.join(b, F.col("p_brand") == F.col("_b")).select(F.col("p_brand").alias("matrix"), F.col("p_type").alias("i"), "j", (F.col("m") / F.col("_m")).alias("v"))


def ahp_weights(spark, d):
    return scoring.ahp_weights(_pairs(spark, d)).select("matrix", "i", "weight", F.abs(F.round("consistency_ratio", 4)).alias("consistency_ratio"))


def _targets(spark, d, view):
    """The targets of the view's items; what a buyer spends on the mean is among their features."""
    skins = view.select("skin_id", "genre", "official_price", "acquisition", F.col("avg_spend_to_obtain").alias("mean_spend"))
    return facts.scaled_target(skins, None, facts.resale(A.listings(spark, d), A.skins(spark, d)))


def target(spark, d):
    return _targets(spark, d, feature_view(spark, d))


def _learning_rows(spark, d):
    view = feature_table(spark, d)
    return kept(view.join(_targets(spark, d, view).select("skin_id", "target"), "skin_id"), "learning")


def regression_eval(spark, d):
    return learning.cross_validated(_learning_rows(spark, d))


def importance_weights(spark, d):
    return learning.dimension_weights(learning.importance(learning.fit(_learning_rows(spark, d)), spark))


def blend(spark, d):
    rows = _learning_rows(spark, d)
    scored = scoring.scorecard(rows, scoring.fit(rows))
    return learning.blended(scored, learning.fit(rows), rows.count()).select("skin_id", "rule_based", "ml_based", "alpha", "total_premium")


def blend_cold(spark, d):
    """With fewer labels than the cold-start bound the rules decide alone."""
    return learning.blended(_scored(spark, d), None, 10).select("skin_id", "rule_based", "alpha", "total_premium")


def fit_quality(spark, d):
    """Quality of a plain estimate: the resale median against the official price."""
    rows = facts.resale(A.listings(spark, d), A.skins(spark, d)).join(A.skins(spark, d), "skin_id")
    return learning.quality(rows, "official_price", "median_price").select("rows", F.round("mape", 4).alias("mape"), F.round("r2", 2).alias("r2"), F.round("mae", 2).alias("mae"))


def spearman(spark, d):
    rows = _scored(spark, d).select("genre", "aesthetic", "total_premium", "official_price")
    return learning.spearman(rows, [("aesthetic", "total_premium"), ("aesthetic", "official_price")], "genre")


def evaluate_all(spark, d):
    """Every item: features, scores, price range, alerts, price band, nearest comparable. One DAG over all tables."""
    priced = scoring.with_prices(_scored(spark, d))
    alerts = scoring.risks(priced).groupBy("skin_id").agg(F.count(F.lit(1)).alias("alerts"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("alert_types"))
    near = similar.comparables(priced, 1).select(F.col("target_id").alias("skin_id"), F.col("skin_id").alias("comparable"))
    out = priced.join(alerts.hint("merge"), "skin_id", "left").join(near.hint("merge"), "skin_id", "left")
    return out.select("skin_id", "hero_name", "skin_name", "genre", "official_price", *DIMENSIONS, "total_premium", "price_min", "price_max", "confidence", "per_point", F.coalesce("alerts", F.lit(0)).alias("alerts"), F.coalesce("alert_types", F.lit("")).alias("alert_types"), scoring.band(F.col("total_premium")).alias("band"), "comparable")


def report_values(spark, d):
    """What a report on an item tells: its scores, its marks, how it is sought and talked about, its price and what it costs to get."""
    scored = _scored(spark, d)
    premium = facts.resale(A.listings(spark, d), A.skins(spark, d)).select("skin_id", "resale_premium")
    marks = ["official_tier", "acquisition", "is_limited", "ip_source_type", "vlm_art_quality", "baidu_index_7d", "community_post_count", "official_price"]
    return scored.join(premium, "skin_id", "left").select("skin_id", "hero_name", "skin_name", "genre", *DIMENSIONS, "total_premium", *marks, "resale_premium", F.round("avg_spend_to_obtain", 4).alias("mean_spend"))


QUERIES = {f.__name__: f for f in (
    feature_fusion, feature_groups, feature_vector, bundle, normalizers, scorecard, scorecard_neutral, scorecard_long, what_if, price_range, premium_bands, risk_alerts, risk_counts, radar_long, comparables, competitors, comparison_lines, peers, lsh_neighbors, ahp_weights, target,
    regression_eval, importance_weights, blend, blend_cold, fit_quality, spearman, evaluate_all, report_values,
)}


def _norm_sql(r: scoring.Rule, neutral: bool = False) -> str:
    x = f"coalesce(CAST({r.feature} AS DOUBLE), 0.0)"
    top = f"(SELECT max(CAST({r.feature} AS DOUBLE)) FROM features)"
    how = {
        "minmax": f"({x} - {r.low}.0::DOUBLE) / ({r.high}.0::DOUBLE - {r.low}.0::DOUBLE)" if r.high is not None else "", "invert_minmax": f"1.0::DOUBLE - ({x} - {r.low}.0::DOUBLE) / ({r.high}.0::DOUBLE - {r.low}.0::DOUBLE)" if r.high is not None else "",
        "max_divide": f"{x} / {r.high}.0::DOUBLE", "binary": x, "log": f"ln(1 + {x}) / ln(1 + {top})", "invert_rank": f"1.0::DOUBLE - {x} / {top}", "log_clip": f"ln(1 + least(greatest({x}, 0.0), {r.high}.0::DOUBLE)) / ln(1 + {r.high}.0::DOUBLE)",
        "mapped": "CASE acquisition WHEN 'direct' THEN 0.2 WHEN 'battle_pass' THEN 0.4 WHEN 'shard' THEN 0.5 WHEN 'gacha' THEN 0.8 WHEN 'event' THEN 0.6 ELSE 0 END::DOUBLE",
    }[r.how]
    column = "acquisition" if r.how == "mapped" else r.feature
    return f"CASE WHEN {column} IS NULL THEN 0.5::DOUBLE ELSE {how} END" if neutral else how


def _scores_sql(neutral: bool = False, source: str = "features") -> str:
    """CTEs n (normalised), s (sub-scores), t (total)."""
    normals = ", ".join(f"{_norm_sql(r, neutral)} AS n_{r.feature}" for r in scoring.RULES)
    subs = ", ".join(f"CAST(least(greatest(round_even(round((" + " + ".join(f"n_{r.feature} * {r.weight}::DOUBLE" for r in scoring.RULES if r.dimension == dim) + f") * 100, 9), 0), 0), 100) AS INTEGER) AS {dim}" for dim in DIMENSIONS)
    total = " + ".join(f"{dim} * {w}::DOUBLE" for dim, w in scoring.WEIGHTS.items())
    return f"n AS (SELECT *, {normals} FROM {source}), s AS (SELECT *, {subs} FROM n), t AS (SELECT *, CAST(round_even(round({total}, 9), 0) AS INTEGER) AS total_premium FROM s)"


_T = f"WITH {FEATURE_SQL}, {_scores_sql()}"
_ANCHOR = {c: "CASE " + " ".join(f"WHEN total_premium <= {(a[0] + b[0]) / 2} THEN {a[i]}" for a, b in zip(scoring.ANCHORS["MOBA"], scoring.ANCHORS["MOBA"][1:])) + f" ELSE {scoring.ANCHORS['MOBA'][-1][i]} END" for c, i in (("low", 1), ("high", 2))}
_SCALE = "(1.0::DOUBLE + 0.5::DOUBLE * (total_premium / 100.0::DOUBLE))"
_P = _T + f""", p AS (SELECT *, CAST(round_even(round({_ANCHOR['low']} * {_SCALE}, 9), 0) AS INTEGER) AS price_min, CAST(round_even(round({_ANCHOR['high']} * {_SCALE}, 9), 0) AS INTEGER) AS price_max,
  CASE WHEN official_tier >= 3 THEN 0.85 ELSE 0.70 END::DOUBLE AS confidence, CASE WHEN total_premium > 0 THEN round({_ANCHOR['high']} * {_SCALE} / total_premium, 1) ELSE 0 END::DOUBLE AS per_point FROM t)"""
_R = _P + """, a AS (SELECT skin_id, unnest(list_concat(list_concat(
  CASE WHEN official_price > price_max * 1.3::DOUBLE THEN ['high|overpricing'] WHEN official_price < price_min * 0.7::DOUBLE THEN ['medium|underpricing'] ELSE [] END,
  CASE WHEN is_limited AND coalesce(rerun_count, 0) >= 3 THEN ['high|rerun_dilution'] ELSE [] END), CASE WHEN aesthetic < 40 AND total_premium > 60 THEN ['medium|aesthetic_deficit'] ELSE [] END)) AS x,
  generate_subscripts(list_concat(list_concat(
  CASE WHEN official_price > price_max * 1.3::DOUBLE THEN ['high|overpricing'] WHEN official_price < price_min * 0.7::DOUBLE THEN ['medium|underpricing'] ELSE [] END,
  CASE WHEN is_limited AND coalesce(rerun_count, 0) >= 3 THEN ['high|rerun_dilution'] ELSE [] END), CASE WHEN aesthetic < 40 AND total_premium > 60 THEN ['medium|aesthetic_deficit'] ELSE [] END), 1) AS no FROM p),
r AS (SELECT skin_id, CAST(no AS INTEGER) AS alert_no, split_part(x, '|', 1) AS level, split_part(x, '|', 2) AS type FROM a)"""
_BAND = "CASE WHEN total_premium < 20 THEN '0-20' WHEN total_premium < 40 THEN '20-40' WHEN total_premium < 60 THEN '40-60' WHEN total_premium < 80 THEN '60-80' ELSE '80-100' END"
_COMPARE = """SELECT a.skin_id AS target_id, b.skin_id, b.total_premium, abs(a.total_premium - b.total_premium) AS gap, CAST(row_number() OVER (PARTITION BY a.skin_id ORDER BY abs(a.total_premium - b.total_premium), b.skin_id) AS INTEGER) AS place
  FROM t a JOIN t b ON a.genre = b.genre AND abs(a.official_tier - b.official_tier) <= 1 AND a.skin_id <> b.skin_id"""
_COMP = """WITH e AS (SELECT vec_id AS skin_id, vec_id % 2 AS genre, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT a.skin_id AS target_id, b.skin_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON a.genre = b.genre AND abs(a.label - b.label) <= 1 AND a.skin_id <> b.skin_id),
k AS (SELECT target_id, CAST(row_number() OVER (PARTITION BY target_id ORDER BY similarity DESC, skin_id) AS INTEGER) AS place, skin_id, similarity FROM c QUALIFY place <= 5)"""
_NEAR = """WITH e AS (SELECT vec_id AS skin_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT a.skin_id AS target_id, b.skin_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON a.skin_id <> b.skin_id AND len(a.v) = len(b.v))
SELECT target_id, CAST(row_number() OVER (PARTITION BY target_id ORDER BY similarity DESC, skin_id) AS INTEGER) AS place, skin_id, similarity FROM c QUALIFY place <= 5"""
_LONG = " UNION ALL ".join(f"SELECT skin_id, '{dim}' AS dimension, round(sum(x), 4) AS points, {sum(r.dimension == dim for r in scoring.RULES)} AS features FROM (SELECT skin_id, unnest([" + ", ".join(f"n_{r.feature} * {r.weight}::DOUBLE * 100" for r in scoring.RULES if r.dimension == dim) + "]) AS x FROM n) GROUP BY 1" for dim in DIMENSIONS)
_RANK = "rank() OVER (PARTITION BY genre ORDER BY {0}) + (count(*) OVER (PARTITION BY genre, {0}) - 1) / 2.0::DOUBLE"
SQL = {
    "feature_fusion": f"WITH {FEATURE_SQL} SELECT skin_id, hero_name, " + ", ".join(f"coalesce(CAST({f} AS DOUBLE), 0) AS {f}" for f in features.FEATURES) + " FROM features",
    "feature_groups": f"WITH {FEATURE_SQL} SELECT skin_id, official_tier AS tier, community_post_count AS posts, series_membership AS series, CAST(acquisition_method AS INTEGER) AS method FROM features",
    "feature_vector": f"WITH {FEATURE_SQL} SELECT skin_id, CAST(33 AS INTEGER) AS length, coalesce(CAST(official_tier AS DOUBLE), 0) AS tier, coalesce(CAST(community_post_count AS DOUBLE), 0) AS posts, coalesce(avg_spend_to_obtain, 0) AS spend FROM features",
    "bundle": f"WITH {A.SKINS}, {A.LISTINGS}, {A.POSTS}, c AS (SELECT hero_name, count(*) AS posts FROM posts WHERE day > DATE '2024-01-30' GROUP BY 1), m AS (SELECT skin_id, count(*) AS listings, round(median(price), 9) AS median_price FROM listings GROUP BY 1) SELECT s.skin_id, s.hero_name, official_price, posts, listings, median_price, DATE '2024-02-29' AS collected_at FROM skins s LEFT JOIN m ON s.skin_id = m.skin_id LEFT JOIN c ON s.hero_name = c.hero_name",
    "normalizers": f"WITH {FEATURE_SQL}, {_scores_sql()} SELECT skin_id, " + ", ".join(f"round(n_{r.feature}, 6) AS {r.feature}" for r in scoring.RULES) + " FROM n",
    "scorecard": f"{_T} SELECT skin_id, {', '.join(DIMENSIONS)}, total_premium FROM t",
    "scorecard_neutral": f"WITH {FEATURE_SQL}, {_scores_sql(True)} SELECT skin_id, {', '.join(DIMENSIONS)}, total_premium FROM t",
    "scorecard_long": f"{_T} SELECT skin_id, dimension, points, CAST(features AS BIGINT) AS features FROM ({_LONG})",
    "what_if": f"WITH {FEATURE_SQL}, w(scenario, v, o) AS (VALUES ('voice', true, NULL), ('top_tier', NULL, 5), ('both', true, 5)), x AS (SELECT * REPLACE (coalesce(v, has_voice_pack) AS has_voice_pack, coalesce(o, official_tier) AS official_tier) FROM features, w), {_scores_sql(source='x')} SELECT skin_id, scenario, aesthetic, total_premium FROM t",
    "price_range": f"{_P} SELECT skin_id, total_premium, price_min, price_max, confidence, per_point FROM p",
    "premium_bands": f"{_T} SELECT {_BAND} AS band, count(*) AS skins FROM t GROUP BY 1",
    "risk_alerts": f"{_R} SELECT * FROM r",
    "risk_counts": f"{_R} SELECT level, type, count(*) AS alerts FROM r GROUP BY 1, 2",
    "radar_long": f"{_T} " + " UNION ALL ".join(f"SELECT skin_id, '{dim}' AS dimension, {dim} AS score FROM t" for dim in DIMENSIONS),
    "comparables": f"{_T} SELECT * FROM ({_COMPARE}) WHERE place <= 5",
    "competitors": f"{_COMP} SELECT * FROM k",
    "lsh_neighbors": _NEAR,
    "comparison_lines": f"{_COMP} SELECT target_id, string_agg('- G ' || skin_id || ': 情绪溢价 ' || (skin_id * 37 % 101) || ' (' || CASE WHEN target_id * 37 % 101 > skin_id * 37 % 101 THEN '↑' ELSE '↓' END || abs(target_id * 37 % 101 - skin_id * 37 % 101) || ' vs 当前皮肤)', chr(10) ORDER BY place) AS text FROM k GROUP BY 1",
    "peers": f"WITH {A.SKINS}, w AS (SELECT a.skin_id AS target_id, b.skin_id, CAST((a.hero_name = b.hero_name)::INT + (a.series = b.series)::INT + (a.official_tier = b.official_tier)::INT AS BIGINT) AS ways, round(abs(a.official_price - b.official_price), 4) AS gap FROM skins a JOIN skins b ON a.genre = b.genre AND a.skin_id <> b.skin_id) SELECT * FROM (SELECT target_id, CAST(row_number() OVER (PARTITION BY target_id ORDER BY ways DESC, gap, skin_id) AS INTEGER) AS place, skin_id, ways, gap FROM w WHERE ways > 0) WHERE place <= 5",
    "ahp_weights": "WITH m AS (SELECT p_brand AS matrix, p_type AS i, avg(p_size) AS m FROM part WHERE p_type <> 'PROMO' GROUP BY 1, 2), p AS (SELECT a.matrix, a.i, b.i AS j, a.m / b.m AS v FROM m a JOIN m b ON a.matrix = b.matrix), g AS (SELECT matrix, i, exp(avg(ln(v))) AS g FROM p GROUP BY 1, 2) SELECT matrix, i, round(g / sum(g) OVER (PARTITION BY matrix), 6) AS weight, 0.0::DOUBLE AS consistency_ratio FROM g",
    "target": f"WITH {FEATURE_SQL}, pr AS (SELECT l.skin_id, round(avg((price - official_price) / official_price), 4) AS resale_premium FROM listings l JOIN skins s ON l.skin_id = s.skin_id GROUP BY 1), b AS (SELECT f.skin_id, genre, CASE WHEN acquisition = 'gacha' AND avg_spend_to_obtain IS NOT NULL THEN avg_spend_to_obtain ELSE official_price END * (1 + greatest(coalesce(resale_premium, 0), 0)) AS price FROM features f LEFT JOIN pr ON f.skin_id = pr.skin_id) SELECT skin_id, genre, round(price / max(price) OVER (PARTITION BY genre), 6) AS target FROM b",
    "report_values": f"{_T}, pr AS (SELECT l.skin_id, round(avg((price - official_price) / official_price), 4) AS resale_premium FROM listings l JOIN skins s ON l.skin_id = s.skin_id GROUP BY 1) SELECT t.skin_id, hero_name, skin_name, genre, {', '.join(DIMENSIONS)}, total_premium, official_tier, acquisition, is_limited, CAST(ip_source_type AS INTEGER) AS ip_source_type, vlm_art_quality, baidu_index_7d, community_post_count, official_price, resale_premium, round(avg_spend_to_obtain, 4) AS mean_spend FROM t LEFT JOIN pr ON t.skin_id = pr.skin_id",
    "blend_cold": f"{_T} SELECT skin_id, total_premium AS rule_based, 1.0::DOUBLE AS alpha, total_premium FROM t",
    "fit_quality": f"WITH {A.SKINS}, {A.LISTINGS}, m AS (SELECT s.skin_id, any_value(official_price) AS y, round(median(price), 9) AS p FROM listings l JOIN skins s ON l.skin_id = s.skin_id GROUP BY 1) SELECT count(*) AS rows, round(avg(abs((p - y) / y)), 4) AS mape, round(1 - sum((y - p) * (y - p)) / sum((y - (SELECT avg(y) FROM m)) * (y - (SELECT avg(y) FROM m))), 2) AS r2, round(avg(abs(p - y)), 2) AS mae FROM m",
    "spearman": f"{_T}, k AS (SELECT genre, {_RANK.format('aesthetic')} AS a, {_RANK.format('total_premium')} AS b, {_RANK.format('official_price')} AS c FROM t) SELECT genre, round(corr(a, b), 6) AS aesthetic_total_premium, round(corr(a, c), 6) AS aesthetic_official_price FROM k GROUP BY 1",
    "evaluate_all": f"{_R}, g AS (SELECT skin_id, count(*) AS alerts, string_agg(DISTINCT type, ',' ORDER BY type) AS alert_types FROM r GROUP BY 1), c AS (SELECT * FROM ({_COMPARE}) WHERE place = 1) SELECT p.skin_id, hero_name, skin_name, genre, official_price, {', '.join(DIMENSIONS)}, p.total_premium, price_min, price_max, confidence, per_point, coalesce(alerts, 0) AS alerts, coalesce(alert_types, '') AS alert_types, {_BAND.replace('total_premium', 'p.total_premium')} AS band, c.skin_id AS comparable FROM p LEFT JOIN g ON p.skin_id = g.skin_id LEFT JOIN c ON p.skin_id = c.target_id",
}
