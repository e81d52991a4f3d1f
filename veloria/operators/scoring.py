"""The five-dimension scorecard, its explanation in long form, what-if scenarios, prices, risks and bands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, normal


@dataclass(frozen=True)
class Rule:
    dimension: str
    feature: str
    weight: float
    how: str
    low: float | None = None
    high: float | None = None


#: The scorecard. Bounds stand where the feature's domain is declared; others are fitted.
RULES = (
    Rule("aesthetic", "vlm_art_quality", 0.25, "minmax", 0, 10), Rule("aesthetic", "vlm_effect_score", 0.25, "minmax", 0, 10), Rule("aesthetic", "vlm_color_harmony", 0.15, "minmax", 0, 1), Rule("aesthetic", "vlm_composition", 0.10, "minmax", 0, 10),
    Rule("aesthetic", "official_tier", 0.20, "max_divide", 0, 5), Rule("aesthetic", "has_voice_pack", 0.03, "binary"), Rule("aesthetic", "has_custom_anim", 0.02, "binary"),
    Rule("belonging", "baidu_index_7d", 0.30, "log"), Rule("belonging", "community_post_count", 0.25, "log"), Rule("belonging", "ip_popularity", 0.20, "minmax", 0, 1), Rule("belonging", "character_usage_rate", 0.15, "minmax", 0, 1), Rule("belonging", "bilibili_video_views", 0.10, "log"),
    Rule("showing_off", "battle_effect_visibility", 0.35, "minmax", 0, 3), Rule("showing_off", "lobby_display_level", 0.25, "minmax", 0, 3), Rule("showing_off", "kill_broadcast_type", 0.20, "minmax", 0, 3), Rule("showing_off", "is_giftable", 0.10, "binary"), Rule("showing_off", "gift_popularity_rank", 0.10, "invert_rank"),
    Rule("collection", "is_limited", 0.30, "binary"), Rule("collection", "series_completion_bonus", 0.20, "binary"), Rule("collection", "ownership_rate", 0.25, "invert_minmax", 0, 1), Rule("collection", "rerun_count", 0.10, "invert_rank"), Rule("collection", "days_since_last_rerun", 0.15, "log_clip", 0, 730),
    Rule("surprise", "acquisition_method_score", 0.35, "mapped"), Rule("surprise", "gacha_pity_amount", 0.25, "log"), Rule("surprise", "drop_rate_percentile", 0.25, "invert_minmax", 0, 1), Rule("surprise", "avg_spend_to_obtain", 0.15, "log"),
)
#: Dimension weights; price anchors (score, least, most); premium band bounds; risk texts.
WEIGHTS = {"aesthetic": 0.30, "belonging": 0.20, "showing_off": 0.25, "collection": 0.15, "surprise": 0.10}
ANCHORS = {"MOBA": ((0, 0, 0), (20, 6, 28), (40, 28, 48), (60, 48, 88), (80, 88, 178), (95, 178, 288))}
BANDS = (20, 40, 60, 80)
UNSCORED = ("skin_age_days", "weibo_followers", "ip_source_type", "character_win_rate", "has_leaderboard_bonus", "series_membership", "limited_type")
FITTED = tuple(r.feature for r in RULES if r.how in ("log", "invert_rank"))


def normalised(rule: Rule, low: Column | None = None, high: Column | None = None, missing: str = "zero") -> Column:
    """A feature's 0..1 value. A missing feature counts as 0 before the normaliser, or as 0.5 after it (``neutral``)."""
    col = F.col(rule.feature)
    x = F.coalesce(col.cast("double"), F.lit(0.0)) if rule.how != "mapped" else col
    top = high if high is not None else F.lit(float(rule.high or 0))
    ways = {
        "minmax": lambda: normal.minmax(x, rule.low if rule.low is not None else low, rule.high if rule.high is not None else high),
        "invert_minmax": lambda: normal.invert_minmax(x, rule.low if rule.low is not None else low, rule.high if rule.high is not None else high),
        "max_divide": lambda: normal.max_divide(x, rule.high), "binary": lambda: normal.binary(x), "log": lambda: normal.log_scale(x, top), "invert_rank": lambda: normal.invert_rank(x, top),
        "log_clip": lambda: normal.log_clip(x, rule.high), "mapped": lambda: codes.mapped(x, codes.ACQUISITION_SCORES),
    }
    out = ways[rule.how]()
    return F.when(col.isNull(), F.lit(0.5)).otherwise(out) if missing == "neutral" else out


def fit(features: DataFrame) -> DataFrame:
    """One row of fitted bounds, to be kept with the model and used for later rows as well."""
    return normal.fit_bounds(features, list(FITTED))


def with_normals(features: DataFrame, bounds: DataFrame, missing: str = "zero") -> DataFrame:
    """``features`` with n_<feature> of all scored features; bounds is one row."""
    high = lambda r: F.col(f"max_{r.feature}") if r.feature in FITTED else None
    low = lambda r: F.col(f"min_{r.feature}") if r.feature in FITTED else None
    joined = features.join(F.broadcast(bounds))
    return joined.withColumns({f"n_{r.feature}": normalised(r, low(r), high(r), missing) for r in RULES}).drop(*bounds.columns)


def sub_score(dimension: str) -> Column:
    """Weighted sum in rule order, as a whole number of 0..100, half to even."""
    total = None
    for r in (r for r in RULES if r.dimension == dimension):
        term = F.col(f"n_{r.feature}") * F.lit(r.weight)
        total = term if total is None else total + term
    return F.least(F.greatest(F.rint(F.round(total * 100, 9)), F.lit(0.0)), F.lit(100.0)).cast("int")


def total_score(weights: dict[str, float] = WEIGHTS) -> Column:
    total = None
    for d, w in weights.items():
        term = F.col(d) * F.lit(w)
        total = term if total is None else total + term
    return F.rint(F.round(total, 9)).cast("int")


def scorecard(features: DataFrame, bounds: DataFrame, missing: str = "zero", weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``features`` with the five sub-scores and total_premium: one pass, no shuffle of features."""
    out = with_normals(features, bounds, missing)
    out = out.withColumns({d: sub_score(d) for d in WEIGHTS}).withColumn("total_premium", total_score(weights))
    return out.drop(*[f"n_{r.feature}" for r in RULES])


def scorecard_long(features: DataFrame, bounds: DataFrame, key: str = "skin_id") -> DataFrame:
    """(key, dimension, feature, value 0..1, weight, points): the explanation of each sub-score."""
    wide = with_normals(features, bounds)
    rows = wide.select(key, F.explode(F.array(*[F.struct(F.lit(r.dimension).alias("dimension"), F.lit(r.feature).alias("feature"), F.col(f"n_{r.feature}").alias("value"), F.lit(r.weight).alias("weight")) for r in RULES])).alias("x")).select(key, "x.*")
    return rows.withColumn("points", F.col("value") * F.col("weight") * 100)


def what_if(features: DataFrame, scenarios: DataFrame, bounds: DataFrame) -> DataFrame:
    """Scores under each scenario: its non-null columns override the features' (column ``scenario`` names it)."""
    overrides = [c for c in scenarios.columns if c != "scenario"]
    named = scenarios.select("scenario", *[F.col(c).alias(f"_{c}") for c in overrides])
    rows = features.join(F.broadcast(named))
    return scorecard(rows.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in overrides}).drop(*[f"_{c}" for c in overrides]), bounds)


def nearest_anchor(score: Column, genre: str = "MOBA") -> Column:
    """The (score, least, most) anchor next to a score, the lower one on ties, as a ladder of conditions."""
    anchors = ANCHORS.get(genre, ANCHORS["MOBA"])
    row = lambda a: F.struct(F.lit(a[0]).alias("score"), F.lit(float(a[1])).alias("least"), F.lit(float(a[2])).alias("most"))
    out = row(anchors[-1])
    for low, high in reversed(list(zip(anchors, anchors[1:], strict=False))):
        out = F.when(score <= (low[0] + high[0]) / 2, row(low)).otherwise(out)
    return out


def with_prices(scored: DataFrame, score: str = "total_premium", tier: str = "official_tier", genre: str = "MOBA") -> DataFrame:
    """Price range, confidence and price per point; a score of 0 or less has 0 per point."""
    s = F.col(score)
    scale = F.lit(1.0) + F.lit(0.5) * (s / 100)
    out = scored.withColumn("_a", nearest_anchor(s, genre)).withColumns({"_low": F.col("_a.least") * scale, "_high": F.col("_a.most") * scale})
    return out.withColumns({"price_min": F.rint(F.round("_low", 9)).cast("int"), "price_max": F.rint(F.round("_high", 9)).cast("int"), "confidence": F.when(F.col(tier) >= 3, 0.85).otherwise(0.70), "per_point": F.when(s > 0, F.round(F.col("_high") / s, 1)).otherwise(0.0)}).drop("_a", "_low", "_high")


def risks(priced: DataFrame, key: str = "skin_id") -> DataFrame:
    """One row per alert: (key, alert_no, level, type). A missing official price counts as 0, missing reruns as 0."""
    price = F.coalesce(F.col("official_price"), F.lit(0.0))
    alert = lambda level, kind: F.struct(F.lit(level).alias("level"), F.lit(kind).alias("type"))
    found = F.array_compact(F.array(
        F.when(price > F.col("price_max") * 1.3, alert("high", "overpricing")).when(price < F.col("price_min") * 0.7, alert("medium", "underpricing")),
        F.when(F.coalesce(F.col("is_limited").cast("boolean"), F.lit(False)) & (F.coalesce("rerun_count", F.lit(0)) >= 3), alert("high", "rerun_dilution")),
        F.when((F.col("aesthetic") < 40) & (F.col("total_premium") > 60), alert("medium", "aesthetic_deficit")),
    ))
    return priced.select(key, F.posexplode(found).alias("n", "a")).select(key, (F.col("n") + 1).alias("alert_no"), "a.level", "a.type")


def band(score: Column) -> Column:
    """'0-20' to '80-100'; a bound belongs to the band that it starts, 100 to the last."""
    out = F.lit(f"{BANDS[-1]}-100")
    for low, high in reversed(list(zip((0, *BANDS), BANDS, strict=False))):
        out = F.when(score < high, F.lit(f"{low}-{high}")).otherwise(out)
    return out


def radar(scored: DataFrame, key: str = "skin_id") -> DataFrame:
    return scored.select(key, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("score")) for d in WEIGHTS])).alias("x")).select(key, "x.*")


def ahp_weights(pairs: DataFrame) -> DataFrame:
    """Weights of each matrix's items from rows (matrix, i, j, v): geometric means of the rows, scaled to a sum of 1; with
    the consistency ratio. A matrix of up to two items is consistent by itself."""
    means = pairs.groupBy("matrix", "i").agg(F.exp(F.avg(F.log("v"))).alias("g"))
    sums = means.groupBy("matrix").agg(F.sum("g").alias("all"), F.count(F.lit(1)).alias("n"))
    weights = means.join(sums, "matrix").select("matrix", "i", (F.col("g") / F.col("all")).alias("weight"), "n")
    columns = weights.select(F.col("matrix").alias("_m"), F.col("i").alias("_j"), F.col("weight").alias("_w"))
    rows = pairs.join(columns, (F.col("matrix") == F.col("_m")) & (F.col("j") == F.col("_j"))).groupBy("matrix", "i").agg(F.sum(F.col("v") * F.col("_w")).alias("_r"))
    largest = rows.join(weights, ["matrix", "i"]).groupBy("matrix").agg(F.avg(F.col("_r") / F.col("weight")).alias("_l"), F.max("n").alias("_n"))
    #: The mean consistency index of random matrices of 3 to 9 items.
    random_index = F.get(F.array(*map(F.lit, (0.58, 0.90, 1.12, 1.24, 1.32, 1.41, 1.45))), (F.col("_n") - 3).cast("int"))
    ratio = F.when(F.col("_n") < 3, 0.0).otherwise((F.col("_l") - F.col("_n")) / (F.col("_n") - 1) / random_index)
    return weights.join(largest.select("matrix", ratio.alias("ratio")), "matrix").select("matrix", "i", F.round("weight", 6).alias("weight"), F.round("ratio", 6).alias("consistency_ratio"))


def blend(rule: Column, model: Column, labels: Column) -> Column:
    """alpha rule + (1 - alpha) 100 model, whole; alpha falls from 1 with the number of labels."""
    alpha = alpha_of(labels)
    return F.rint(F.round(alpha * rule + (F.lit(1.0) - alpha) * 100 * model, 9)).cast("int")


def alpha_of(labels: Column) -> Column:
    return F.lit(0.2) + F.lit(0.8) / (F.lit(1.0) + labels / F.lit(100.0))
