"""Boosted-tree regression on the feature vector, its evaluation, and the blend with the scorecard."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import kept
from . import boosting, facts, scoring
from . import features as fv

#: Fixed value.
COLD_START = 50


def fit(rows: DataFrame, label: str = "target", key: str = "skin_id", **settings) -> boosting.Model:
    """Train on rows with a label; ``settings`` stand in for those of ``boosting.Settings``."""
    return boosting.train(rows, fv.FEATURES, label, key, settings=boosting.Settings(**settings))[0][0]


def quality(predicted: DataFrame, label: str = "target", guess: str = "prediction") -> DataFrame:
    """MAPE (rows with label 0 left out), R2, MAE and the number of rows."""
    y, p = F.col(label), F.col(guess)
    mean = predicted.agg(F.avg(y).alias("_mean"))
    rows = predicted.join(F.broadcast(mean))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(F.try_divide(p - y, y))).alias("mape"), (1 - F.try_divide(F.sum((y - p) * (y - p)), F.sum((y - F.col("_mean")) * (y - F.col("_mean"))))).alias("r2"), F.avg(F.abs(p - y)).alias("mae"))


def predicted_by_folds(rows: DataFrame, label: str = "target", key: str = "skin_id", folds: int = 5, **settings) -> DataFrame:
    """(key, fold, y, prediction): each labelled row predicted by the model that is trained on the other folds.

    Folds go by hash of the key. All models grow together, so this costs as many jobs as one model.
    """
    _, blocks = boosting.train(rows, fv.FEATURES, label, key, folds, boosting.Settings(**settings))
    return boosting.held_out(blocks, len(fv.FEATURES), folds)


def quality_by_folds(predicted: DataFrame) -> DataFrame:
    """Rows, MAPE, R2 and MAE of each fold, and their mean and deviation (of the folds as they are) over the folds."""
    y, p = F.col("y"), F.col("prediction")
    spread = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(F.lit(1))
    measures = {"mape": F.avg(F.abs(F.try_divide(p - y, y))), "r2": 1 - F.try_divide(F.sum((y - p) * (y - p)), spread), "mae": F.avg(F.abs(p - y))}
    each = predicted.groupBy("fold").agg(F.count(F.lit(1)).cast("double").alias("rows"), *[m.alias(n) for n, m in measures.items()])
    names = ["rows", *measures]
    every = each.agg(*[F.struct(F.avg(n).alias("mean"), F.stddev_pop(n).alias("deviation")).alias(n) for n in names])
    every = every.select(F.inline(F.array(*[F.struct(F.lit(kind).alias("fold"), *[F.col(f"{n}.{kind}").alias(n) for n in names]) for kind in ("mean", "deviation")])))
    return each.withColumn("fold", F.col("fold").cast("string")).unionByName(every)


def cross_validated(rows: DataFrame, label: str = "target", key: str = "skin_id", folds: int = 5, **settings) -> DataFrame:
    """Quality by fold, with mean and deviation."""
    return quality_by_folds(kept(predicted_by_folds(rows, label, key, folds, **settings), "held-out"))


def search(rows: DataFrame, grid: dict[str, list], label: str = "target", key: str = "skin_id", folds: int = 3, **settings) -> tuple[dict, boosting.Model, list[tuple[dict, float]]]:
    """(best settings, the model trained with them, each setting's mean absolute error over the folds), by cross-validation over a grid."""
    tried = []
    for values in product(*grid.values()):
        own = settings | dict(zip(grid, values, strict=True))
        per = predicted_by_folds(rows, label, key, folds, **own).groupBy("fold").agg(F.avg(F.abs(F.col("prediction") - F.col("y"))).alias("mae"))
        tried.append((own, per.agg(F.avg("mae")).first()[0]))
    best = min(tried, key=lambda t: t[1])[0]
    return best, fit(rows, label, key, **best), tried


def importance(model: boosting.Model, spark) -> DataFrame:
    """(feature, dimension, importance), one row per feature."""
    group = {f: g for g, names in fv.GROUPS.items() for f in names}
    return spark.createDataFrame([(f, group[f], v) for f, v in model.importance().items()], "feature string, dimension string, importance double")


def dimension_weights(importances: DataFrame) -> DataFrame:
    """Dimension weights as renormalised sums of importances."""
    everything = importances.agg(F.sum("importance").alias("_all"))
    per = importances.groupBy("dimension").agg(F.sum("importance").alias("_s"))
    return per.join(F.broadcast(everything)).select("dimension", F.coalesce(F.try_divide("_s", "_all"), F.lit(0.0)).alias("weight"))


def blended(scored: DataFrame, model: boosting.Model | None, labels: int) -> DataFrame:
    """total_premium from rules and model; with fewer than COLD_START labels, or no model, from rules alone."""
    rule = F.col("total_premium")
    if model is None or labels < COLD_START:
        return scored.withColumns({"rule_based": rule, "ml_based": F.lit(None).cast("double"), "alpha": F.lit(1.0)})
    rows = scored.withColumn("prediction", model.prediction())
    alpha = scoring.alpha_of(F.lit(labels))
    return rows.withColumns({"rule_based": rule, "ml_based": F.col("prediction") * 100, "alpha": alpha, "total_premium": scoring.blend(rule, F.col("prediction"), F.lit(labels))})


def spearman(rows: DataFrame, pairs: list[tuple[str, str]], group: str) -> DataFrame:
    """Rank agreement of column pairs within each group: the correlation of average ranks."""
    ranks = rows.select(group, *sorted({c for p in pairs for c in p}))
    for c in sorted({c for p in pairs for c in p}):
        ranks = facts.ranked(ranks, group, c).withColumn(f"_rank_{c}", F.col("before") + (F.col("ties") + 1) / 2).drop("before", "ties", "of")
    return ranks.groupBy(group).agg(*[F.round(F.corr(f"_rank_{a}", f"_rank_{b}"), 6).alias(f"{a}_{b}") for a, b in pairs])
