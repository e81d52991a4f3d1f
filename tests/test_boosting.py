"""Boosted trees against a plain recursive tree, penalties, shared folds, grid search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veloria.operators import boosting, features, learning

NAMES = ("a", "b", "c")


def made(spark, n=400):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) * (1 + (x[:, 1] > 0)) + 0.3 * x[:, 2] + rng.normal(scale=0.1, size=n)
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "skin_id long, a double, b double, c double, target double").repartition(3), x, y


def plain_tree(bins, g, s, depth):
    """Predictions of one penalised tree, grown by recursion over every feature and bin."""
    out = np.empty(len(g))
    shrink = lambda t: np.sign(t) * max(abs(t) - s.l1, 0.0)
    score = lambda t, n: shrink(t) ** 2 / (n + s.l2)

    def grow(rows, left):
        total, n = g[rows].sum(), len(rows)
        best = (1e-12, None)
        if left:
            for f in range(bins.shape[1]):
                for cut in range(s.bins):
                    low = rows[bins[rows, f] <= cut]
                    if s.least_weight <= len(low) <= n - s.least_weight:
                        a = g[low].sum()
                        gain = score(a, len(low)) + score(total - a, n - len(low)) - score(total, n)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, cut))
        if best[1] is None:
            out[rows] = -shrink(total) / (n + s.l2)
        else:
            f, cut = best[1]
            low = bins[rows, f] <= cut
            grow(rows[low], left - 1)
            grow(rows[~low], left - 1)

    grow(np.arange(len(g)), depth)
    return out


@pytest.mark.parametrize("l1, l2", [(0.0, 0.0), (0.1, 1.0), (40.0, 1.0), (5.0, 30.0), (1e9, 1.0)])
def test_penalised_trees_equal_plain_ones(spark, l1, l2):
    rows, x, y = made(spark)
    s = boosting.Settings(rounds=2, depth=3, step=0.5, row_share=1.0, feature_share=1.0, l1=l1, l2=l2, bins=8, least_weight=2)
    (model,), _ = boosting.train(rows, NAMES, settings=s)
    bins = boosting.binned(x, model.bounds)
    margin = np.full(len(y), y.mean())
    for _ in range(2):
        margin += s.step * plain_tree(bins, margin - y, s, s.depth)
    assert np.allclose(model.predict(x), margin, atol=1e-9)
    got = {r.skin_id: r.p for r in rows.select("skin_id", model.prediction().alias("p")).collect()}
    assert np.allclose([got[i] for i in range(len(y))], margin, atol=1e-9)
    if l1 == 1e9:
        assert np.allclose(margin, y.mean()) and set(model.importance().values()) == {0.0}


def test_folds_grow_together_as_they_would_alone(spark):
    rows, x, y = made(spark)
    s = boosting.Settings(rounds=25, depth=3, step=0.2, bins=16)
    models, blocks = boosting.train(rows, NAMES, folds=3, settings=s)
    out = {r.key: r for r in boosting.held_out(blocks, 3, 3).collect()}
    assert sorted(out) == list(range(len(y))) and {r.fold for r in out.values()} == {0, 1, 2}
    for i, r in out.items():
        assert r.y == y[i] and abs(models[r.fold].predict(x[i : i + 1])[0] - r.prediction) < 1e-9
    # a fold's model does not change with the labels of its own fold
    fold = {i: r.fold for i, r in out.items()}
    other = rows.withColumn("target", F.when(F.col("skin_id").isin([i for i in fold if fold[i] == 1]), F.lit(99.0)).otherwise(F.col("target")))
    again, _ = boosting.train(other, NAMES, folds=3, settings=s)
    assert np.allclose(again[1].predict(x), models[1].predict(x)) and not np.allclose(again[0].predict(x), models[0].predict(x))


def test_quality_rows(spark):
    rows = spark.createDataFrame([(0, 1.0, 1.5), (0, 2.0, 2.0), (0, 0.0, 1.0), (1, 4.0, 3.0), (1, 2.0, 3.0)], "fold int, y double, prediction double")
    got = {r.fold: r for r in learning.quality_by_folds(rows).collect()}
    assert got["0"].rows == 3 and got["0"].mape == 0.25 and got["0"].mae == 0.5 and got["0"].r2 == pytest.approx(1 - 1.25 / 2)
    assert got["1"].mae == 1 and got["1"].r2 == 0 and got["mean"].mae == 0.75 and got["deviation"].mae == 0.25 and got["mean"].rows == 2.5


def test_search_takes_the_better_setting(spark):
    rows = spark.range(200).select(F.col("id").alias("skin_id"), *[((F.col("id") * (i + 3)) % 17).cast("double").alias(f) for i, f in enumerate(features.FEATURES)]).withColumn("target", F.col("vlm_art_quality") / 20 + 0.1)
    best, model, tried = learning.search(rows, {"rounds": [1, 12], "depth": [2]}, folds=2, step=0.4)
    assert best["rounds"] == 12 and len(tried) == 2 and len(model.trees) == 12 and model.depth == 2


def test_empty_and_odd_rows(spark):
    s = boosting.Settings(rounds=2, depth=2)
    (model,), blocks = boosting.train(spark.createDataFrame([], "skin_id long, a double, b double, c double, target double"), NAMES, settings=s)
    assert blocks.count() == 0 and model.predict(np.zeros((1, 3)))[0] == 0.0
    rows = spark.createDataFrame([(1, None, 1.0, 1.0, 3.0), (1, None, 1.0, 1.0, 3.0), (2, 1.0, None, None, None), (None, 5.0, 1.0, 1.0, 5.0)], "skin_id long, a double, b double, c double, target double")
    (model,), _ = boosting.train(rows, NAMES, settings=s)
    assert model.base == pytest.approx(11 / 3)


def test_tasks_do_not_follow_the_rows(spark):
    """As many tasks as cores, not one for each few thousand rows; histograms of shared codes are those of the features."""
    rows = spark.range(0, 30_000, 1, 9).select(F.col("id").alias("skin_id"), *[(F.col("id") * i % 97).cast("double").alias(n) for i, n in enumerate(NAMES, 1)], (F.col("id") % 7).cast("double").alias("target"))
    _, blocks = boosting.train(rows, NAMES, settings=boosting.Settings(rounds=1, depth=1))
    assert len(blocks.inputFiles()) <= spark.sparkContext.defaultParallelism and sum(r.n for r in blocks.select("n").collect()) == 30_000
    layout = boosting.Layout.of((tuple(range(31)), (), tuple(range(31)), (1.0,), tuple(range(4)), tuple(range(31))))
    assert max(layout.sizes) <= boosting.CODES and len(layout.sizes) < 6
    rng = np.random.default_rng(1)
    bins, g = np.stack([rng.integers(0, n, 500) for n in layout.bins], axis=1).astype(np.uint8), rng.normal(size=500)
    codes = layout.codes(bins)
    got = layout.by_bin([np.bincount(codes[c], g, size) for c, size in enumerate(layout.sizes)], [0, 2, 3, 5], 32)
    assert np.allclose(got, [np.bincount(bins[:, f], g, 32) for f in (0, 2, 3, 5)])
    assert all((layout.right(f, 1)[codes[layout.code[f]]] == (bins[:, f] > 1)).all() for f in range(6))


def test_learning_rows_take_one_feature_view(spark, monkeypatch):
    from veloria.plans import score_queries

    built, view = [], score_queries.feature_view
    monkeypatch.setattr(score_queries, "feature_view", lambda *a: built.append(a) or view(*a))
    rows = score_queries._learning_rows(spark, "/root/testdata/sf0.001")
    assert len(built) == 1 and rows.where("target is null").count() == 0 < rows.count()
