"""The inverted-file search and peers against brute force; how little they look at."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veloria.operators import facts, index, similar

SCHEMA = "skin_id long, genre string, official_tier int, vector array<double>"


def clustered(n, dims=8, centres=40, spread=0.02, seed=1):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, dims))
    return [(i, f"g{i % 2}", int(rng.integers(0, 5)), (at[i % centres] + spread * rng.normal(size=dims)).tolist()) for i in range(n)]


def brute(rows, k, banded, width=1):
    rows = [r for r in rows if r[0] is not None and r[3] and all(x is not None and np.isfinite(x) for x in r[3]) and any(r[3])]
    out = []
    for i, a in enumerate(rows):
        found = []
        for b in rows:
            if a[0] != b[0] and len(a[3]) == len(b[3]) and (not banded or a[1] is not None and a[1] == b[1] and abs(a[2] - b[2]) <= width):
                x, y = np.array(a[3]) / np.linalg.norm(a[3]), np.array(b[3]) / np.linalg.norm(b[3])
                found.append((-round(float(x @ y), 6), b[0]))
        out += [(a[0], place, s, -d) for place, (d, s) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [16, 1024])
def test_search_equals_brute_force(spark, size):
    odd = [(900, "g0", 1, None), (901, "g0", 1, []), (902, "g0", 1, [0.0] * 8), (903, "g0", 1, [None] * 8), (904, "g0", 1, [float("nan")] * 8), (905, "g0", 1, [1.0, 2.0]), (906, "g0", 1, [1.0, 2.5]), (None, "g0", 1, [1.0] * 8)]
    same = [(1000 + i, "g1", 2, [0.5] * 8) for i in range(60)]
    rows = clustered(240) + odd + same
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for banded in (True, False):
        bands = {"genre": "genre", "tier": "official_tier", "width": 1} if banded else {}
        got = similar.top(index.search(table, 5, size=size, pivots=7, **bands), ["target_id"], [F.desc("similarity"), F.col("skin_id")], 5).collect()
        assert sorted((r.target_id, r.place, r.skin_id) for r in got) == [r[:3] for r in brute(rows, 5, banded)]
    assert index.search(table.limit(0)).count() == 0


def test_search_skips_what_is_far(spark):
    """Of all pairs of a band few are looked at, and nothing is lost."""
    table = spark.createDataFrame(clustered(4000), SCHEMA)
    rows = index.kept(index._rows(table, None, None), "rows")
    pivots = index.pivots_of(rows)
    blocks = index.blocks_of(rows, pivots, 64)
    sizes = {r.no: len(r.ids) // 8 for r in blocks.select("no", "ids").collect()}
    looked = sum(len(r.q_ids) // 8 * sizes[r.no] for r in index.asked(blocks, pivots, 5).select("no", "q_ids").collect())
    assert sum(sizes.values()) == 4000 and looked < 0.1 * 4000**2
    plan = similar.nearest(table)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_few_probes_find_most(spark):
    table = spark.createDataFrame(clustered(1500, dims=16, centres=60, spread=0.25), SCHEMA)
    exact = {(r.target_id, r.skin_id) for r in similar.nearest(table, 5).collect()}
    some = {(r.target_id, r.skin_id) for r in similar.nearest(table, 5, probes=4).collect()}
    assert len(exact) == 7500 and len(exact & some) >= 0.9 * len(exact)


def test_peers_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    pick = lambda n: None if rng.random() < 0.05 else f"x{rng.integers(0, n)}"
    rows = [(i, None if rng.random() < 0.03 else f"g{i % 2}", pick(9), pick(4), None if rng.random() < 0.05 else int(rng.integers(0, 3)), None if rng.random() < 0.03 else float(rng.integers(0, 12)) / 4) for i in range(260)]
    table = spark.createDataFrame(rows, "skin_id long, genre string, hero_name string, series string, official_tier int, official_price double")
    want = []
    for a in rows:
        found = []
        for b in rows:
            ways = sum(x is not None and x == y for x, y in zip(a[2:5], b[2:5]))
            if a[0] != b[0] and a[1] is not None and a[1] == b[1] and None not in (a[5], b[5]) and ways:
                found.append((-ways, round(abs(a[5] - b[5]), 4), b[0]))
        want += [(a[0], place, s, -w, g) for place, (w, g, s) in enumerate(sorted(found)[:5], 1)]
    got = similar.peers(table, 5)
    assert sorted((r.target_id, r.place, r.skin_id, r.ways, r.gap) for r in got.collect()) == sorted(want)


def test_ranks_by_counts(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("a", 5), ("b", 2), (None, 2), (None, 1)], "g string, v int")
    got = sorted(map(str, map(tuple, facts.ranked(rows, "g", "v").select("g", "v", "before", "ties", "of").collect())))
    assert got == sorted(map(str, [("a", 1, 1, 2, 4), ("a", 1, 1, 2, 4), ("a", None, 0, 1, 4), ("a", 5, 3, 1, 4), ("b", 2, 0, 1, 1), (None, 1, 0, 1, 2), (None, 2, 1, 1, 2)]))


def test_blocks_are_sent_once_for_each_group(spark):
    """Vectors without clusters, of which each block meets each: a block is not sent once for each that it meets."""
    rng = np.random.default_rng(6)
    table = spark.createDataFrame([(i, "g", 0, rng.normal(size=8).tolist()) for i in range(3000)], SCHEMA)
    rows = index.kept(index._rows(table, None, None), "rows")
    pivots = index.pivots_of(rows)
    blocks = index.blocks_of(rows, pivots, 16)
    sent = index._meetings(blocks, pivots, 5, 0).groupBy("no").count().agg(F.max("count")).first()[0]
    assert blocks.count() > 150 and sent <= 2 * index.GROUPS
    assert index.search(table, 5, size=16).count() <= 5 * 3000 * index.GROUPS
