"""Connected components of a graph of long ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """One step over edges (u, v) with u > v: neighbours are tied to the least of a node and its neighbours. Also the table that it wrote for this.

    The least neighbour comes from an aggregate that combines on the map side. It is written before it is joined: both sides
    of the join then are plain shuffles, and the rows of a node with very many neighbours can be split among tasks.
    """
    if large:  # each node passes its larger neighbours on
        out = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionAll(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    else:  # each node passes its smaller neighbours on
        out = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
    least = materialise(out.groupBy("n").agg(F.min("m").alias("_m")).select("n", F.least("_m", "n").alias("low")), "least-neighbours")
    tied = out.join(least.hint("merge"), "n")
    if large:
        tied = tied.where("m > n").select(F.col("m").alias("u"), F.col("low").alias("v"))
    else:
        tied = tied.select(F.col("m").alias("u"), F.col("low").alias("v")).unionAll(least.select(F.col("n").alias("u"), F.col("low").alias("v")))
    return tied.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), least


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node of its component, itself included.

    Loops and repeated edges are harmless; no edges give no rows. Each round is written to the shared folder and read
    back, and the tables of the round before are deleted. It stops when a round changes nothing, which a checksum over the
    edges shows.
    """
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = mark(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        large, first = _star(now, True)
        small, second = _star(large, False)
        before, now = now, materialise(small, "stars")
        discard(before, first, second)
        fresh = mark(now)
        if fresh == seen:
            break
        seen = fresh
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
