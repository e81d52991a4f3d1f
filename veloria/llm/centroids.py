"""Clustering of vectors around centroids, in whole numbers and in Spark's own expressions.

Components are scaled to integers, so that distances, sums and centroids are exact and do not depend on the order of rows.
Each round is one scan: ``zip_with`` and ``aggregate`` give the distance to each literal centroid, the least struct of
(distance, number) names the cluster, and one grouping with a sum a component gives the next centroids. The driver holds
the centroids alone: clusters times components numbers.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

CLUSTERS = 16
ROUNDS = 3
DIMS = 64
SCALE = 64
#: Scaled components lie within this bound, so that the squared distance of DIMS of them fits in a long.
BOUND = 1 << 27
MOST = (1 << 63) - 1


def integers(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """vec_id, ``v``, the integers floor(scale * component), and ``vv``, the sum of their squares, of the vectors with ``dims`` finite components.

    Vectors that are null, of another length, or hold null, NaN or infinite components are left out. Integers beyond
    BOUND count as BOUND, with their sign. Repeated rows and null vec_ids stay; other columns are ignored.
    """
    whole = F.col(column).isNotNull() & (F.size(column) == dims) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = lambda x: F.floor(F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), x.cast("double") * F.lit(float(scale))))).cast("long")
    return vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(column, scaled).alias("v")).withColumn("vv", _sum(F.transform("v", lambda x: x * x)))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, seed: str = "1") -> list[list[int]]:
    """The ``clusters`` vectors with the smallest SHA-256 of ``<seed>:<vec_id>``, in its order; all, if there are fewer.

    Rows that share a vec_id go by their components; a null vec_id comes last.
    """
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in rows.select("v", order.alias("_order")).orderBy(F.asc_nulls_last("_order"), "v").limit(clusters).collect()]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


def squared_distance(v: Column, vv: Column, centroid: list[int]) -> Column:
    """Of an integer vector to a literal one: both sums of squares less twice the product, which takes half the steps of squared differences."""
    literal = F.expr(f"array({', '.join(f'{c}L' for c in centroid)})")
    return vv + F.lit(sum(c * c for c in centroid)).cast("long") - F.lit(2).cast("long") * _sum(F.zip_with(v, literal, lambda a, b: a * b))


def nearest_centroid(v: Column, vv: Column, centroids: list[list[int]]) -> Column:
    """A struct of distance and cluster: the nearest centroid, the smaller number on ties."""
    return F.array_min(F.array(*[F.struct(squared_distance(v, vv, c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids)]))


def next_centroids(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each non-empty cluster's componentwise floor(sum / count); an empty one stays where it is."""
    dims = len(centroids[0])
    assigned = rows.select(nearest_centroid(F.col("v"), F.col("vv"), centroids)["cluster"].alias("cluster"), *[F.col("v")[i].alias(f"c{i}") for i in range(dims)])
    sums = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(dims)])
    moved = {r.cluster: [r[f"c{i}"] // r.n for i in range(dims)] for r in sums.collect()}
    return [moved.get(k, c) for k, c in enumerate(centroids)]


def fit(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "1") -> list[list[int]]:
    """Centroids after ``rounds`` rounds over ``rows`` of ``integers``."""
    centroids = first_centroids(rows, clusters, seed)
    return reduce(lambda now, _: next_centroids(rows, now), range(rounds), centroids) if centroids else []


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = "1", column: str = "embedding") -> DataFrame:
    """Each kept vector's cluster, distance, the inertia of its cluster and of all, and its centroid's SHA-256.

    What is kept is told in ``integers``. Repeated rows are vectors of their own. With fewer vectors than ``clusters``
    there are as many centroids as vectors; an empty table gives no row. Inertia beyond a long counts as its largest value.
    """
    spark = vectors.sparkSession
    rows = materialise(integers(vectors, dims, scale, column), "centroid-vectors")
    centroids = fit(rows, clusters, rounds, seed)
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(n) for n in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).where("false")
    assigned = materialise(rows.select("vec_id", nearest_centroid(F.col("v"), F.col("vv"), centroids).alias("_near")).select("vec_id", "_near.cluster", "_near.distance"), "centroid-assigned")
    total = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    everything = min(MOST, sum(total.values()))
    report = [(k, min(MOST, total.get(k, 0)), everything, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    report = spark.createDataFrame(report, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row a centroid
    return assigned.join(F.broadcast(report), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> str:
    """The same rows in SQL: a step for each round."""
    parts = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS c FROM (SELECT v, sha256('1:' || vec_id) AS h FROM v ORDER BY h, v LIMIT {clusters}))",
    ]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS (SELECT r, vec_id, v, cluster, distance FROM (
  SELECT r, vec_id, v, cluster, CAST(list_sum(list_transform(range(1, {dims + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS distance FROM v, c{k})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)""")
        if k < rounds:
            parts.append(f"""m{k} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
  SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(range(1, {dims + 1})) AS i, unnest(v) AS x FROM a{k}) GROUP BY cluster, i) GROUP BY cluster)""")
            parts.append(f"c{k + 1} AS (SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN m{k} m ON m.cluster = c.cluster)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""


SQL = _sql()
