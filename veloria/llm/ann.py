"""Nearest neighbours by a block matrix join with int8 tiles and exact error bounds.

Vectors are scaled to length 1 and quantised to int8 with a step of their own. The product of two int8 tiles gives all
cosines of a block of queries with a block of candidates to within a bound known for each pair. Pairs whose upper bound
falls below a query's k-th best lower bound cannot be among its nearest; the others are computed in double precision from
the original vectors. Heaps merge what is left. So the result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise

NEAREST = 5
QUERY_STEP = 50
TILE_ROWS = 4096
QUERY_ROWS = 2048
#: Candidate tiles that meet a block of queries in one task, where queries are dealt out.
GROUP_TILES = 64
#: Room for rounding in the double sums around the int8 products, which are exact.
SLACK = 1e-9
#: So many products of two int8 codes add up exactly in float32.
EXACT_DIMS = 1024
#: Query tiles of up to this size in all go to every executor; larger ones are dealt out by block and group.
SENT_BYTES = 64 << 20


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, steps, lengths of what the codes miss) of the vectors scaled to length 1."""
    unit = vectors.astype(np.float64)
    unit = unit / np.abs(unit).max(axis=1, keepdims=True)  # against overflow in the squares
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    steps = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / steps[:, None]).astype(np.int8)
    return codes, steps, np.sqrt(((unit - codes * steps[:, None]) ** 2).sum(axis=1))


def exact_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed in the order of the components.

    Rows are first scaled by powers of two, which changes no digit of the result and keeps squares from overflowing.
    """
    scaled = lambda x: np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    a, b = scaled(a.astype(np.float64)), scaled(b.astype(np.float64))
    dot = lambda x, y: np.cumsum(x * y, axis=1)[:, -1]
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


PARTS = ("ids", "codes", "steps", "missed")
TILE = "block long, dim int, " + ", ".join(f"{p} binary" for p in PARTS)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _tiles(rows_each: int):
    """Rows (block, rid, vector) to tiles of one block and dimension: row numbers, codes, steps and misses as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(key: tuple[int, int]) -> pa.RecordBatch:
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
            codes, steps, missed = quantise(vectors)
            parts = dict(zip(PARTS, (ids.astype("<i8"), codes, steps.astype("<f8"), missed.astype("<f8")), strict=True))
            return pa.record_batch({"block": pa.array([key[0]], pa.int64()), "dim": pa.array([key[1]], pa.int32())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in parts.items()})

        for batch in batches:
            for at in range(0, batch.num_rows, rows_each):
                part = batch.slice(at, rows_each)
                block, ids = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                lengths = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                for key in {*zip(block.tolist(), lengths.tolist(), strict=True)}:
                    pick = np.flatnonzero((lengths == key[1]) & (block == key[0]))
                    held.setdefault(key, []).append((ids[pick], _matrix(part.column(2).take(pa.array(pick)), key[1])))
                    if sum(len(x) for x, _ in held[key]) >= rows_each:
                        yield out(key)
                for key in [k for k in held if k[0] != block[-1]]:  # rows come sorted by block
                    yield out(key)
        for key in list(held):
            yield out(key)

    return run


def _usable(vectors: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is there, not zero and of finite components only."""
    values = F.col("_vec")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(values, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("_vec")).where(F.col("vec_id").isNotNull() & F.col("_vec").isNotNull() & (F.size("_vec") > 0)).where(fine)


class _Tile:
    def __init__(self, dim: int, ids: bytes, codes: bytes, steps: bytes, missed: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.codes = np.frombuffer(codes, np.int8).reshape(-1, dim).astype(np.float32)
        self.steps, self.missed = np.frombuffer(steps, "<f8"), np.frombuffer(missed, "<f8")


def tile_survivors(queries: _Tile, tile: _Tile, best: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query rows, candidate rows, lower and upper bounds) of the pairs that may be among a query's k nearest.

    ``best`` has the k best lower bounds that each query has met so far, and is brought up to date.
    """
    dim = queries.codes.shape[1]
    for at in range(0, len(queries.ids), 256):
        part = slice(at, at + 256)
        dots = np.zeros((len(queries.ids[part]), len(tile.ids)))
        for d in range(0, dim, EXACT_DIMS):
            dots += queries.codes[part, d : d + EXACT_DIMS] @ tile.codes[:, d : d + EXACT_DIMS].T
        about = dots * queries.steps[part, None] * tile.steps[None, :]
        # u.v - a.b = a.(v - b) + (u - a).v, with |v| = 1 and |a| <= 1 + |u - a|
        bound = (1 + queries.missed[part, None]) * tile.missed[None, :] + queries.missed[part, None] + SLACK
        low, high = about - bound, about + bound
        own = queries.ids[part, None] == tile.ids[None, :]
        low[own] = -np.inf
        high[own] = -np.inf
        seen = np.concatenate([best[part], low], axis=1)
        best[part] = -np.partition(-seen, k - 1, axis=1)[:, :k]
        q, c = np.nonzero((high >= best[part].min(axis=1)[:, None]) & ~own)
        if len(q):
            yield queries.ids[part][q], tile.ids[c], low[q, c], high[q, c]


def nearest(
    vectors: DataFrame, vec: str = "embedding", k: int = NEAREST, step: int = QUERY_STEP, tile_rows: int = TILE_ROWS, query_rows: int = QUERY_ROWS, group_tiles: int = GROUP_TILES, sent_bytes: int = SENT_BYTES
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine of every row whose vec_id is divisible by ``step``.

    Ties go to the smaller vec_id. A row is never its own neighbour, but rows that share its vec_id are candidates like any
    other; each row is a query and a candidate of its own, so repeated rows give repeated answers. Null, empty and zero
    vectors and those with null or non-finite components take no part, nor do rows without a vec_id; only vectors of one
    length are compared. Fewer candidates than k give fewer rows. Other columns are ignored; an empty table gives no rows.
    """
    usable = materialise(_usable(vectors, vec).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    asked = usable.where(F.col("vec_id") % step == 0)
    n_blocks = max(1, -(-asked.count() // query_rows))
    n_groups = max(1, -(-usable.count() // (tile_rows * group_tiles)))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(n_blocks))).repartition("block").sortWithinPartitions("block")
    query_tiles = materialise(dealt.select("block", "rid", "_vec").mapInArrow(_tiles(query_rows), TILE).select("block", "dim", *[F.col(p).alias(f"q_{p}") for p in PARTS]), "query-tiles")
    size = query_tiles.agg(F.sum(sum(F.length(f"q_{p}") for p in PARTS))).first()[0] or 0
    tiles = usable.select(F.lit(0).cast("long").alias("block"), "rid", "_vec").mapInArrow(_tiles(tile_rows), TILE).drop("block")
    if size <= sent_bytes:
        pairs = tiles.join(query_tiles.hint("broadcast"), "dim")
    else:
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        tiles = materialise(tiles.withColumn("group", F.pmod(F.monotonically_increasing_id(), F.lit(n_groups))), "tiles")
        pairs = tiles.withColumn("block", every(n_blocks)).join(query_tiles.withColumn("group", every(n_groups)).hint("merge"), ["block", "group", "dim"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                x = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
                queries, tile = _Tile(x["dim"], *(x[f"q_{p}"] for p in PARTS)), _Tile(x["dim"], *(x[p] for p in PARTS))
                own = best.setdefault(x["q_ids"], np.full((len(queries.ids), k), -np.inf))
                for q, c, low, high in tile_survivors(queries, tile, own, k):
                    yield pa.record_batch({"q": q, "c": c, "low": low, "high": high})

    found = materialise(pairs.mapInArrow(compare, "q long, c long, low double, high double"), "survivors")
    # what all tiles together say of a query's k-th best
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("low")))
    least = found.withColumn("n", place).where(F.col("n") <= k).groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.min("low")).otherwise(F.lit(float("-inf"))).alias("least"))
    pairs = found.join(materialise(least, "bounds").hint("merge"), "q").where("high >= least").select("q", "c")
    sides = {"q": usable.select(F.col("rid").alias("q"), F.col("vec_id").alias("query_id"), F.col("_vec").alias("a")), "c": usable.select(F.col("rid").alias("c"), "vec_id", F.col("_vec").alias("b"))}
    both = materialise(pairs, "pairs").join(sides["c"].hint("merge"), "c").join(sides["q"].hint("merge"), "q").select("q", "c", "query_id", "vec_id", "a", "b")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(4).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                yield pa.record_batch({n: part.column(i) for i, n in enumerate(("q", "c", "query_id", "vec_id"))} | {"score": exact_cosines(_matrix(part.column(4), dim), _matrix(part.column(5), dim))})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, name, heap = None, None, []

        def out() -> pa.RecordBatch:
            top = sorted(heap, reverse=True)
            return pa.record_batch({"query_id": pa.array([name] * len(top), pa.int64()), "rank": pa.array(range(1, len(top) + 1), pa.int32()), "vec_id": pa.array([-v for _, v, _ in top], pa.int64()), "score": pa.array([s for s, _, _ in top], pa.float64())})

        for batch in batches:
            for q, c, query, v, s in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if q != now:
                    if heap:
                        yield out()
                    now, name, heap = q, query, []
                item = (s, -v, -c)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        if heap:
            yield out()

    scored = both.mapInArrow(score, "q long, c long, query_id long, vec_id long, score double")
    return scored.repartition("q").sortWithinPartitions("q").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS rid FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT rid, vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.n * c.n) AS score,
         row_number() OVER (PARTITION BY q.rid ORDER BY list_dot_product(q.e, c.e) / (q.n * c.n) DESC, c.vec_id) AS rank
  FROM u q JOIN u c ON q.rid <> c.rid AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
WHERE rank <= 5
"""


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
