"""Exact nearest neighbours by an inverted file: cells around pivots, and the triangle inequality.

Vectors are scaled to length 1, so that cosine and distance say the same. Pivots are fitted on a bounded sample; each vector
belongs to the cell of its nearest pivot. Cells are cut into blocks of vectors of like distance to the pivot. An item's
nearest in its own block bound how far its others can be; a block whose distances to its pivot lie beyond that bound of the
item's own distance holds none of them and is skipped whole. Items go to the blocks that they need, not each to each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import kept

BLOCK_ROWS = 1024
#: Vectors that the pivots are fitted on, and pivots, at most.
SAMPLE = 4096
MOST_PIVOTS = 512
#: Blocks are compared in a grid of groups: bytes of vectors in a group, and groups, at least.
GROUP_BYTES = 64 << 20
GROUPS = 8
#: Similarities are rounded to so many decimals; the bound leaves room for it.
DECIMALS = 6
SLACK = 2e-6
FARTHEST = 2.1


def fit_pivots(unit: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Centres of ``unit`` by a few rounds of averaging, from rows spread over it."""
    pivots = unit[np.linspace(0, len(unit) - 1, min(count, len(unit))).astype(int)]
    for _ in range(rounds):
        near = (unit @ pivots.T - 0.5 * (pivots * pivots).sum(axis=1)).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, unit)
        n = np.bincount(near, minlength=len(pivots))[:, None]
        pivots = np.where(n > 0, sums / np.maximum(n, 1), pivots)
    return pivots


def distances(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of every vector to every pivot; without pivots all vectors lie in one cell around themselves."""
    if not len(pivots):
        return np.zeros((len(unit), 1))
    square = (unit * unit).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (unit @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


def _scaled(lists: list[list[float]]) -> np.ndarray:
    unit = np.array(lists, "<f8")
    unit /= np.abs(unit).max(axis=1, keepdims=True)
    return unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))


def _rows(items: DataFrame, genre: str | None, tier: str | None) -> DataFrame:
    """(id, g, t, dim, v): the vectors that take part; only those of one genre and one length are compared."""
    v = F.col("vector").cast("array<double>")
    rows = items.select(F.col("skin_id").cast("long").alias("id"), (F.col(genre).cast("string") if genre else F.lit("")).alias("g"), (F.col(tier).cast("int") if tier else F.lit(0)).alias("t"), F.size(v).alias("dim"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & F.col("g").isNotNull() & F.col("t").isNotNull() & fine)


def pivots_of(rows: DataFrame, pivots: int | None = None) -> dict[int, np.ndarray]:
    """Pivots by length of vector, from the SAMPLE rows of least hash; by default half the root of the number of rows."""
    count = pivots or max(1, min(MOST_PIVOTS, int(rows.count() ** 0.5 / 2)))
    sample = rows.select("id", "dim", "v").orderBy(F.xxhash64("id", F.lit(5)), "id").limit(SAMPLE).toArrow()
    dims = np.asarray(sample["dim"])
    return {int(d): fit_pivots(_scaled(sample.filter(pa.array(dims == d))["v"].to_pylist()), count) for d in np.unique(dims)}


BLOCK = "g string, t int, dim int, cell int, low double, high double, ids binary, units binary"


def blocks_of(rows: DataFrame, pivots: dict[int, np.ndarray], size: int = BLOCK_ROWS) -> DataFrame:
    """The vectors in blocks of up to ``size`` of one genre, tier, length and cell, in order of their distance to the pivot."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(3))
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                unit = _scaled(part.column(4).to_pylist())
                far = distances(unit, pivots.get(int(d), np.zeros((0, d))))
                cell = far.argmin(axis=1)
                yield pa.record_batch([*part.columns[:4], pa.array(cell, pa.int32()), pa.array(far[np.arange(len(unit)), cell]), pa.array([u.tobytes() for u in unit], pa.binary())], names=["id", "g", "t", "dim", "cell", "far", "unit"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            g, t, dim, cell = held[0][1:5]
            far = [h[5] for h in held]
            return pa.record_batch([pa.array([x], k) for x, k in ((g, pa.string()), (t, pa.int32()), (dim, pa.int32()), (cell, pa.int32()), (min(far), pa.float64()), (max(far), pa.float64()), (np.array([h[0] for h in held], "<i8").tobytes(), pa.binary()), (b"".join(h[6] for h in held), pa.binary()))], names=[f.split()[0] for f in BLOCK.split(", ")])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[1:5] != held[0][1:5] or len(held) >= size):
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    placed = rows.mapInArrow(place, "id long, g string, t int, dim int, cell int, far double, unit binary")
    order = ["g", "t", "dim", "cell", "far", "id"]
    dealt = placed.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return kept(dealt.mapInArrow(pack, BLOCK).withColumn("no", F.monotonically_increasing_id()), "index-blocks")


def _arrays(ids: bytes, units: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(units, "<f8").reshape(-1, dim)


def _similarity(a_ids: np.ndarray, a: np.ndarray, b_ids: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rounded cosines; an item is none of its own neighbours."""
    score = np.round(np.clip(a @ b.T, -1.0, 1.0), DECIMALS)
    score[a_ids[:, None] == b_ids[None, :]] = -np.inf
    return score


def _bounds(ids: np.ndarray, unit: np.ndarray, k: int) -> np.ndarray:
    """How far each item's k nearest can be, by those of its own block."""
    if len(ids) <= k:
        return np.full(len(ids), FARTHEST)
    least = -np.partition(-_similarity(ids, unit, ids, unit), k - 1, axis=1)[:, k - 1]
    return np.where(np.isfinite(least), np.sqrt(np.maximum(2 - 2 * np.where(np.isfinite(least), least, 0.0) + SLACK, 0.0)), FARTHEST)


class _Tile:
    """A block's items as queries: how far their nearest can be, and the nearest found so far in a task."""

    def __init__(self, ids: bytes, units: bytes, dim: int, pivots: np.ndarray, k: int, probes: int | None):
        self.dim, self.pivots, self.k = dim, pivots, k
        self.ids, self.unit = _arrays(ids, units, dim)
        self.bound = _bounds(self.ids, self.unit, k)
        self.scores, self.found = np.full((len(self.ids), k), -np.inf), np.zeros((len(self.ids), k), np.int64)
        self.reach = None
        if probes is not None and probes < len(pivots):
            self.reach = np.partition(distances(self.unit, pivots), probes - 1, axis=1)[:, probes - 1]

    def need(self, cell: int, low: float, high: float) -> np.ndarray:
        """The items that may have one of their nearest in a block of ``cell`` between these distances to its pivot."""
        own = distances(self.unit, self.pivots[cell : cell + 1])[:, 0]
        need = (own - self.bound <= high + 1e-9) & (own + self.bound >= low - 1e-9)
        return np.flatnonzero(need if self.reach is None else need & (own <= self.reach + 1e-9))

    def meet(self, need: np.ndarray, ids: np.ndarray, unit: np.ndarray) -> None:
        """Take what is nearest in a block into the nearest so far; what is found bounds the rest."""
        score = _similarity(self.ids[need], self.unit[need], ids, unit)
        n = min(self.k, len(ids))
        least = np.maximum(-np.partition(-score, n - 1, axis=1)[:, n - 1], np.maximum(self.scores[need, -1], 1 - self.bound[need] ** 2 / 2))
        i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        if not len(i):
            return
        fresh = need[np.unique(i)]
        item = np.concatenate([need[i], np.repeat(fresh, self.k)])
        value, other = np.concatenate([score[i, j], self.scores[fresh].ravel()]), np.concatenate([ids[j], self.found[fresh].ravel()])
        order = np.lexsort((other, -value, item))
        item, value, other = item[order], value[order], other[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        best = place < self.k
        self.scores[item[best], place[best]], self.found[item[best], place[best]] = value[best], other[best]
        last = self.scores[fresh, -1]
        near = np.sqrt(np.maximum(2 - 2 * np.where(np.isfinite(last), last, -np.inf) + SLACK, 0.0))
        self.bound[fresh] = np.minimum(self.bound[fresh], near)


def _meetings(blocks: DataFrame, pivots: dict[int, np.ndarray], k: int, width: int) -> DataFrame:
    """The cells (a, b) of a grid: first the blocks of group a as queries (no ``tiles``), then those of group b with the tiles that may need them.

    Blocks are dealt to groups of about GROUP_BYTES, GROUPS at least, so a block is sent at most twice for each group and not for each
    block that it meets.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, t, dim, no, ids, units in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, unit = _arrays(ids, units, dim)
                bound, far = _bounds(ids, unit, k), distances(unit, pivots.get(dim, np.zeros((0, dim))))
                low, high = (far - bound[:, None]).min(axis=0), (far + bound[:, None]).max(axis=0)
                n = len(low)
                for near in range(t - width, t + width + 1):
                    yield pa.record_batch([pa.array([no] * n, pa.int64()), pa.array([g] * n, pa.string()), pa.array([near] * n, pa.int32()), pa.array([dim] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(low), pa.array(high)], names=["tile", "g", "t", "dim", "cell", "least", "most"])

    wanted = blocks.select("g", "t", "dim", "no", "ids", "units").mapInArrow(ranges, "tile long, g string, t int, dim int, cell int, least double, most double")
    shells = blocks.select("g", "t", "dim", "cell", "low", "high", "no")
    near = (F.col("low") <= F.col("most") + 1e-9) & (F.col("high") >= F.col("least") - 1e-9)
    groups = max(GROUPS, -(-(blocks.agg(F.sum(F.octet_length("units").cast("long"))).first()[0] or 0) // GROUP_BYTES))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int")
    pairs = wanted.join(shells.hint("merge"), ["g", "t", "dim", "cell"]).where(near)
    pairs = kept(pairs.groupBy("no", group("tile").alias("a")).agg(F.collect_list("tile").alias("tiles")), "index-pairs").withColumn("b", group("no"))
    body = blocks.select("no", "dim", "cell", "low", "high", "ids", "units").hint("merge")
    queries = pairs.select("a", "b", F.explode("tiles").alias("no")).distinct().withColumn("tiles", F.lit(None).cast("array<long>"))
    met = queries.select("a", "b", "tiles", "no").join(body, "no").unionByName(pairs.select("a", "b", "tiles", "no").join(body, "no"))
    dealt = met.repartition(3 * groups * groups, "a", "b").sortWithinPartitions("a", "b", F.col("tiles").isNotNull(), "no")
    return dealt.select("a", "b", "no", "tiles", "dim", "cell", "low", "high", "ids", "units")


def _met(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], k: int, probes: int | None) -> Iterator[tuple]:
    """(tile, items, no, ids, vectors) of each tile and block of a cell with items that need it; after each cell its tiles, the rest None."""
    at, tiles_of = None, {}
    for batch in batches:
        for i in range(batch.num_rows):
            a, b, no, tiles, dim, cell, low, high, ids, units = (c[i].as_py() for c in batch.columns)
            if (a, b) != at:
                yield list(tiles_of.values()), None, None, None, None
                at, tiles_of = (a, b), {}
            if tiles is None:
                tiles_of[no] = _Tile(ids, units, dim, pivots.get(dim, np.zeros((0, dim))), k, probes)
                continue
            b_ids, unit = _arrays(ids, units, dim)
            for tile in (tiles_of[t] for t in tiles):
                need = tile.need(cell, low, high)
                if len(need):
                    yield tile, need, no, b_ids, unit
    yield list(tiles_of.values()), None, None, None, None


def asked(blocks: DataFrame, pivots: dict[int, np.ndarray], k: int, width: int = 0, probes: int | None = None) -> DataFrame:
    """(no, dim, bounds, q_ids, q_units): for each block the items that may have one of their k nearest in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, need, no, _, _ in _met(batches, pivots, k, probes):
            if need is not None:
                yield pa.record_batch([pa.array([no], pa.int64()), pa.array([tile.dim], pa.int32()), *(pa.array([x[need].tobytes()], pa.binary()) for x in (tile.bound, tile.ids, tile.unit))], names=["no", "dim", "bounds", "q_ids", "q_units"])

    return _meetings(blocks, pivots, k, width).mapInArrow(run, "no long, dim int, bounds binary, q_ids binary, q_units binary")


def search(items: DataFrame, k: int = 5, genre: str | None = None, tier: str | None = None, width: int = 0, probes: int | None = None, pivots: int | None = None, size: int = BLOCK_ROWS) -> DataFrame:
    """(target_id, skin_id, similarity): of every item its k nearest, and some more, by cosine of ``vector`` to 6 decimals.

    Only items of one ``genre`` with tiers at most ``width`` apart are compared, if these are given. Exact, unless ``probes`` bounds
    the cells that an item is compared with, its nearest ones. Null ids, genres and tiers, and null, empty, zero and
    non-finite vectors take no part; repeated rows count each, but an id is not its own neighbour.
    """
    rows = kept(_rows(items, genre, tier), "index-rows")
    centres = pivots_of(rows, pivots)
    blocks = blocks_of(rows, centres, size)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, need, _, ids, unit in _met(batches, centres, k, probes):
            if need is not None:
                tile.meet(need, ids, unit)
                continue
            for done in tile:
                i, j = np.nonzero(done.scores > -np.inf)
                yield pa.record_batch({"target_id": done.ids[i], "skin_id": done.found[i, j], "similarity": done.scores[i, j]})

    return _meetings(blocks, centres, k, width).mapInArrow(compare, "target_id long, skin_id long, similarity double")
