"""SimHash near-duplicates, found by anchor points of a covering code.

A fingerprint has two halves of 32 bits. Two fingerprints that differ in at most 3 bits differ in at most 1 bit in one of
the halves. The anchors of a half are the words of the perfect [31, 26] Hamming code with a free bit beside it: a
covering code of radius 1 on 32 bits. A fingerprint's home anchor is within radius 1 of it, and any fingerprint within 1
bit of it lies within radius + threshold = 2 of that anchor. So each fingerprint goes to all anchors within 2, 17 at
most of the 2^27, and an anchor's homes are compared with all that came to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise
from .components import connected_components
from .tokens import small_batches

SHINGLE = 3
BITS = 3
HASH_SEED = 42
BLOCK_HOMES = 1024
BLOCK_VISITORS = 16_384

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text: ASCII letters lower-cased, word shingles with repeats, XXH64 with seed 42."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[a:b], HASH_SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


#: A wide fingerprint has so many words of 64 bits; a band takes some of the bits of one word.
WORDS = 4
#: Standard deviations of differing bits beyond the mean that still make two wide fingerprints near: a chance below 1e-6.
DEVIATIONS = 5.2
_RNG = np.random.default_rng(HASH_SEED)
_MIX = _RNG.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.stack([_RNG.permutation(64) for _ in range(64)]).astype(np.uint64)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of ``WORDS`` x 64 bits of a sorted set of 64-bit hashes that is not empty; a tie goes by the least hash."""
    mixed = hashes[:, None] * _MIX
    mixed ^= mixed >> np.uint64(31)
    mixed *= _PRIME
    mixed ^= mixed >> np.uint64(29)
    bits = lambda rows: np.unpackbits(rows.view(np.uint8).reshape(-1, 8 * WORDS), axis=1, bitorder="little")
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(mixed), 255):
        ones += bits(mixed[at : at + 255]).sum(axis=0, dtype=np.uint8)
    over = (ones * 2 > len(mixed)) | ((ones * 2 == len(mixed)) & (bits(mixed[:1])[0] > 0))
    return np.packbits(over, bitorder="little").view("<u8")


def band_masks(width: int, count: int) -> np.ndarray:
    """The ``width`` bits of each of ``count`` bands; band i lies in word i modulo ``WORDS``."""
    return np.bitwise_or.reduce(np.uint64(1) << _PLACES[:count, :width], axis=1)


def band_keys(words: np.ndarray, width: int, count: int) -> np.ndarray:
    """A signed long for each row and band of wide fingerprints; its last 6 bits are the band, the 6 before it the width."""
    bands = np.arange(count)
    keys = (words[:, bands % WORDS] & band_masks(width, count)) * _PRIME
    keys ^= keys >> np.uint64(29)
    keys *= _MIX[0]
    keys ^= keys >> np.uint64(32)
    return (keys << np.uint64(12) | np.uint64(width << 6) | bands.astype(np.uint64)).view(np.int64)


def shared_before(differing: np.ndarray, key: int) -> np.ndarray:
    """Whether two wide fingerprints, of which the differing bits are given, share a band that stands before that of ``key``."""
    band, width = key & 63, key >> 6 & 63
    out = np.zeros(len(differing), bool)
    for i, mask in enumerate(band_masks(width, band + 1)[:band]):
        out |= differing[:, i % WORDS] & mask == 0
    return out


def most_differing(similarity: float, bits: int) -> int:
    """Bits that may differ at a Jaccard similarity of ``similarity``: a bit does by the angle between two sets."""
    share = np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi
    return int(np.ceil(bits * share + DEVIATIONS * np.sqrt(bits * share * (1 - share))))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long. Null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            fps = np.array([fingerprint(t or b"", shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """The Hamming syndrome of the lower 31 bits: the exclusive or of the (1-based) places of the one bits."""
    out = np.zeros(len(words), np.uint32)
    for bit in range(31):
        out ^= np.where(words >> np.uint32(bit) & np.uint32(1), np.uint32(bit + 1), np.uint32(0))
    return out


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor within 2 bits of each 32-bit word; a word's home is its first row.

    Flipping the place that the syndrome names gives the code word of the home. The other code words within 2 come from
    flipping a pair of places whose exclusive or is the syndrome; with the free bit flipped only the home's code word is
    near enough.
    """
    s = _syndromes(half)
    flip = lambda place: np.where(place > 0, np.uint32(1) << (np.maximum(place, 1) - np.uint32(1)), np.uint32(0)).astype(np.uint32)
    home = half ^ flip(s)
    rows, found = [np.arange(len(half))], [home]
    rows.append(np.arange(len(half)))
    found.append(home ^ np.uint32(1 << 31))
    for place in range(1, 32):
        other = s ^ np.uint32(place)
        pick = np.flatnonzero((s > 0) & (other > place))
        rows.append(pick)
        found.append(half[pick] ^ flip(np.full(len(pick), place, np.uint32)) ^ flip(other[pick]))
    return np.concatenate(rows), np.concatenate(found)


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            fps = batch.column(0).slice(at, 20_000).to_numpy(zero_copy_only=False).astype(np.int64)
            for side in (0, 1):
                half = (fps.view(np.uint64) >> np.uint64(32 * side) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                row, anchor = anchors(half)
                home = np.zeros(len(row), bool)
                home[: len(half)] = True
                yield pa.record_batch({"anchor": anchor.astype(np.int64) | (side << 32), "fp": fps[row], "home": home})


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= bits


def link_group(homes: np.ndarray, others: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join what is near among one anchor's fingerprints: a forest, not all pairs.

    Homes are compared with everything in blocks. ``low`` is each home's least tied home; another fingerprint is tied to
    one home only, and homes that it brings together are tied to each other.
    """
    low = np.arange(len(homes))
    links: list[tuple[int, int]] = []
    far = len(homes)
    for at in range(0, len(others), 4096):
        part = others[at : at + 4096]
        near = _near(homes, part, bits)
        near_any = near.any(axis=0)
        if not near_any.any():
            continue
        near, part = near[:, near_any], part[near_any]
        while True:
            least = np.where(near, low[:, None], far).min(axis=0)
            fresh = np.minimum(low, np.where(near, least[None, :], far).min(axis=1))
            fresh = np.minimum(fresh, fresh[fresh])
            if (fresh == low).all():
                break
            # what a label pointed to is tied to the new label, else earlier ties would be lost
            moved = fresh != low
            links += list(zip(homes[low[moved]].tolist(), homes[fresh[moved]].tolist(), strict=True))
            low = fresh
        links += list(zip(part.tolist(), homes[least].tolist(), strict=True))
    links += list(zip(homes.tolist(), homes[low].tolist(), strict=True))
    return list({(a, b) for a, b in links if a != b})


def _compare(bits: int):
    """Links from rows sorted by (anchor, block): runs with one home are compared all at once, others run by run."""

    def links_of(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(starts, len(fp)))
        homes = np.add.reduceat(home.astype(np.int64), starts)
        out = []
        single = (homes == 1) & (sizes > 1)
        if single.any():
            own = np.repeat(single, sizes)
            centre = np.repeat(fp[home & own], sizes[single])
            rest = fp[own]
            near = (np.bitwise_count(centre.view(np.uint64) ^ rest.view(np.uint64)) <= bits) & (centre != rest)
            out.append((centre[near], rest[near]))
        for i in np.flatnonzero(homes > 1).tolist():
            part = slice(starts[i], starts[i] + sizes[i])
            ends = link_group(np.unique(fp[part][home[part]]), np.unique(fp[part]), bits)
            if ends:
                pairs = np.array(ends, np.int64)
                out.append((pairs[:, 0], pairs[:, 1]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            key, fp, home = (np.concatenate(x) for x in zip(*held, strict=True))
            for u, v in links_of(key, fp, home):
                yield pa.record_batch({"u": u, "v": v})

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2)], axis=1)
            fp, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            if held and (held[-1][0][-1] != key[0]).any():
                yield from flush()
                held = []
            cut = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (key != key[-1]).any() else 0
            if cut:
                held.append((key[:cut], fp[:cut], home[:cut]))
                yield from flush()
                held = []
            held.append((key[cut:], fp[cut:], home[cut:]))
        if held:
            yield from flush()

    return run


def near_links(distinct: DataFrame, bits: int = BITS, block_homes: int = BLOCK_HOMES, block_visitors: int = BLOCK_VISITORS) -> DataFrame:
    """Links (u, v) that join all fingerprints (column fp, each once) within ``bits``, 3 at most, into components.

    Only anchors with a home and another fingerprint go on; those are few, whatever visits the others. An anchor with more
    than ``block_homes`` homes or ``block_visitors`` visitors is cut into a grid: homes go to a row of it, all that came
    to the anchor to a column, so no task holds a whole large group and every pair still meets.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the halves of this cover are made for up to 3 bits")
    replicas = distinct.select("fp").mapInArrow(_replicas, "anchor long, fp long, home boolean")
    live = replicas.groupBy("anchor").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count(F.lit(1)).alias("all")).where("homes > 0 AND all > 1")
    blocks = lambda n, most: F.ceil(F.col(n) / F.lit(most)).cast("int")
    live = materialise(live.select("anchor", blocks("homes", block_homes).alias("rows"), blocks("all", block_visitors).alias("columns")), "live-anchors")
    replicas = replicas.join(live.hint("merge"), "anchor")
    own = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    cell = lambda row, column, home: F.struct(row.cast("long").alias("row"), column.cast("long").alias("column"), home.alias("home"))
    across = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: cell(own("rows"), j, F.lit(True)))
    down = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: cell(i, own("columns"), F.lit(False)))
    whole = (F.col("rows") == 1) & (F.col("columns") == 1)
    cells = F.when(whole, F.array(cell(F.lit(0), F.lit(0), F.col("home")))).when(F.col("home"), F.concat(across, down)).otherwise(down)
    dealt = replicas.select("anchor", "fp", F.explode(cells).alias("cell")).select("anchor", "cell.row", "cell.column", "fp", "cell.home")
    dealt = dealt.repartition("anchor", "row", "column").sortWithinPartitions("anchor", "row", "column")
    return dealt.mapInArrow(_compare(bits), "u long, v long")


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Rows with equal fingerprints are linked, those of null and empty texts too. component_id is the least doc_id that
    links reach, itself included; null only where all of them are null. Repeated rows give repeated rows; other columns
    are ignored; an empty table gives no rows.
    """
    fps = materialise(fingerprints(docs, shingle), "fingerprints")
    by_fp = _components(fps, bits)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(by_fp.hint("merge"), "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def _components(fps: DataFrame, bits: int) -> DataFrame:
    """(fp, component_id) of every fingerprint; what is joined is written first, so that all joins are of plain shuffles."""
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = connected_components(near_links(distinct, bits))
    tied = distinct.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    tied = materialise(tied, "fingerprint-roots")
    least = materialise(tied.groupBy("root").agg(F.min("first_id").alias("component_id")), "least-ids")
    return materialise(tied.join(least.hint("merge"), "root").select("fp", "component_id"), "fingerprint-components")


def drop_near_copies(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group of near-duplicates the row with the least doc_id.

    Where several texts of a group share that doc_id, the one with the least fingerprint stays; of rows that repeat both any
    one. A group of null doc_ids alone keeps one row.
    """
    at = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, at):
            fps = np.array([fingerprint(t or b"", shingle) for t in batch.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(fps.view(np.int64))], names=[*batch.schema.names[:at], "__v_fp"])

    rows = docs.select(*docs.columns, F.col("text").cast("binary").alias("__v_text")).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__v_fp", T.LongType())]))
    rows = materialise(rows.withColumn("__v_row", F.monotonically_increasing_id()), "fingerprinted")
    by_fp = _components(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__v_fp").alias("fp")), bits)
    placed = rows.select("doc_id", "__v_fp", "__v_row").join(by_fp.withColumnRenamed("fp", "__v_fp").hint("merge"), "__v_fp").where(F.col("doc_id").cast("long").eqNullSafe(F.col("component_id")))
    keep = placed.groupBy(F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("__v_fp"))).agg(F.min(F.struct("__v_fp", "__v_row")).alias("least"))
    keep = materialise(keep.select(F.col("least.__v_row").alias("__v_row")), "kept-rows")
    return rows.join(keep.hint("merge"), "__v_row", "left_semi").select(*docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
