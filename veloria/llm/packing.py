"""Packing tokenised documents into training sequences.

A document is cut into whole sequences and a rest. The pieces are written once; then the rests are packed first-fit decreasing,
with a tournament tree over the bins' free space, within randomised groups. The number of groups follows the number of
pieces, and so does each piece's random number, so groups have a bounded size whatever the documents are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise
from .tokens import encoder, small_batches, tokenizer_path

SEQUENCE = 2048
GROUP_PIECES = 8000
NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
PIECES = ", ".join(f"{n} long" for n in NAMES)


class TournamentTree:
    """Bins in the leaves, the larger free space of two children in each inner node: first fit in O(log bins)."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves, self.opened = capacity, 1, 0
        self.tree = [0, capacity]

    def _grow(self) -> None:
        old, n = self.tree, self.leaves
        free = old[n : 2 * n] + [self.capacity] * n
        self.leaves = 2 * n
        self.tree = [0] * self.leaves + free
        for i in range(self.leaves - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` in the first bin that has room; return the bin and the offset in it."""
        if self.tree[1] < size:
            self._grow()
        tree, i = self.tree, 1
        while i < self.leaves:
            i = 2 * i if tree[2 * i] >= size else 2 * i + 1
        offset = self.capacity - tree[i]
        bin_ = i - self.leaves
        tree[i] -= size
        while i > 1:
            i //= 2
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
        self.opened = max(self.opened, bin_ + 1)
        return bin_, offset


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, sequence: int = SEQUENCE) -> DataFrame:
    """Each document's pieces: as many of ``sequence`` tokens as it fills, and its rest.

    A null or empty text is the end id alone. Repeated rows are documents of their own; a null doc_id stays null. Other
    columns are ignored.
    """
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in small_batches(batches, 1):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode([t or b"" for t in batch.column(1).to_pylist()]), strict=True):
                raw = ids + end
                n = len(raw) // 4
                rows += [(doc, a, min(sequence, n - a), zlib.crc32(raw[4 * a : 4 * (a + sequence)]), n) for a in range(0, n, sequence)]
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=list(NAMES))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(pieces, PIECES)


def pack_pieces(pieces: DataFrame, groups: int, sequence: int = SEQUENCE, seed: int = 17) -> DataFrame:
    """Add sequence_id and offset: first-fit decreasing in each of ``groups`` randomised groups.

    ``pieces`` has a column ``draw``, a number of each piece's own, whose hash names its group: pieces of one document and
    equal rows spread like any others. Ties in size go by doc_id (null first), start, ids and draw.
    """
    order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("draw", "ascending")]

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start"))
        tree = TournamentTree(sequence)
        placed = [tree.place(n) for n in rows["length"].to_pylist()]
        base = key[0].as_py() << 32
        rows = rows.select(list(NAMES)).append_column("sequence_id", pa.array([base + b for b, _ in placed], pa.int64()))
        return rows.append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("draw", F.lit(seed)), F.lit(groups)).cast("long"))
    return dealt.groupBy("pack_group").applyInArrow(pack, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack all documents into sequences of at most ``sequence`` tokens; one row per piece.

    Null and empty texts are the end id alone, repeated rows are packed each, null doc_ids stay null, other columns are
    ignored; an empty table gives no piece.
    """
    pieces = materialise(cut_pieces(docs, tokenizer, end_id, sequence).withColumn("draw", F.monotonically_increasing_id()), "pieces")
    return pack_pieces(pieces, max(1, -(-pieces.count() // group_pieces)), sequence)


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
