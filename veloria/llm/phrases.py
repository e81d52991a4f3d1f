"""Fingerprints of documents from the phrases of a Lempel-Ziv parse.

A text is parsed into phrases, each the shortest run of code points that is not in the text's dictionary yet; the phrases
are hashed and the least hashes are the fingerprint (a minimum-hash signature). Two texts that compress well together share
phrases, so the share of equal hashes among the least of both is a likeness from 0 to 1. A phrase left open at the
text's end is in the dictionary already and adds nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise
from .tokens import small_batches

#: Hashes of a fingerprint.
PLACES = 128
#: Blocks of documents in doc_id order, at most; the driver holds their bounds.
MOST_BLOCKS = 10_000

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as any text so far needed them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(4096, 1 << (n - 1).bit_length())
            self.up, self.down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def phrase_hashes(text: str, ends: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each phrase ``text[ends[i - 1]:ends[i]]``; it depends on the phrase alone, not on its place."""
    if not len(ends):
        return np.zeros(0, np.uint32)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    up, down = _powers.upto(len(code) + 1)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(code * up[:-1], out=sums[1:])
    starts = np.r_[0, ends[:-1]]
    h = (sums[ends] - sums[starts]) * down[starts]
    h = (h ^ (h >> _HALF)) * _MIX
    h = (h ^ (h >> _HALF)) * _MIX
    return (h >> _HALF).astype(np.uint32)


@dataclass(frozen=True)
class Parse:
    """The phrases of a text in their order, where each ends, and their hashes."""

    text: str
    phrases: list[str]
    ends: np.ndarray
    hashes: np.ndarray


def _grow(seen: dict[str, None], node: str, text: str) -> None:
    """Parse on: ``node`` is the phrase left open, ``seen`` the dictionary, in the order of its phrases."""
    for ch in text:
        node += ch
        if node not in seen:
            seen[node] = None
            node = ""


def parse(text: str) -> Parse:
    """Parse a whole text."""
    seen: dict[str, None] = {}
    _grow(seen, "", text)
    ends = np.cumsum(np.fromiter(map(len, seen), np.int64, len(seen)))
    return Parse(text, list(seen), ends, phrase_hashes(text, ends))


def reparse(head: Parse, cut: int, tail: str) -> np.ndarray:
    """Hashes of the phrases of ``head.text[:cut] + tail``; what the head's parse gave up to ``cut`` is not parsed again."""
    whole = int(np.searchsorted(head.ends, cut, "right"))
    at = int(head.ends[whole - 1]) if whole else 0
    seen = dict.fromkeys(head.phrases[:whole])
    open_ = head.text[at:cut]
    _grow(seen, open_, tail)
    new = list(seen)[whole:]
    return np.r_[head.hashes[:whole], phrase_hashes(open_ + tail, np.cumsum(np.fromiter(map(len, new), np.int64, len(new))))]


def signature(hashes: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The least ``places`` distinct hashes, ascending; all, if fewer."""
    return np.unique(hashes)[:places]


def likeness(a: np.ndarray, b: np.ndarray, places: int = PLACES) -> float:
    """Share of the least hashes of both signatures together that both hold; 1.0 for two empty ones."""
    both = np.sort(np.concatenate((a, b)))
    if not len(both):
        return 1.0
    twice = both[1:] == both[:-1]
    return float(np.append(twice, False)[np.append(True, ~twice)][:places].mean())


def fingerprint(text: str, places: int = PLACES) -> str:
    """8 hex digits for each hash of the signature, ascending; '' for an empty text."""
    return written(signature(parse(text).hashes, places))


def written(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    """The signature that ``written`` wrote."""
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, places: int = PLACES) -> DataFrame:
    """doc_id, n_chars and fingerprint of every row of ``docs`` (doc_id, text); nothing is shuffled.

    A null text counts as empty, repeated rows are kept, a null doc_id stays null, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            texts = [_text(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "n_chars": pa.array(map(len, texts), pa.int64()), "fingerprint": pa.array([fingerprint(t, places) for t in texts], pa.string())})

    return _raw(docs).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _text(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace")


def _raw(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def _blocked(rows: DataFrame, blocks: int) -> DataFrame:
    """Add ``_block``, ascending in the order of ``rows`` (doc_id descending, null last, then ``_h``): some ``blocks`` blocks of like size.

    Bounds are quantiles of doc_id. A doc_id that fills several blocks, or the null one, is cut further by ``_h``.
    """
    found = rows.agg(F.percentile_approx("doc_id", [(i + 0.5) / blocks for i in range(blocks)], F.lit(10 * blocks)).alias("cuts"), F.count("doc_id").alias("known"), F.count(F.lit(1)).alias("all")).first()
    cuts = Counter(found["cuts"] or [])
    bounds = sorted({float(v): v for v in cuts}.values())
    part = lambda n: (F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * n) + 1).cast("long")  # noqa: E731  from 1, ascending in _h
    place = F.col("_bucket").cast("long")
    sub = F.lit(0).cast("long")
    for i, value in enumerate(bounds, 1):
        if cuts[value] > 1:  # larger ids of the bucket stand before it, those that a double can't tell from it and are smaller behind
            sub = F.when((place == i) & (F.col("doc_id") == value), part(cuts[value])).when((place == i) & (F.col("doc_id") < value), F.lit(1 << 31)).otherwise(sub)
    nulls = (found["all"] - found["known"]) * blocks // max(1, found["all"]) + 1
    last = F.lit((len(bounds) + 1) << 32) + part(nulls)
    if not bounds:
        return rows.withColumn("_block", last)
    bucket = Bucketizer(splits=[-math.inf, *map(float, bounds), math.inf], inputCol="_id", outputCol="_bucket", handleInvalid="keep")
    block = F.when(F.col("doc_id").isNull(), last).otherwise(F.shiftleft(F.lit(len(bounds)).cast("long") - place, 32) + sub)
    return bucket.transform(rows.withColumn("_id", F.col("doc_id").cast("double"))).withColumn("_block", block).drop("_id", "_bucket")


def _closed(rows: DataFrame) -> DataFrame:
    """``rows`` and, at the end of each block, the row that follows the block's last one: ``_closing``."""
    spark = rows.sparkSession
    keys = rows.groupBy("_block").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("d"), F.col("_h").alias("h"))).alias("_key"))
    keys = materialise(keys.select(F.col("_block").alias("_own"), "_key"), "phrase-blocks")  # a row a block
    heads = rows.join(F.broadcast(keys), (F.col("_block") == F.col("_own")) & F.bitwise_not("doc_id").eqNullSafe(F.col("_key.d")) & (F.col("_h") == F.col("_key.h")))
    heads = heads.groupBy("_own", "doc_id", "_h").agg(F.min("text").alias("text"))
    names = sorted(r._own for r in keys.select("_own").collect())
    before = spark.createDataFrame(list(zip(names, names[-1:] + names[:-1], strict=True)), "_own long, _block long")
    heads = heads.join(F.broadcast(before), "_own").drop("_own")
    return rows.withColumn("_closing", F.lit(False)).unionByName(heads.withColumn("_closing", F.lit(True)))


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, places: int = PLACES, blocks: int | None = None) -> DataFrame:
    """Fingerprints of every row of ``docs`` and of its edited text, whose last half comes from the next document.

    The last floor(n_chars / 2) code points are replaced by the first as many (or all) of the next row's text, in
    descending order of doc_id; the first row follows the last one, so a lone row follows itself. A null text counts as
    empty. Null doc_ids come last; rows that share a doc_id stand in the order of their texts' XXH64, then of their texts.
    Two empty texts have a likeness of 1, an empty and another one 0. Other columns are ignored; an empty table gives
    no row.

    Rows are shuffled once, into blocks of the order; the first row of each block also closes the block before it. A task
    holds two texts and their dictionaries at a time.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _closed(_blocked(_raw(docs).withColumn("_h", F.xxhash64("text")), blocks or min(MOST_BLOCKS, 4 * partitions)))
    rows = rows.repartition(2 * partitions, "_block").sortWithinPartitions("_block", "_closing", F.desc_nulls_last("doc_id"), "_h", "text")

    def result(doc: int | None, own: Parse, sig: np.ndarray, then: Parse, next_sig: np.ndarray) -> tuple:
        n = len(own.text)
        cut, tail = n - n // 2, then.text[: n // 2]
        edited = signature(reparse(own, cut, tail), places)
        digest = hashlib.sha256((own.text[:cut] + tail).encode()).hexdigest()
        return doc, n, digest, written(sig), written(edited), likeness(sig, edited, places), likeness(sig, next_sig, places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, sig = None, None, None
        for batch in small_batches(batches, 1):
            out = []
            for doc, raw, closing in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = _text(raw)
                then = own if own is not None and own.text == text else parse(text)
                next_sig = sig if then is own else signature(then.hashes, places)
                if now is not None:
                    out.append(result(now[0], own, sig, then, next_sig))
                now, own, sig = None if closing else (doc,), then, next_sig
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), FIELDS, strict=True)] if out else [pa.array([], t) for t in FIELDS], names=[f.split()[0] for f in EDITED.split(", ")])

    return rows.select("doc_id", "text", "_closing").mapInArrow(run, EDITED)


FIELDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def op11_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
