"""Token ids: encoding whole texts, and token files with Elias-Fano document boundaries.

File format. A token file holds one block::

    magic 'VTK1' | u32 n_docs | u32 n_null | u64 n_tokens | i64 first_id | u8 id_width | u32 len(B) | u32 len(D) | B | D | ids | '\\n'

``B`` is the Elias-Fano list of the documents' end offsets in the id array, ``D`` that of their doc_ids less ``first_id``
(the first ``n_null`` documents have a null doc_id and no entry in ``D``), ``ids`` the concatenated ids as unsigned
little-endian integers of ``id_width`` bytes. Blocks are cut at ``block_tokens``, so all offsets fit 32 bits; a document
longer than that has a block of its own.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, scratch_path

BLOCK_TOKENS = 2_000_000
HEADER = struct.Struct("<4sIIQqBII")
MAGIC = b"VTK1"
#: A worker keeps two generations of so many words, from one task to the next.
CACHE_WORDS = 1 << 17
CACHED_LENGTH = 64

#: A plain word: letters that are their own normal form in lower case, and marks after them.
_PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,;:!?]*)")
#: Byte-level vocabularies write a byte that is no visible Latin-1 character as a character from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}

#: The settings under which white space parts words for good and plain words of letters stay whole, as they
#: stand in the tokenizer's file. With any other settings whole texts go through the tokenizer.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

_encoders: dict[str, WordEncoder] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where this machine keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder(dict):
    """Encodes whole texts; word by word if the tokenizer never joins what ASCII white space separates, which its settings show.

    Such a tokenizer gives a text's ids as its words' ids in turn, so each new word is encoded once and kept as bytes: this
    is a dictionary from words to ids that fills itself. It has two generations of CACHE_WORDS at most; what is used again
    moves to the young one. Where the tokenizer lower-cases, ASCII letters are lowered first. Plain words of letters, which
    its rules leave whole, go straight to its model, and marks after them are encoded once; all other words go through the
    whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.old: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        bare = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and len(t["content"].split()) == 1 for t in settings["added_tokens"])
        self.by_words = bare and settings["normalizer"] == _NORMALIZER and settings["pre_tokenizer"] == _PRE_TOKENIZER and settings["model"]["type"] == "BPE"
        self.plain = self.by_words and self._takes_plain_words()

    def _alone(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _model_ids(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LEVEL))]

    def _takes_plain_words(self) -> bool:
        """Whether plain words give the same ids from the model alone, tried on a few; only lower-casing tokenizers can."""
        tried = ["abc", "naïve", "straßenfähig", "qzxv", "thstio", "ÿöø"]
        return all(self.tokenizer.encode(x, add_special_tokens=False).ids == self._model_ids(w) for w in tried for x in (w, w.upper() if w.isascii() else w))

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._new(word)
        if len(word) <= CACHED_LENGTH:
            self[word] = ids
        return ids

    def _new(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        m = _PLAIN.fullmatch(text.lower()) if self.plain and len(word) <= CACHED_LENGTH else None
        if m is None:
            return self._alone(text)
        letters, marks = m.groups()
        if marks not in self.marks:
            self.marks[marks] = self._alone(marks)
        own = letters.encode()
        return (self[own] if marks and own != word else array("I", self._model_ids(letters)).tobytes()) + self.marks[marks]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            return [self._alone(t.decode("utf-8", "replace")) for t in texts]
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        ids_of = self.__getitem__
        # special tokens are matched as they stand, so texts that may hold one keep their case
        return [b"".join(map(ids_of, (t.lower() if self.plain and b"<|" not in t else t).split())) for t in texts]


def encoder(path: str) -> WordEncoder:
    """This worker's encoder: it outlives a task, with the words that it knows."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def small_batches(batches: Iterator[pa.RecordBatch], text: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, one row at least."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
        at, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if total and total + n > limit:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < batch.num_rows:
            yield batch.slice(at)


class EliasFano:
    """A non-decreasing list of unsigned integers in about 2 + log2(universe / n) bits each.

    ``select(i)`` returns one value from the list: every SAMPLE-th one bit of the upper part has its place kept in 32
    bits, the rest is found by counting bits from there.
    """

    SAMPLE = 256
    HEAD = struct.Struct("<IBI")

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.ascontiguousarray(values, np.uint64)
        n = len(v)
        universe = int(v[-1]) + 1 if n else 1
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        bits = ((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        flags[ones] = 1
        return cls(n, width, low, np.packbits(flags, bitorder="little"), ones[:: cls.SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.width, len(self.high)) + self.samples.tobytes() + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview | bytes) -> EliasFano:
        n, width, n_high = cls.HEAD.unpack_from(raw)
        at = cls.HEAD.size
        n_samples = -(-n // cls.SAMPLE)
        samples = np.frombuffer(raw, "<u4", n_samples, at)
        at += 4 * n_samples
        high = np.frombuffer(raw, np.uint8, n_high, at)
        low = np.frombuffer(raw, np.uint8, -(-n * width // 8), at + n_high)
        return cls(n, width, low, high, samples)

    def _low(self, i: int) -> int:
        first, last = i * self.width, (i + 1) * self.width
        chunk = int.from_bytes(self.low[first // 8 : -(-last // 8)].tobytes(), "little")
        return (chunk >> (first % 8)) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // self.SAMPLE]), i % self.SAMPLE
        byte = place // 8
        left += int(np.bitwise_count(np.uint8(int(self.high[byte]) & ((1 << place % 8) - 1))))
        while True:
            ones = np.cumsum(np.bitwise_count(self.high[byte : byte + 64]), dtype=np.int64)
            k = int(np.searchsorted(ones, left, side="right"))
            if k < len(ones):
                left -= int(ones[k - 1]) if k else 0
                byte += k
                break
            left -= int(ones[-1])
            byte += 64
        for bit in range(8):
            if self.high[byte] >> bit & 1:
                if not left:
                    return ((byte * 8 + bit - i) << self.width) | self._low(i)
                left -= 1
        raise AssertionError("not reached")

    def values(self) -> np.ndarray:
        """All values: the same as select() of each place."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        if not self.width:
            return high
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.width).reshape(self.n, self.width)
        return high | (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def pack_block(doc_ids: list[int | None], ids: list[bytes], wide: bool) -> bytes:
    """One block of a token file; doc_ids ascend, nulls first; ids are little-endian unsigned 32-bit integers."""
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.uint64)
    bounds = EliasFano.of(ends).to_bytes()
    names = EliasFano.of(np.array([d - first for d in known], np.uint64)).to_bytes()
    flat = np.frombuffer(b"".join(ids), "<u4")
    body = flat.tobytes() if wide else flat.astype("<u2").tobytes()
    head = HEADER.pack(MAGIC, len(doc_ids), len(doc_ids) - len(known), len(flat), first, 4 if wide else 2, len(bounds), len(names))
    return head + bounds + names + body


class TokenBlock:
    """A block read back: ``document(i)`` finds one document by two selects."""

    def __init__(self, raw: bytes):
        magic, self.n_docs, self.n_null, self.n_tokens, self.first, self.id_width, n_bounds, n_names = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        view, at = memoryview(raw), HEADER.size
        self.bounds = EliasFano.from_bytes(view[at : at + n_bounds])
        self.names = EliasFano.from_bytes(view[at + n_bounds : at + n_bounds + n_names])
        self.ids = np.frombuffer(raw, f"<u{self.id_width}", self.n_tokens, at + n_bounds + n_names)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i - 1) if i else 0 : self.bounds.select(i)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + [int(v) + self.first for v in self.names.values()]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every text of ``docs`` (doc_id, text) and write token files in ascending doc_id order under ``path``.

    A null or empty text is the end id alone. Null doc_ids come first; equal doc_ids stand side by side, ordered by text.
    Other columns are ignored. An empty table writes no block. Files are written by Spark's own committing writer, one
    block each, so a lost task leaves nothing behind and a retried one writes the same bytes.
    """
    end = np.array([end_id], "<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        names: list[int | None] = []
        held: list[bytes] = []
        total = 0

        def out() -> pa.RecordBatch:
            return pa.record_batch({"block": pa.array([pack_block(names, held, enc.wide)], pa.binary())})

        for batch in small_batches(batches, 1):
            ids = enc.encode([t or b"" for t in batch.column(1).to_pylist()])
            for name, x in zip(batch.column(0).to_pylist(), ids, strict=True):
                if held and total + len(x) // 4 + 1 > block_tokens:
                    yield out()
                    names, held, total = [], [], 0
                names.append(name)
                held.append(x + end)
                total += len(x) // 4 + 1
        if held:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    packed = ordered.mapInArrow(blocks, "block binary")
    packed.select(F.col("block").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the token files under ``path``: doc_id, start, n_tokens, ids_crc32.

    Each file is read once. Files stand in the order of their writers' numbers: the part, and the file within the part. A
    file's place in the whole is a running sum over the files' tokens, in two levels.
    """
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > F.lit(1))
    number = lambda k: F.regexp_extract("path", r"part-(\d+)-[^/]*?(?:-c(\d+))?[^-/]*$", k).cast("long")
    files = files.select(number(1).alias("_part"), F.coalesce(number(2), F.lit(0)).cast("long").alias("_file"), "content")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = TokenBlock(batch.column(2)[i].as_py())
                ends = block.bounds.values().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                raw = block.ids.astype("<u4")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = block.n_docs
                own = {c: pa.array([batch.column(k)[i].as_py()] * n, pa.int64()) for k, c in enumerate(("_part", "_file"))}
                yield pa.record_batch(own | {"doc_id": pa.array(block.doc_ids(), pa.int64()), "_start": starts, "n_tokens": ends - starts, "ids_crc32": pa.array(crc, pa.int64())})

    rows = materialise(files.mapInArrow(documents, "_part long, _file long, doc_id long, _start long, n_tokens long, ids_crc32 long"), "token-documents")
    heads = rows.groupBy("_part", "_file").agg(F.sum("n_tokens").alias("_n")).withColumn("_chunk", F.floor(F.col("_part") / 1024))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    chunks = heads.groupBy("_chunk").agg(F.sum("_n").alias("_total"))
    chunks = chunks.select("_chunk", F.coalesce(F.sum("_total").over(before(W.partitionBy().orderBy("_chunk"))), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum("_n").over(before(W.partitionBy("_chunk").orderBy("_part", "_file"))), F.lit(0))
    heads = heads.withColumn("_own", own).join(chunks.hint("merge"), "_chunk").select("_part", "_file", (F.col("_before") + F.col("_own")).alias("_base"))
    return rows.join(materialise(heads, "token-blocks").hint("merge"), ["_part", "_file"]).select("doc_id", (F.col("_base") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path())
    return read_token_files(spark, path)
