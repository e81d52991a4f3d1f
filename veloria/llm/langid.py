"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

The model is trained on the driver by stochastic gradient descent in numpy, on a bounded sample: ``PER_LANGUAGE``
documents of each of the ``MOST_LANGUAGES`` most frequent languages, ``MOST_DOCUMENTS`` in all, and ``SEGMENTS`` stretches of
each. Other labels are not learned. Everything else covers all rows and whole texts. The
average of embeddings under a linear layer is linear in the subword counts, so prediction adds up one row of
``embeddings @ weights`` per subword.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise
from .tokens import small_batches

BUCKETS = 1 << 14
WIDTH = 16
GRAMS = (2, 3, 4)
#: The bounds of the training sample: labelled documents a language, labelled documents in all (at least one a language, as long
#: as there are not more languages than that), and the stretches of a document with their characters.
PER_LANGUAGE = 500
MOST_DOCUMENTS = 20_000
STRETCHES = (400, 80, 400, 25, 400, 160)
SEGMENTS = len(STRETCHES)
#: The share of rightly recognised calibration documents that the rejection may cost at most.
LOST = 0.001
UNKNOWN = "und"

_alpha: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _alpha[0]


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every hashed character n-gram, and each text's number of letters.

    Texts are lower-cased, each run of other characters than letters becomes one boundary mark.
    """
    points = [np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    lengths = np.array([len(p) for p in points])
    flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
    letter = _letters()[flat]
    owner = np.repeat(np.arange(len(texts)), lengths)
    letters = np.bincount(owner[letter], minlength=len(texts))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)] = True
    flat = np.where(letter, flat, np.uint32(32))[keep].astype(np.uint64)
    owner = owner[keep]
    buckets, owners = [], []
    value = flat
    for n in range(2, max(GRAMS) + 1):
        value = value[:-1] * np.uint64(0x100000001B3) + flat[n - 1 :]
        if n in GRAMS:
            same = owner[: len(value)] == owner[n - 1 :]
            mixed = (value * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) >> np.uint64(40)
            buckets.append((mixed[same] & np.uint64(BUCKETS - 1)).astype(np.int32))
            owners.append(owner[: len(value)][same])
    return np.concatenate(buckets), np.concatenate(owners), letters


@dataclass(frozen=True)
class LanguageModel:
    """``table`` is embeddings @ weights; scores are the softmax of (mean of table rows + bias) / temperature."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, owner, letters = subwords(texts)
        count = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        sums = [np.bincount(owner, self.table[:, k][ids], len(texts)) for k in range(len(self.languages))]
        return np.stack(sums, axis=1) / count[:, None] + self.bias, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected; texts without a letter are unknown with score 0."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        logits, letters = self.logits(texts)
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        known = letters > 0
        score = np.where(known, p[np.arange(len(texts)), best], 0.0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], score, ~known | (score < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _counts(texts: list[str]) -> np.ndarray:
    ids, owner, _ = subwords(texts)
    x = np.bincount(owner.astype(np.int64) * BUCKETS + ids, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS).astype(np.float32)
    return x / np.maximum(x.sum(axis=1, keepdims=True), 1)


def train(languages: list[str], names: list[str], texts: list[str], held: np.ndarray, epochs: int = 4, batch: int = 48, rate: float = 2.0, seed: int = 5) -> LanguageModel:
    """Fit on the texts that are not ``held``, then set temperature and rejection threshold on those that are."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    y = np.array([languages.index(n) for n in names])
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (WIDTH, k)).astype(np.float32), np.zeros(k, np.float32)
    fit = np.flatnonzero(~held)
    steps, step = max(1, epochs * -(-len(fit) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(fit)
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x = _counts([texts[i] for i in pick])
            hidden = x @ emb
            grad = softmax(hidden @ out + bias).astype(np.float32)
            grad[np.arange(len(pick)), y[pick]] -= 1
            lr = rate * (1 - step / steps) / len(pick)
            back = grad @ out.T
            out -= lr * 8 * (hidden.T @ grad)
            bias -= lr * grad.sum(axis=0)
            emb -= lr * len(pick) * 4 * (x.T @ back)
            step += 1
    model = LanguageModel(tuple(languages), (emb @ out).astype(np.float64), bias.astype(np.float64), 1.0, 0.0)
    check = np.flatnonzero(held)
    if not len(check):
        return model
    logits, _ = model.logits([texts[i] for i in check])
    grid = np.geomspace(0.05, 5, 40)
    losses = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(check)), y[check]], 1e-12)).mean() for t in grid]
    heat = float(grid[int(np.argmin(losses))])
    p = softmax(logits / heat)
    right = p.argmax(axis=1) == y[check]
    scores = np.sort(p.max(axis=1)[right])
    bar = float(scores[int(len(scores) * LOST)]) if len(scores) else 0.0
    return LanguageModel(model.languages, model.table, model.bias, heat, bar)


def _stretches(text: str) -> list[str]:
    """SEGMENTS stretches of the lengths in STRETCHES (characters), spread over the whole text; a short text is one."""
    if len(text) <= min(STRETCHES):
        return [text]
    room = [max(0, len(text) - s) for s in STRETCHES]
    return [text[(a := r * i // (SEGMENTS - 1)) : a + s] for i, (s, r) in enumerate(zip(STRETCHES, room, strict=True))]


def _remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, lang, part): stretches of at most ``per_language`` labelled documents of each language.

    Documents whose crc32(doc_id) mod 4 is 2 are left out. Rows that share language and doc_id are one document, so a
    language with any labelled document is in the sample. The choice is by hash of doc_id: reruns agree. Only hashes and ids
    are looked at over the whole table; the texts follow for the chosen ones.
    """
    order = F.xxhash64("doc_id", F.lit(11))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("_order", "doc_id"))
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (_remainder() != 2)).select(F.col("doc_id"), F.col("lang"), order.alias("_order"))
    labelled = labelled.distinct()  # combined on the map side
    counts = labelled.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    counts = materialise(counts.orderBy(F.desc("_n"), "_lang").limit(MOST_DOCUMENTS), "language-counts")
    per_language = max(1, min(per_language, MOST_DOCUMENTS // max(1, counts.count())))
    # a slice of the hashes holds the sample and a safe surplus, so that the ranking sees few rows of a frequent language
    share = F.least(F.lit(1.0), F.lit(3.0 * per_language + 40) / F.col("_n"))
    near = labelled.join(counts.hint("broadcast"), F.col("lang") == F.col("_lang"))  # MOST_DOCUMENTS rows at most
    near = near.where((share >= 1) | (F.col("_order") < (share * 2 - 1) * F.lit(float(1 << 63))))
    chosen = materialise(near.withColumn("_rank", rank).where(F.col("_rank") <= per_language).select("doc_id", "lang"), "language-sample")
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    rows = rows.join(chosen.hint("broadcast"), ["doc_id", "lang"], "left_semi")  # MOST_DOCUMENTS rows at most

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(d, n, p) for d, n, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for p in _stretches(t)]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "lang", "part"])

    parts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(cut, "doc_id long, lang string, part string")
    bound = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "part"))
    return parts.withColumn("_rank", bound).where(F.col("_rank") <= per_language * SEGMENTS).select("doc_id", "lang", "part")


def fit_language_model(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Train on the bounded sample. Without a labelled document the model knows no language."""
    rows = training_sample(docs, per_language).orderBy("lang", "doc_id", "part").toPandas()
    languages = sorted(rows["lang"].unique())
    if not languages:
        return LanguageModel((), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    held = (rows["doc_id"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(10) == 0
    return train(languages, rows["lang"].tolist(), rows["part"].tolist(), held)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0 and rejected. Repeated rows repeat; held_out is null
    where doc_id is; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in small_batches(batches, 1, 1 << 19):
            names, score, rejected = own.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.record_batch({"doc_id": batch.column(0), "lang_pred": pa.array(names, pa.string()), "score": score, "rejected": rejected})

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", (_remainder() == 2).alias("held_out"), "lang_pred", "score", "rejected")


def drop_unknown_languages(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with all their columns.

    Null texts, texts without a letter and those that score below the calibrated threshold go; repeated rows stay or go together.
    """
    model = fit_language_model(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        at = types.fieldNames().index("text")
        for batch in small_batches(batches, at, 1 << 19):
            _, _, rejected = own.predict([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(run, types)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit_language_model(docs))
