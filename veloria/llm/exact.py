"""Exact deduplication of texts, safe against one text holding a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

SALTS = 64


def _winners(docs: DataFrame, salts: int) -> DataFrame:
    """One row per distinct text: keep_id and group_size, by three rounds of which each compares the full text.

    Equal texts first meet within a task (the map side of the grouping), then within their salted digest group, then
    across salts; no round gathers a group's rows, each keeps a running largest doc_id and a count. The salt is the task's
    number, so a task sends each of its texts once, however often it holds it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("_text"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"))
    rows = rows.withColumn("_digest", F.unhex(F.sha2("_text", 256)))
    salted = rows.groupBy("_digest", "_salt", "_text").agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    return salted.groupBy("_digest", "_text").agg(F.max("_keep").alias("keep_id"), F.sum("_n").alias("group_size"))


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with keep_id, group_size, kept and text_sha256; null text counts as empty.

    Of equal texts the row with the largest doc_id is kept. Rows that repeat a doc_id and text are one document: each is
    marked as kept if that doc_id is. A null doc_id is never kept beside a known one; a group of null doc_ids alone keeps
    its rows with a null keep_id. Other columns are ignored; an empty table gives an empty result.
    """
    winners = materialise(
        _winners(docs, salts).groupBy("_digest").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("_texts")), "exact-winners"
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.unhex(F.sha2(text, 256)).alias("_digest"))
    out = rows.join(winners.where("_texts = 1").hint("merge"), "_digest").select("doc_id", "_digest", "keep_id", "group_size")
    if not winners.where("_texts > 1").isEmpty():  # different texts under one SHA-256 digest: tell them apart by their texts
        clash = winners.where("_texts > 1").select("_digest")
        full = _winners(docs, salts).join(clash.hint("merge"), "_digest", "left_semi")
        own = docs.select(F.col("doc_id"), text.alias("_text"), F.unhex(F.sha2(text, 256)).alias("_digest")).join(clash.hint("merge"), "_digest", "left_semi")
        out = out.unionByName(own.join(full.hint("merge"), ["_digest", "_text"]).select("doc_id", "_digest", "keep_id", "group_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay: one of each distinct text, with all its columns.

    Of rows that repeat the doc_id and the text that stay any one is taken.
    """
    kept = exact_groups(docs, salts).where("kept").groupBy(F.col("doc_id").alias("__v_keep"), F.col("text_sha256").alias("__v_sha")).agg(F.count(F.lit(1)).alias("__v_rows"))
    kept = materialise(kept, "exact-kept")
    rows = docs.withColumn("__v_own", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    on = F.col("doc_id").eqNullSafe(F.col("__v_keep")) & (F.col("__v_own") == F.col("__v_sha"))
    out = rows.join(kept.where("__v_rows = 1").hint("merge"), on, "left_semi")
    repeated = kept.where("__v_rows > 1")
    if not repeated.isEmpty():
        out = out.unionByName(rows.join(repeated.hint("merge"), on, "left_semi").dropDuplicates(["doc_id", "__v_own"]))
    return out.select(*docs.columns)


SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
         count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size, sha256(coalesce(text, '')) AS text_sha256
  FROM documents)
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
