"""Cleaning of text records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cleaned(rows: DataFrame, least: int = 20) -> DataFrame:
    """Trimmed, blanks collapsed; rows with less than ``least`` characters left are junk and go."""
    text = F.btrim(F.regexp_replace("text", r"\s+", " "))
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text")).where(F.col("n_chars") >= least)


def deduplicated(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of rows with equal text but for case those with the least key; a null key is the largest, so texts under null keys alone stay."""
    digest = F.sha2(F.lower("text"), 256)
    keep = rows.groupBy(digest.alias("_h")).agg(F.min(key).alias("_k"))
    return rows.join(keep, F.col(key).eqNullSafe(F.col("_k")) & digest.eqNullSafe(F.col("_h")), "left_semi")


def tagged_union(sources: dict[str, DataFrame]) -> DataFrame:
    """The rows of all sources with their ``origin``; columns that a source lacks are null."""
    out = None
    for name, df in sources.items():
        part = df.withColumn("origin", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
