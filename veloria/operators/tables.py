"""Keyed tables: upserts, versions, differences, duplicates, increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..sources import contracts


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, keep: tuple[str, ...] = (), contract: T.StructType | None = None) -> DataFrame:
    """The table after an insert-or-overwrite of ``new``: its last row by ``order`` wins; columns in ``keep`` never become null.

    With a ``contract`` both sides must meet it.
    """
    if contract is not None:
        old, new = contracts.guard(old, contract), contracts.guard(new, contract)
    tagged = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    if not keep:
        return latest(tagged, keys, [F.desc("_batch"), F.desc(order)]).drop("_batch")
    w = W.partitionBy(*keys).orderBy(F.desc("_batch"), F.desc(order)).rowsBetween(0, W.unboundedFollowing)
    filled = tagged.withColumns({c: F.first(c, ignorenulls=True).over(w) for c in keep})
    return latest(filled, keys, [F.desc("_batch"), F.desc(order)]).drop("_batch")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change) between two versions: added, removed or changed, by a hash of all other columns."""
    others = sorted(c for c in old.columns if c != key)
    a = old.select(F.col(key).alias("_a"), F.xxhash64(*others).alias("_old"))
    b = new.select(F.col(key).alias("_b"), F.xxhash64(*others).alias("_new"))
    joined = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return joined.select(F.coalesce("_a", "_b").alias(key), change.alias("change")).where("change IS NOT NULL")


def since(rows: DataFrame, ts: str, mark: Column) -> DataFrame:
    """Rows after a high-water mark."""
    return rows.where(F.col(ts) > mark)


def stale(updated: str, as_of: Column, days: int = 30, changed: Column | None = None) -> Column:
    """Older than ``days`` at ``as_of``, or changed."""
    old = F.col(updated) < as_of - F.make_dt_interval(F.lit(days))
    return old if changed is None else old | changed
