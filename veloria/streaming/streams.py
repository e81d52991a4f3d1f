"""Structured Streaming forms of the batch operators: ingest, deduplication, windows, upserts, scoring, alerts.

Every stream runs with ``availableNow`` here: it takes what is landed and ends. Late rows, behind a watermark of a day, are
dropped and counted; the batch forms are authoritative.
"""

from __future__ import annotations

import os
from urllib.parse import quote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import tables
from ..sources import contracts

LATENESS = "1 day"


def landed(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files at ``path``: one file, or a folder with all files below it, partitioned or not.

    All that is landed comes in one trigger unless ``files_per_batch`` bounds it. Files come by their time of landing, not by event
    time: with a bound, rows behind the watermark of the batches before are dropped.
    """
    batch = spark.read.parquet(path)
    alone = os.path.basename(path.rstrip("/"))
    one_file = all(urlsplit(f).path.endswith("/" + quote(alone)) for f in batch.inputFiles())
    reader = spark.readStream.schema(batch.schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if one_file:
        return reader.option("pathGlobFilter", alone).parquet(os.path.dirname(path.rstrip("/")))
    return reader.parquet(path)


def timed(rows: DataFrame, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """A zone-less time as a timestamp (session zone UTC) with its watermark."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


PROGRESS = "batch long, landed long, dropped long"


def run(rows: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Run to the end of what is landed, into a Parquet sink; returns what it holds.

    ``progress`` tells how many rows came and how many were dropped as late.
    """
    spark = rows.sparkSession
    query = rows.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    seen = [(p.batchId, *_counted(p)) for p in query.recentProgress]
    if seen:
        spark.createDataFrame(seen, PROGRESS).coalesce(1).write.mode("append").json(f"{out}/progress")
    return spark.read.schema(rows.schema).parquet(f"{out}/data")


def _counted(progress) -> tuple[int, int]:
    """Rows that an observation named ``landed`` counted in a micro-batch, and those that its stateful operators dropped behind the watermark."""
    landed = progress.observedMetrics.get("landed")
    return (landed.rows if landed is not None else 0), sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)


def counted(rows: DataFrame) -> DataFrame:
    """``rows`` with an observation of their number, for ``progress``."""
    return rows.observe("landed", F.count(F.lit(1)).alias("rows"))


def progress(spark: SparkSession, out: str) -> DataFrame:
    """(batch, landed, dropped) of all micro-batches that wrote to ``out``; a batch that ran again counts once."""
    return spark.read.schema(PROGRESS).json(f"{out}/progress").groupBy("batch").agg(F.max("landed").alias("landed"), F.max("dropped").alias("dropped"))


def without_repeats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once, as long as its repeats come within the watermark: state is bounded by it."""
    return rows.dropDuplicatesWithinWatermark(keys)


def sliding_index(events: DataFrame) -> DataFrame:
    """Mean value per hero in windows of 7 days that start each day; closed windows only."""
    w = events.groupBy(F.window("ts", "7 days", "1 day").alias("w"), "hero_name").agg(F.round(F.avg("value"), 6).alias("value"))
    return w.select("hero_name", F.col("w.end").cast("timestamp_ntz").alias("window_end"), "value")


def daily_counts(events: DataFrame) -> DataFrame:
    w = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("rows"))
    return w.select("event_type", F.col("w.end").cast("timestamp_ntz").alias("window_end"), "rows")


BUCKETS = 64
MANIFEST = "n long, bucket int, batch long"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def upsert_into(rows: DataFrame, root: str, keys: list[str], order: str, buckets: int = BUCKETS) -> DataFrame:
    """Keep the newest row of each key in a table under ``root``, in ``buckets`` by hash of the key.

    A micro-batch reads and writes only the buckets that it touches. A manifest beside the data names, for each batch, the batch
    that wrote each bucket last. A batch whose manifest stands is done, and run again it changes nothing; one that failed before
    starts from the manifest before. Files that neither of the last two manifests names are deleted. A stream whose columns
    differ from those of the table, a bucket that is gone, and another number of buckets are errors.
    """
    spark = rows.sparkSession
    schema = rows.schema
    data = lambda batch, bucket: f"{root}/data/batch-{batch}/_bucket={bucket}"

    def manifests() -> dict[int, dict[int, int]]:
        try:
            found = spark.read.schema(MANIFEST).json(f"{root}/manifest/*").collect()  # a row a bucket, of the last manifests
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return {}
        out: dict[int, dict[int, int]] = {}
        for n, bucket, batch in found:
            out.setdefault(n, {})[bucket] = batch
        if any(m.pop(-1) != buckets for m in out.values()):
            raise ValueError(f"{root} has another number of buckets than {buckets}")
        return out

    def read(live: dict[int, int], wanted: list[int]) -> DataFrame:
        have = [b for b in wanted if b in live]
        return spark.read.schema(schema).parquet(*[data(live[b], b) for b in have]) if have else spark.createDataFrame([], schema)

    def step(batch: DataFrame, n: int) -> None:
        known = manifests()
        if n in known:
            return
        before = {k: m for k, m in known.items() if k < n}
        if n and not before:
            raise FileNotFoundError(f"{root} has no manifest before batch {n}")
        live = dict(before[max(before)]) if before else {}
        batch = contracts.guard(batch, schema).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = sorted(r[0] for r in batch.select("_bucket").distinct().collect())
        if touched:
            old = read(live, touched).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
            new = tables.upsert(old, tables.latest(batch, keys, [F.desc(order)]), keys, order)
            new.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/data/batch-{n}")
        batch.unpersist()
        now = live | {b: n for b in touched}
        spark.createDataFrame([(n, -1, buckets), *((n, b, k) for b, k in now.items())], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/manifest/batch-{n}")
        for k, m in before.items():
            if k != max(before):  # the one before stays, with its files, for those who read it
                for b, written in m.items():
                    if written not in (now.get(b), live.get(b)):
                        _delete(spark, data(written, b))
                _delete(spark, f"{root}/manifest/batch-{k}")

    rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    done = manifests()
    live = done[max(done)] if done else {}
    return read(live, sorted(live))


def quarantined(rows: DataFrame, checks: dict) -> DataFrame:
    """The rows that fail a check, with the names of the checks."""
    return contracts.split_valid(rows, checks)[1]
