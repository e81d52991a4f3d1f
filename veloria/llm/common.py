"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: One word: a run of characters that are neither space nor the controls 9-13.
WORD_CLASS = r"[^\x20\x09-\x0D]+"
GAP_CLASS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all runs on one machine (tests) a temporary folder of this machine is set; on a
    cluster a missing setting is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.conf.get("veloria.local.scratch", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-veloria-")
        spark.conf.set("veloria.local.scratch", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/veloria/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and nothing that is still to run reads."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(table.scratch)
        where.getFileSystem(conf).delete(where, True)


def running_base(df: DataFrame, keys: list[str], order: str, size: str, block: str) -> DataFrame:
    """Exclusive running sum ``base`` of ``size`` by ``order`` within ``keys``, in two levels.

    ``block`` is a column that is monotone in ``order`` and cuts each key into bounded pieces, so no task sorts a whole
    key. The second level has one row per key and block.
    """
    inner = W.partitionBy(*keys, block).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    names = {k: f"_b{i}" for i, k in enumerate([*keys, block])}
    blocks = df.groupBy(*[F.col(k).alias(n) for k, n in names.items()]).agg(F.sum(size).alias("_block_size"))
    outer = W.partitionBy(*[names[k] for k in keys]).orderBy(names[block]).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(*names.values(), F.coalesce(F.sum("_block_size").over(outer), F.lit(0)).alias("_block_base"))
    on = F.lit(True)
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    joined = df.join(blocks.hint("merge"), on, "left").drop(*names.values())
    own = F.coalesce(F.sum(size).over(inner), F.lit(0))
    return joined.withColumn("base", (F.col("_block_base") + own).cast("long")).drop("_block_base")


def word_count(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")
