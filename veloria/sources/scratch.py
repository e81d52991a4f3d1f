"""Tables and folders of one run, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only where all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-veloria-")
    return f"{root.rstrip('/')}/veloria/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: for tables that several branches of a plan read."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table that ``kept`` wrote and nothing that is still to run reads."""
    where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.scratch)
    where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
