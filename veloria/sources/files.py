"""Landed files and tables: catalogue and feed documents, asset listings, model runs, versioned tables, results.

Lists of catalogues and feeds are read in pieces by many tasks; a document of model runs, which is small, by one.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import contracts, jsonlists
from .scratch import kept, shared_path  # noqa: F401  also imported from here

LABELS = ("1phone-smallskin", "2phone-mobileskin", "3phone-bigskin", "4wallpaper-mobileskin", "5wallpaper-bigskin")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Heroes with their place ``hero_pos`` in the document; no list gives no rows. Documents are read in pieces."""
    entries = jsonlists.read_json_list(spark, path, "hero-list")
    return entries.select(F.col("pos").alias("hero_pos"), F.try_variant_get("entry", "$", contracts.HERO.simpleString()).alias("h")).select("hero_pos", "h.*")


def read_feed(spark: SparkSession, path: str, head: int = 0) -> DataFrame:
    """Raw feed entries as VARIANT with ``source_index`` from 1; ``head`` keeps the first entries by that number, 0 keeps all."""
    rows = jsonlists.read_json_list(spark, path, contracts.FEED_LIST).select((F.col("pos") + 1).alias("source_index"), F.col("entry").alias("raw"))
    return rows.where(F.col("source_index") <= head) if head > 0 else rows


def read_listing(spark: SparkSession, root: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(label, file_name) of the landed .jpg files; a label without a folder has none. File contents are not read."""
    out = spark.createDataFrame([], T.StructType([T.StructField("label", T.StringType()), T.StructField("file_name", T.StringType())]))
    for label in labels:
        try:
            files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[jJ][pP][gG]").load(f"{root}/{label}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        out = out.unionByName(files.select(F.lit(label).alias("label"), F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1)).alias("file_name")))
    return out


def read_model_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per model answer."""
    runs = spark.read.schema(contracts.MODEL_RUN).option("multiLine", True).json(path)
    return runs.select("image", F.explode("results").alias("r")).select("image", "r.*")


def write_json(df: DataFrame, path: str) -> None:
    """One compact line per row; nulls stay."""
    df.write.option("ignoreNullFields", False).mode("overwrite").json(path)


def append_cases(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("genre").parquet(path)


def new_version(df: DataFrame, root: str) -> str:
    """Write a table as a new version beside the old ones and return its path."""
    path = f"{root.rstrip('/')}/version-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def put_features(df: DataFrame, path: str) -> None:
    """Overwrite only the genres that ``df`` has."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("genre").parquet(path)


def page_title(html: Column) -> Column:
    return F.btrim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_text(html: Column) -> Column:
    """Visible text by plain rules: scripts, styles, comments and tags become blanks, blanks collapse."""
    out = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(out, "(?s)<[^>]*>", " "), r"\s+", " "))
