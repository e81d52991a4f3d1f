"""Schemas of the landed records and the checks against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()


def _struct(names: str, kind: T.DataType = _S) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names.split()]


HERO = T.StructType([*_struct("cname"), T.StructField("ename", T.IntegerType()), *_struct("id skinName"), T.StructField("skins", T.ArrayType(_S)), *_struct("heroType"), T.StructField("wallpaperBigskinUrl", T.ArrayType(_S))])
CATALOGUE = T.StructType([T.StructField("hero-list", T.ArrayType(HERO))])
#: The feed's keys, and the columns they become.
FEED_KEYS = {"pfidlb_3934": "skin_id", "yxmclb_9965": "hero_name", "pfmclb_7523": "skin_name", "pfpzlb_3289": "quality", "sxsjlb_1516": "online_date", "hqfs_8609": "acquire_method", "pcljlb_9272": "detail_url", "mdljlb_1924": "mobile_url", "spvidl_6663": "video_id", "yjhjsl_5003": "intro"}
FEED_IMAGES = ("fmlb_4536", "fmb1lb_5300", "yxtxlb_8443")
FEED_LIST = "pflb20_3469"
FEED = T.StructType([T.StructField(FEED_LIST, T.ArrayType(T.StructType(_struct(" ".join([*FEED_KEYS, *FEED_IMAGES])))))])
SKINS = T.StructType([*_struct("source_key"), T.StructField("source_index", T.IntegerType()), *_struct("skin_id hero_name skin_name quality online_date acquire_method price_text image_url image_path detail_url mobile_url video_id intro raw_json"), T.StructField("updated_at", T.TimestampType())])
REQUIRED_TOP = ("description", "hero-list", "phone-smallskin-images", "phone-mobileskin-images", "phone-bigskin-images", "wallpaper-mobileskin-images", "wallpaper-bigskin-images")
REQUIRED_HERO = ("cname", "ename", "id", "skinName", "skins", "heroType")
MODEL_RUN = T.StructType([*_struct("image prompt"), T.StructField("results", T.ArrayType(T.StructType([*_struct("model status"), T.StructField("elapsed_seconds", T.DoubleType()), *_struct("response hint error")])))])


class SchemaDrift(ValueError):
    """A table lacks columns of its contract."""


def guard(df: DataFrame, contract: T.StructType) -> DataFrame:
    """``df`` itself if it has every column of the contract with its type; nothing is ever dropped or rebuilt in place."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in contract if have.get(f.name) != f.dataType]
    if wrong:
        raise SchemaDrift(f"missing or of another type: {', '.join(wrong)}")
    return df


def missing_keys(json: Column, required: tuple[str, ...]) -> Column:
    """Keys that a JSON object text lacks; null values count as present."""
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")))


def split_valid(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all checks, quarantined rows with the array ``failed`` of check names)."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    marked = df.withColumn("failed", failed)
    return marked.where(F.size("failed") == 0).drop("failed"), marked.where(F.size("failed") > 0)
