"""Catalogue operators: lookups, searches, statistics, assets and their coverage, validation, feed normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes, text
from ..sources import contracts


def lookup(heroes: DataFrame, key: str, value) -> DataFrame:
    """The hero with a key's value: the last of duplicates wins, none gives no row."""
    cols = [c for c in heroes.columns]
    found = heroes.where(F.col(key) == F.lit(value)).groupBy(key).agg(F.max_by(F.struct(*cols), "hero_pos").alias("h"))
    return found.select("h.*")


def heroes_by_type(heroes: DataFrame, kind: str) -> DataFrame:
    return heroes.where(F.col("heroType") == kind)


def search_skin(hero_skins: DataFrame, needle: str) -> DataFrame:
    """Case-sensitive substring search; an empty needle matches all. ``first_pos`` orders by the skin name's first hero."""
    first = hero_skins.groupBy("skin").agg(F.min(F.struct("hero_pos", "skin_index")).alias("f")).select(F.col("skin").alias("_skin"), F.col("f.hero_pos").alias("first_pos"))
    hits = hero_skins.where(F.col("skin").contains(needle))
    return hits.join(first.hint("merge"), F.col("skin") == F.col("_skin")).drop("_skin")


def inverted_index(hero_skins: DataFrame) -> DataFrame:
    """Skin name to the (hero, index) places it stands at, in catalogue order."""
    return hero_skins.groupBy("skin").agg(F.array_sort(F.collect_list(F.struct("hero_pos", "cname", "skin_index"))).alias("places"))


def totals(heroes: DataFrame) -> DataFrame:
    """Heroes, skins and the mean number of skins to one decimal, half to even; 0 for no heroes."""
    n = F.coalesce(F.sum(F.when(F.col("skins").isNotNull(), F.size("skins")).otherwise(0)), F.lit(0)).cast("long")
    out = heroes.agg(F.count(F.lit(1)).alias("heroes"), n.alias("skins"))
    return out.withColumn("mean_skins", F.coalesce(F.bround(F.try_divide(F.col("skins").cast("double"), F.col("heroes")), 1), F.lit(0.0)))


def type_counts(heroes: DataFrame) -> DataFrame:
    """Heroes per type with the place of the type's first hero, for a ranking with first-seen ties."""
    return heroes.groupBy(F.coalesce("heroType", F.lit(codes.UNKNOWN_TYPE)).alias("hero_type")).agg(F.count(F.lit(1)).alias("heroes"), F.min("hero_pos").alias("first_pos"))


def skin_histogram(heroes: DataFrame) -> DataFrame:
    return heroes.groupBy(F.when(F.col("skins").isNull(), 0).otherwise(F.size("skins")).cast("long").alias("skins")).agg(F.count(F.lit(1)).alias("heroes"))


def top_heroes(heroes: DataFrame, n: int) -> DataFrame:
    """Most skins first, ties in catalogue order; the limit is the feature."""
    return heroes.select("cname", F.size("skins").cast("long").alias("skins"), "hero_pos").orderBy(F.desc("skins"), "hero_pos").limit(n)


def validate_heroes(records: DataFrame, json: str) -> DataFrame:
    """(record_id, error) for each required key that a hero record lacks and each count that disagrees."""
    lacking = contracts.missing_keys(F.col(json), contracts.REQUIRED_HERO)
    names = F.get_json_object(json, "$.skinName")
    listed = F.size(F.from_json(F.get_json_object(json, "$.skins"), T.ArrayType(T.StringType())))
    unequal = (names != "") & (listed > 0) & (text.pipe_count(names) != listed)
    errors = F.concat(F.transform(lacking, lambda k: F.concat(F.lit("missing "), k)), F.when(F.coalesce(unequal, F.lit(False)), F.array(F.lit("count differs"))).otherwise(F.array().cast("array<string>")))
    return records.select("record_id", F.explode(errors).alias("error"))


def validate_catalogue(records: DataFrame, json: str) -> DataFrame:
    """(record_id, error) for each required top-level key that a catalogue document lacks, and for one without heroes."""
    lacking = F.transform(contracts.missing_keys(F.col(json), contracts.REQUIRED_TOP), lambda k: F.concat(F.lit("missing "), k))
    heroes = F.from_json(F.get_json_object(json, "$['hero-list']"), T.ArrayType(T.StringType()))
    none = F.coalesce(F.size(heroes), F.lit(0)) <= 0
    errors = F.concat(lacking, F.when(none, F.array(F.lit("no heroes"))).otherwise(F.array().cast("array<string>")))
    return records.select("record_id", F.explode(errors).alias("error"))


def summary_of(errors: DataFrame) -> DataFrame:
    return errors.agg(F.count(F.lit(1)).alias("errors"), F.count_distinct("record_id").alias("records"), (F.count(F.lit(1)) == 0).alias("passed"))


def missing_assets(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected file names that are not there, each once."""
    return expected.select("file_name").distinct().join(present.select("file_name").distinct().hint("merge"), "file_name", "left_anti")


def extra_assets(expected: DataFrame, present: DataFrame) -> DataFrame:
    return missing_assets(present, expected)


def coverage(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Per hero with skins: expected and found assets and the bucket full, partial or none."""
    have = present.select("file_name").distinct().withColumn("_found", F.lit(1))
    per = expected.select("cname", "file_name").join(have.hint("merge"), "file_name", "left").groupBy("cname").agg(F.count(F.lit(1)).alias("expected"), F.count("_found").alias("found"))
    bucket = F.when(F.col("found") == F.col("expected"), "full").when(F.col("found") > 0, "partial").otherwise("none")
    return per.where("expected > 0").withColumn("bucket", bucket)


def feed_value(raw: Column, key: str) -> Column:
    """A raw entry's value as text: '' where the key is absent, null where it is null."""
    found = F.try_variant_get(raw, f"$.{key}", "variant")
    return F.when(found.isNull(), F.lit("")).when(F.is_variant_null(found), F.lit(None)).otherwise(F.try_variant_get(raw, f"$.{key}", "string"))


def normalise_feed(feed: DataFrame) -> DataFrame:
    """Raw feed entries to the columns of the skins table, but for image path and time; raw_json has all that was landed, nulls too, keys in order."""
    raw = lambda k: feed_value(F.col("raw"), k)
    out = feed.select("source_index", *[raw(k).alias(n) for k, n in contracts.FEED_KEYS.items()], text.first_filled(*map(raw, contracts.FEED_IMAGES)).alias("image_url"), F.to_json("raw").alias("raw_json"))
    return out.withColumn("price_text", text.price_text(F.col("acquire_method"))).withColumn("source_key", text.source_key(F.col("source_index"), F.col("skin_id")))


def attach_assets(skins: DataFrame, listing: DataFrame) -> DataFrame:
    """Landed image paths by file name; a missing image leaves a null path and keeps the row."""
    name = text.asset_file(F.col("source_index"), F.col("skin_id"), F.col("hero_name"), F.col("skin_name"), F.col("image_url"))
    files = listing.select(F.col("file_name").alias("image_path")).distinct()
    return skins.withColumn("_name", name).join(files.hint("merge"), F.col("_name") == F.col("image_path"), "left").drop("_name")


def run_summary(skins: DataFrame) -> DataFrame:
    return skins.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("image_path").isNotNull()).alias("landed"), F.count_if(F.col("image_path").isNull()).alias("failed"))


def model_summary(answers: DataFrame, known: list[str], parsed: Column) -> DataFrame:
    """Per model: answers by status (unknown models are missing), mean and median latency to 2 decimals."""
    models = answers.sparkSession.createDataFrame([(m,) for m in known], "known string")
    rows = answers.withColumn("parsed", parsed.isNotNull()).join(F.broadcast(models), F.col("model") == F.col("known"), "left")
    status = F.when(F.col("known").isNull(), "missing").when(F.col("parsed"), "ok").otherwise("error")
    rows = rows.withColumn("status", status)
    return rows.groupBy("model").agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "error").alias("error"), F.bool_or(F.col("status") == "ok").alias("any_ok"),
        F.bround(F.avg("elapsed"), 2).alias("mean_seconds"), F.round(F.median("elapsed"), 4).alias("median_seconds"),
    )
