"""Registered queries over the catalogue, its assets, the feed and stored model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, jsonish, text
from ..operators import catalog, clean, tables
from ..sources import adapters as A
from ..sources import contracts, files
from ..sources.files import kept


def _nested(spark: SparkSession, d: str) -> DataFrame:
    return A.heroes(spark, d)


def _flat(spark: SparkSession, d: str) -> DataFrame:
    return A.hero_skins(A.heroes(spark, d))


def _expected(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d).select("cname", "hero_pos", text.expected_asset(F.col("cname"), F.col("skin_index"), F.col("skin")).alias("file_name"))


def _present(spark: SparkSession, d: str) -> DataFrame:
    rows = _flat(spark, d)
    own = rows.where(F.col("skin_index") % 7 != 0).select(text.expected_asset(F.col("cname"), F.col("skin_index"), F.col("skin")).alias("file_name"))
    extra = A.skins(spark, d).where("skin_id % 50 = 0").select(F.concat(F.lit("extra-"), F.col("skin_id").cast("string"), F.lit(".jpg")).alias("file_name"))
    return own.unionByName(extra)


EXPECTED = A.HERO_SKINS + """, expected AS (SELECT cname, cname || '-' || skin_index || '-' || skin || '.jpg' AS file_name FROM hero_skins),
present AS (SELECT cname || '-' || skin_index || '-' || skin || '.jpg' AS file_name FROM hero_skins WHERE skin_index % 7 <> 0 UNION ALL SELECT 'extra-' || skin_id || '.jpg' FROM skins WHERE skin_id % 50 = 0)"""


def catalog_stats(spark, d):
    return catalog.totals(_nested(spark, d))


def type_counts(spark, d):
    return catalog.type_counts(_nested(spark, d)).select("hero_type", "heroes")


def type_ranking(spark, d):
    return catalog.type_counts(_nested(spark, d)).orderBy(F.desc("heroes"), "first_pos")


def skin_histogram(spark, d):
    return catalog.skin_histogram(_nested(spark, d)).orderBy("skins")


def top_heroes(spark, d):
    return catalog.top_heroes(_nested(spark, d), 10)


def lookup_by_name(spark, d):
    return catalog.lookup(_nested(spark, d), "cname", "Brand#7").select("cname", "ename", "heroType", "hero_pos")


def lookup_by_code(spark, d):
    return catalog.lookup(_nested(spark, d), "ename", 12).select("cname", "ename", "heroType", "hero_pos")


def lookup_by_id(spark, d):
    by_id = _nested(spark, d).withColumn("id", F.col("hero_pos"))
    return catalog.lookup(by_id, "id", 3).select("cname", "ename", "heroType", "hero_pos")


def heroes_by_type(spark, d):
    return catalog.heroes_by_type(_nested(spark, d), "mage").select("cname", "heroType", F.size("skins").alias("skins"))


def search_skin(spark, d):
    return catalog.search_skin(_flat(spark, d), "ring").select("cname", "heroType", "skin", "skin_index", "total", "url", "first_pos")


def hero_skins(spark, d):
    return A.skins(spark, d).where(F.col("hero_name") == "Brand#3").select("skin_id", "hero_name", "skin_name", "official_tier")


def skin_index(spark, d):
    return catalog.inverted_index(_flat(spark, d)).select("skin", F.size("places").alias("heroes"), F.col("places")[0]["cname"].alias("first_hero"))


def asset_missing(spark, d):
    return catalog.missing_assets(_expected(spark, d), _present(spark, d))


def asset_extra(spark, d):
    return catalog.extra_assets(_expected(spark, d), _present(spark, d))


def asset_preview(spark, d):
    """The first 20 missing and the first 10 extra names; the limits are the feature."""
    missing = asset_missing(spark, d).orderBy("file_name").limit(20).withColumn("kind", F.lit("missing"))
    return missing.unionByName(asset_extra(spark, d).orderBy("file_name").limit(10).withColumn("kind", F.lit("extra")))


def asset_coverage(spark, d):
    return catalog.coverage(_expected(spark, d), _present(spark, d))


def coverage_buckets(spark, d):
    return asset_coverage(spark, d).groupBy("bucket").agg(F.count(F.lit(1)).alias("heroes"))


def asset_counts(spark, d):
    labels = spark.createDataFrame([(x,) for x in files.LABELS], "label string")
    flat = _flat(spark, d).select(F.get(F.array(*map(F.lit, files.LABELS[:4])), F.col("skin_index") % 5).alias("label"))
    return labels.join(flat.groupBy("label").agg(F.count(F.lit(1)).alias("n")).hint("merge"), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("images"))


def asset_difference(spark, d):
    """Both differences as sets."""
    e, p = _expected(spark, d).select("file_name"), _present(spark, d).select("file_name")
    return e.subtract(p).withColumn("side", F.lit("missing")).unionByName(p.subtract(e).withColumn("side", F.lit("extra")))


def distinct_names(spark, d):
    return A.skins(spark, d).select("skin_name").distinct()


def name_split_check(spark, d):
    rows = _nested(spark, d)
    return rows.select("cname", text.pipe_count(F.coalesce("skinName", F.lit(""))).alias("named"), F.size("skins").alias("listed")).withColumn("equal", F.col("named") == F.col("listed"))


def _records(spark, d):
    """Hero records as JSON text, some without a key, some with a null."""
    h = _nested(spark, d)
    skins = F.to_json("skins")
    base = F.concat(F.lit('"cname":"'), F.col("cname"), F.lit('","id":'), F.col("hero_pos").cast("string"), F.lit(',"skinName":"'), F.coalesce("skinName", F.lit("")), F.lit('","skins":'), skins)
    json = F.concat(F.lit("{"), base, F.when(F.col("ename") % 3 != 0, F.lit(',"ename":1')).otherwise(F.lit("")), F.when(F.col("ename") % 4 == 0, F.lit(',"heroType":null')).when(F.col("ename") % 4 == 1, F.lit("")).otherwise(F.lit(',"heroType":"x"')), F.lit("}"))
    return h.select(F.col("hero_pos").alias("record_id"), json.alias("json"))


def validate_records(spark, d):
    return catalog.validate_heroes(_records(spark, d), "json")


def validation_summary(spark, d):
    return catalog.summary_of(validate_records(spark, d))


def error_preview(spark, d):
    """The first ten errors and how many there are in all."""
    errors = validate_records(spark, d)
    everything = errors.agg(F.count(F.lit(1)).alias("errors"))
    return errors.orderBy("record_id", "error").limit(10).join(F.broadcast(everything))


ERRORS = A.HEROES + """, lacking AS (SELECT hero_pos AS record_id, unnest(list_concat(CASE WHEN ename % 3 = 0 THEN ['missing ename'] ELSE [] END, CASE WHEN ename % 4 = 1 THEN ['missing heroType'] ELSE [] END,
  CASE WHEN coalesce(skinName, '') <> '' AND len(string_split(skinName, '|')) <> len(skins) THEN ['count differs'] ELSE [] END)) AS error FROM heroes)"""


def safe_names(spark, d):
    raw = F.concat(F.lit(" .a/b:"), F.col("url"), F.lit("?  x\ty. "))
    return A.table(spark, d, "pages").select("page_id", text.safe_name(raw).alias("name"))


def url_extension(spark, d):
    return A.table(spark, d, "pages").select("page_id", text.url_suffix(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("//h.com/a/B"), F.col("page_id").cast("string"), F.lit(".PNG?x=1"))).otherwise(F.col("url"))).alias("suffix"))


def price_text(spark, d):
    rows = A.feed(spark, d).select("source_index", text.price_text(catalog.feed_value(F.col("raw"), "hqfs_8609")).alias("price_text"))
    return rows.select("source_index", "price_text", text.price_amount(F.col("price_text")).alias("amount"), text.price_unit(F.col("price_text")).alias("unit"))


def source_key(spark, d):
    return A.feed(spark, d).select("source_index", text.source_key(F.col("source_index") * 7, catalog.feed_value(F.col("raw"), "pfidlb_3934")).alias("source_key"))


def feed_normalize(spark, d):
    return catalog.normalise_feed(A.feed(spark, d)).select("source_key", "source_index", "skin_id", "hero_name", "skin_name", "quality", "online_date", "acquire_method", "detail_url", "image_url", "price_text")


_DOCUMENT_KEYS = {key: n for n, key in enumerate((k for k in contracts.REQUIRED_TOP if k != "hero-list"), 3)}


def catalogue_documents(spark, d):
    """What catalogue documents lack at their top level: documents of one hero each, some without a key or without heroes."""
    k = F.col("c_custkey")
    heroes = F.when(k % 5 == 0, F.lit(',"hero-list":[]')).when(k % 7 != 0, F.concat(F.lit(',"hero-list":[{"cname":"'), F.col("c_name"), F.lit('"}]'))).otherwise(F.lit(""))
    rest = [F.when(k % n != 0, F.lit(f',"{key}":[]')).otherwise(F.lit("")) for key, n in _DOCUMENT_KEYS.items()]
    documents = A.table(spark, d, "customer").select(k.alias("record_id"), F.concat(F.lit('{"version":1'), heroes, *rest, F.lit("}")).alias("json"))
    return catalog.validate_catalogue(documents, "json")


def feed_raw(spark, d):
    """What was landed of each entry: null and absent cells differ, unknown keys stay."""
    rows = catalog.normalise_feed(A.feed(spark, d))
    return rows.select("source_index", "quality", "acquire_method", "detail_url", "raw_json")


def _landed(spark, d):
    rows = catalog.normalise_feed(A.feed(spark, d))
    name = text.asset_file(F.col("source_index"), F.col("skin_id"), F.col("hero_name"), F.col("skin_name"), F.col("image_url"))
    listing = rows.where(F.col("source_index") % 9 != 0).select(name.alias("file_name"))
    return catalog.attach_assets(rows, listing)


def feed_assets(spark, d):
    return _landed(spark, d).select("source_index", "image_path")


def feed_summary(spark, d):
    return catalog.run_summary(_landed(spark, d))


def feed_head(spark, d):
    """The first 100 entries by number."""
    return A.feed(spark, d).where(F.col("source_index") <= 100).select("source_index", catalog.feed_value(F.col("raw"), "pfmclb_7523").alias("skin_name"))


def feed_preview(spark, d):
    """Four columns of the first ten rows, with the number of all."""
    rows = catalog.normalise_feed(A.feed(spark, d))
    return rows.select("source_index", "hero_name", "skin_name", "price_text").orderBy("source_index").limit(10).join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("rows"))))


def lenient_json(spark, d):
    rows = A.answers(spark, d).withColumn("v", jsonish.lenient_json(F.col("response")))
    return rows.select("skin_id", F.col("v").isNotNull().alias("parsed"), jsonish.text_at(F.col("v"), "$.rarity_tier").alias("tier"), jsonish.number_at(F.col("v"), "$.model_detail").alias("detail"))


def model_run_summary(spark, d):
    return catalog.model_summary(A.answers(spark, d), ["vl-a", "vl-b"], jsonish.lenient_json(F.col("response")))


def _vision(spark, d):
    """Typed fields of the answers that parse, under the names of the feature vector; each answer is parsed once, in tasks of a number of its own, and written."""
    text_at, number_at = jsonish.text_at, jsonish.number_at

    def fields(v):
        colours = F.try_variant_get(v, "$.dominant_colors", "array<string>")
        return F.struct(
            text_at(v, "$.rarity_tier").alias("tier"), text_at(v, "$.scene_type").alias("scene"), number_at(v, "$.character_ratio").alias("ratio"), text_at(v, "$.effect_density").alias("density"), colours.alias("colours"),
            number_at(v, "$.model_detail").alias("vlm_art_quality"), number_at(v, "$.effect_quality").alias("vlm_effect_score"), (number_at(v, "$.color_scheme") / 10).alias("vlm_color_harmony"),
            number_at(v, "$.composition").alias("vlm_composition"), text_at(v, "$.similar").alias("similar"),
        )

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = A.answers(spark, d).repartition(tasks, "skin_id")  # one small file of items is one task's input
    parsed = rows.select("skin_id", "hero_name", jsonish.once(jsonish.lenient_json(F.col("response")), lambda v: F.when(v.isNotNull(), fields(v))).alias("v"))
    return kept(parsed, "vision").where("v IS NOT NULL").select("skin_id", "hero_name", "v.*")


PARSED = A.ANSWERS + """, vision AS (SELECT skin_id, hero_name, ['勇者','史诗','传说','无双','荣耀典藏','?'][skin_id % 6 + 1] AS tier, ['low','mid','high','extreme'][skin_id % 4 + 1] AS density, CAST((skin_id % 12) || 'e-1' AS DOUBLE) AS ratio,
  '#' || lower(lpad(printf('%x', skin_id * 7919 % 16777216), 6, '0')) AS colour, skin_id % 10 + 0.5::DOUBLE AS art, skin_id % 9 + 0.25::DOUBLE AS effect, skin_id % 7 / 10.0::DOUBLE AS harmony, CAST(skin_id % 8 AS DOUBLE) AS composition
  FROM answers WHERE skin_id % 5 < 3)"""


def vision_fields(spark, d):
    return _vision(spark, d).select("skin_id", "vlm_art_quality", "vlm_effect_score", "vlm_color_harmony", "vlm_composition")


def quarantine(spark, d):
    fine = jsonish.in_domain(F.col("tier"), F.col("scene"), F.col("ratio"), F.col("density"), F.col("colours"), codes.TIERS[1:])
    good, bad = contracts.split_valid(_vision(spark, d), {"domain": fine, "detail": F.col("vlm_art_quality") >= 1})
    return good.select("skin_id", F.lit("").alias("failed")).unionByName(bad.select("skin_id", F.array_join("failed", ",").alias("failed")))


def palette(spark, d):
    """The five most frequent colours of each hero, ties by colour."""
    counts = _vision(spark, d).select("hero_name", F.explode("colours").alias("colour")).groupBy("hero_name", "colour").agg(F.count(F.lit(1)).alias("uses"))
    from ..operators.similar import top

    rgb = codes.hex_colour(F.col("colour"))
    return top(counts, ["hero_name"], [F.desc("uses"), F.col("colour")], 5).select("hero_name", "place", "colour", "uses", rgb["red"].alias("red"), rgb["green"].alias("green"), rgb["blue"].alias("blue"))


def similar_resolved(spark, d):
    """Named similar skins found in the catalogue: how many items bear the name."""
    named = _vision(spark, d).select("skin_id", F.regexp_extract("similar", "^([^-]*)-", 1).alias("hero_name"), F.regexp_extract("similar", "^[^-]*-(.*)$", 1).alias("skin_name"))
    known = A.skins(spark, d).groupBy("hero_name", "skin_name").agg(F.count(F.lit(1)).alias("items"))
    return named.join(known, ["hero_name", "skin_name"], "left").select("skin_id", F.coalesce("items", F.lit(0)).alias("items"))


def code_maps(spark, d):
    rows = A.skins(spark, d)
    label = codes.label_of(F.col("official_tier"), codes.TIERS)
    method = codes.label_of(F.col("skin_id") % 6, codes.ACQUISITION)
    density = codes.label_of(F.col("skin_id") % 5, codes.DENSITIES)
    return rows.select("skin_id", label.alias("tier_label"), codes.code_of(label, codes.TIERS).alias("tier"), codes.code_of(method, codes.ACQUISITION).alias("method"), codes.mapped(method, codes.ACQUISITION_SCORES).alias("method_score"), codes.code_of(density, codes.DENSITIES).alias("density"))


def harmonised(spark, d):
    """Quality text to tier, price text to amount with points at a given rate, date text to date."""
    rows = feed_normalize(spark, d)
    amount = text.price_amount(F.col("price_text")) * F.when(text.price_unit(F.col("price_text")) == "点券", F.lit(0.1)).otherwise(F.lit(1.0))
    return rows.select("source_index", F.col("quality").try_cast("int").alias("tier"), F.round(amount, 4).alias("amount"), F.try_to_date("online_date", "yyyy-MM-dd").alias("online"))


def page_text(spark, d):
    return A.table(spark, d, "pages").select("page_id", files.page_title(F.col("html")).alias("title"), F.length(files.page_text(F.col("html"))).alias("n_chars"))


def clean_dedup(spark, d):
    return clean.deduplicated(clean.cleaned(A.table(spark, d, "documents"))).select("doc_id", "n_chars")


def source_union(spark, d):
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    talk = A.table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "text")
    return clean.tagged_union({"forum": docs, "chat": talk}).groupBy("origin").agg(F.count(F.lit(1)).alias("rows"), F.count("lang").alias("with_lang"))


def orphans(spark, d):
    parts = A.skins(spark, d).where("skin_id % 97 <> 0")
    return A.listings(spark, d).select("skin_id").join(parts.select("skin_id"), "skin_id", "left_anti").distinct()


def upsert_latest(spark, d):
    """The newest listing of each item as the catalogue's price."""
    rows = A.listings(spark, d).withColumn("order_no", F.struct("listed_at", "price", "flag"))
    old = rows.where("listed_at < '1998-01-01'")
    return tables.upsert(old, rows.where("listed_at >= '1998-01-01'"), ["skin_id"], "order_no", contract=old.schema).select("skin_id", "price", "listed_at", "flag")


def hero_upsert(spark, d):
    """Heroes with the time of their last event, from the table of the even events and an upsert of the others; a later old row stays."""
    rows = A.hero_events(spark, d).select("hero_name", "ts", "event_id")
    latest = lambda part: part.groupBy("hero_name").agg(F.max("ts").alias("ts"))
    old, new = latest(rows.where("event_id % 2 = 0")), latest(rows.where("event_id % 2 = 1"))
    later = new.join(old.withColumnRenamed("ts", "_old"), "hero_name", "left").where("_old IS NULL OR ts >= _old").drop("_old")
    return tables.upsert(old, later, ["hero_name"], "ts", contract=old.schema).select("hero_name", text.stamp(F.col("ts")).alias("updated_at"))


def duplicate_keys(spark, d):
    return tables.duplicate_keys(A.skins(spark, d), ["hero_name", "skin_name"])


def catalog_diff(spark, d):
    old = A.skins(spark, d).where("skin_id % 10 <> 0").select("skin_id", "hero_name", "skin_name", "official_price")
    new = A.skins(spark, d).where("skin_id % 11 <> 0").withColumn("official_price", F.col("official_price") + F.when(F.col("skin_id") % 7 == 0, 1.0).otherwise(0.0)).select("skin_id", "hero_name", "skin_name", "official_price")
    return tables.difference(old, new, "skin_id")


def incremental_read(spark, d):
    """Events after a mark, and whether the hero's record is stale 10 days before the end of the data."""
    rows = A.hero_events(spark, d)
    newer = tables.since(rows, "ts", F.lit("2024-01-20").cast("timestamp_ntz")).groupBy("hero_name").agg(F.count(F.lit(1)).alias("rows"))
    first = rows.groupBy("hero_name").agg(F.min("ts").alias("first"))
    return newer.join(first, "hero_name").select("hero_name", "rows", tables.stale("first", F.lit("2024-01-31 12:00:00").cast("timestamp_ntz"), 30).alias("stale"))


QUERIES = {f.__name__: f for f in (
    catalog_stats, type_counts, type_ranking, skin_histogram, top_heroes, lookup_by_name, lookup_by_code, lookup_by_id, heroes_by_type, search_skin, hero_skins, skin_index, asset_missing, asset_extra, asset_preview, asset_coverage, coverage_buckets,
    asset_counts, asset_difference, distinct_names, name_split_check, validate_records, validation_summary, error_preview, safe_names, url_extension, price_text, source_key, feed_normalize, feed_raw, feed_assets, catalogue_documents, feed_summary, feed_head, feed_preview, lenient_json, model_run_summary,
    vision_fields, quarantine, palette, similar_resolved, code_maps, harmonised, page_text, clean_dedup, source_union, orphans, upsert_latest, hero_upsert, duplicate_keys, catalog_diff, incremental_read,
)}

_SAFE = r"""left(CASE WHEN {0} = '' THEN 'unknown' ELSE {0} END, 140)"""
_CLEAN = r"""regexp_replace(trim(regexp_replace({0}, '[\\/:*?"<>|\r\n\t]+', '_', 'g'), ' .'), '\s+', ' ', 'g')"""
_PRICE = r"regexp_extract_all(coalesce(acquire, ''), '[0-9]+(?:\.[0-9]+)?\s*(?:点券|荣耀积分|皮肤碎片)')"
_PRICE_TEXT = f"CASE WHEN len({_PRICE}) > 0 THEN array_to_string({_PRICE}, ' / ') END"
_IMAGE = "CASE WHEN image_b <> '' THEN image_b ELSE image_c END"
_SUFFIX = "CASE WHEN skin_id0 % 3 = 0 THEN '.png' ELSE '.jpg' END"
_NORMAL = A.FEED + f", normal AS (SELECT *, {_PRICE_TEXT} AS price_text, coalesce(nullif({_IMAGE}, ''), '') AS image_url, printf('%04d-%s', source_index, id) AS source_key, source_index - 1 AS skin_id0 FROM feed)"
_FILE = _SAFE.format(_CLEAN.format("source_key || '-' || hero_name || '-' || skin_name")) + f" || {_SUFFIX}"
_AMOUNT = r"TRY_CAST(nullif(regexp_extract(price_text, '([0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE)"
_UNIT = r"nullif(regexp_extract(price_text, '[0-9]+(?:\.[0-9]+)?\s*(点券|荣耀积分|皮肤碎片)', 1), '')"

SQL = {
    "catalogue_documents": " UNION ALL ".join(
        [f"SELECT c_custkey AS record_id, 'missing {key}' AS error FROM customer WHERE c_custkey % {n} = 0" for key, n in _DOCUMENT_KEYS.items()]
        + ["SELECT c_custkey, 'missing hero-list' FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 5 <> 0", "SELECT c_custkey, 'no heroes' FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 5 = 0"]
    ),
    "catalog_stats": f"WITH {A.HEROES} SELECT count(*) AS heroes, CAST(sum(len(skins)) AS BIGINT) AS skins, round_even(sum(len(skins)) / count(*), 1) AS mean_skins FROM heroes",
    "type_counts": f"WITH {A.HEROES} SELECT coalesce(heroType, '未知') AS hero_type, count(*) AS heroes FROM heroes GROUP BY 1",
    "type_ranking": f"WITH {A.HEROES} SELECT coalesce(heroType, '未知') AS hero_type, count(*) AS heroes, min(hero_pos) AS first_pos FROM heroes GROUP BY 1 ORDER BY 2 DESC, 3",
    "skin_histogram": f"WITH {A.HEROES} SELECT len(skins) AS skins, count(*) AS heroes FROM heroes GROUP BY 1 ORDER BY 1",
    "top_heroes": f"WITH {A.HEROES} SELECT cname, len(skins) AS skins, hero_pos FROM heroes ORDER BY 2 DESC, 3 LIMIT 10",
    "lookup_by_name": f"WITH {A.HEROES} SELECT cname, ename, heroType, hero_pos FROM heroes WHERE cname = 'Brand#7'",
    "lookup_by_code": f"WITH {A.HEROES} SELECT cname, ename, heroType, hero_pos FROM heroes WHERE ename = 12",
    "lookup_by_id": f"WITH {A.HEROES} SELECT cname, ename, heroType, hero_pos FROM heroes WHERE hero_pos = 3",
    "heroes_by_type": f"WITH {A.HEROES} SELECT cname, heroType, CAST(len(skins) AS INTEGER) AS skins FROM heroes WHERE heroType = 'mage'",
    "search_skin": f"WITH {A.HERO_SKINS} SELECT cname, heroType, skin, skin_index, total, urls[skin_index] AS url, min(hero_pos) OVER (PARTITION BY skin) AS first_pos FROM hero_skins WHERE contains(skin, 'ring')",
    "hero_skins": f"WITH {A.SKINS} SELECT skin_id, hero_name, skin_name, official_tier FROM skins WHERE hero_name = 'Brand#3'",
    "skin_index": f"WITH {A.HERO_SKINS} SELECT skin, CAST(count(*) AS INTEGER) AS heroes, arg_min(cname, (hero_pos, skin_index)) AS first_hero FROM hero_skins GROUP BY skin",
    "asset_missing": f"WITH {EXPECTED} SELECT DISTINCT file_name FROM expected WHERE file_name NOT IN (SELECT file_name FROM present)",
    "asset_extra": f"WITH {EXPECTED} SELECT DISTINCT file_name FROM present WHERE file_name NOT IN (SELECT file_name FROM expected)",
    "asset_preview": f"WITH {EXPECTED} (SELECT DISTINCT file_name, 'missing' AS kind FROM expected WHERE file_name NOT IN (SELECT file_name FROM present) ORDER BY 1 LIMIT 20) UNION ALL (SELECT DISTINCT file_name, 'extra' FROM present WHERE file_name NOT IN (SELECT file_name FROM expected) ORDER BY 1 LIMIT 10)",
    "asset_coverage": f"WITH {EXPECTED}, c AS (SELECT cname, count(*) AS expected, count(*) FILTER (WHERE file_name IN (SELECT file_name FROM present)) AS found FROM expected GROUP BY 1) SELECT *, CASE WHEN found = expected THEN 'full' WHEN found > 0 THEN 'partial' ELSE 'none' END AS bucket FROM c",
    "coverage_buckets": f"WITH {EXPECTED}, c AS (SELECT cname, count(*) AS expected, count(*) FILTER (WHERE file_name IN (SELECT file_name FROM present)) AS found FROM expected GROUP BY 1) SELECT CASE WHEN found = expected THEN 'full' WHEN found > 0 THEN 'partial' ELSE 'none' END AS bucket, count(*) AS heroes FROM c GROUP BY 1",
    "asset_counts": f"WITH {A.HERO_SKINS}, l AS (SELECT unnest(['1phone-smallskin','2phone-mobileskin','3phone-bigskin','4wallpaper-mobileskin','5wallpaper-bigskin']) AS label) SELECT label, count(skin) AS images FROM l LEFT JOIN hero_skins ON label = ['1phone-smallskin','2phone-mobileskin','3phone-bigskin','4wallpaper-mobileskin'][skin_index % 5 + 1] GROUP BY 1",
    "asset_difference": f"WITH {EXPECTED} SELECT file_name, 'missing' AS side FROM (SELECT file_name FROM expected EXCEPT SELECT file_name FROM present) UNION ALL SELECT file_name, 'extra' FROM (SELECT file_name FROM present EXCEPT SELECT file_name FROM expected)",
    "distinct_names": f"WITH {A.SKINS} SELECT DISTINCT skin_name FROM skins",
    "name_split_check": f"WITH {A.HEROES} SELECT cname, CAST(len(string_split(coalesce(skinName, ''), '|')) AS INTEGER) AS named, CAST(len(skins) AS INTEGER) AS listed, len(string_split(coalesce(skinName, ''), '|')) = len(skins) AS equal FROM heroes",
    "validate_records": f"WITH {ERRORS} SELECT record_id, error FROM lacking",
    "validation_summary": f"WITH {ERRORS} SELECT count(*) AS errors, count(DISTINCT record_id) AS records, count(*) = 0 AS passed FROM lacking",
    "error_preview": f"WITH {ERRORS} SELECT record_id, error, (SELECT count(*) FROM lacking) AS errors FROM lacking ORDER BY 1, 2 LIMIT 10",
    "safe_names": "WITH r AS (SELECT page_id, " + _CLEAN.format("' .a/b:' || url || '?  x' || chr(9) || 'y. '") + " AS c FROM pages) SELECT page_id, " + _SAFE.format("c") + " AS name FROM r",
    "url_extension": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '.png' WHEN lower(regexp_extract(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '[^/]+\\.([^./]+)$', 1)) IN ('jpg','jpeg','png','gif','webp') THEN '.' || lower(regexp_extract(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '[^/]+\\.([^./]+)$', 1)) ELSE '.jpg' END AS suffix FROM pages",
    "price_text": f"WITH {_NORMAL} SELECT source_index, price_text, {_AMOUNT} AS amount, {_UNIT} AS unit FROM normal",
    "source_key": f"WITH {A.FEED} SELECT source_index, printf('%04d-%s', source_index * 7, id) AS source_key FROM feed",
    "feed_normalize": f"WITH {_NORMAL} SELECT source_key, source_index, id AS skin_id, hero_name, skin_name, quality, online_date, acquire AS acquire_method, '' AS detail_url, image_url, price_text FROM normal",
    "feed_assets": f"WITH {_NORMAL} SELECT source_index, CASE WHEN source_index % 9 <> 0 THEN {_FILE} END AS image_path FROM normal",
    "feed_summary": f"WITH {_NORMAL} SELECT count(*) AS rows, count(*) FILTER (WHERE source_index % 9 <> 0) AS landed, count(*) FILTER (WHERE source_index % 9 = 0) AS failed FROM normal",
    "feed_raw": f"WITH {A.FEED}, j AS (SELECT *, skin_id_of % 7 AS added, json_object('added_1', skin_id_of % 7, 'fmb1lb_5300', image_b, 'fmlb_4536', image_a, 'hqfs_8609', acquire, 'pfidlb_3934', id, 'pfmclb_7523', skin_name, 'pfpzlb_3289', quality, 'sxsjlb_1516', online_date, 'yxmclb_9965', hero_name, 'yxtxlb_8443', image_c) AS whole, json_object('added_1', skin_id_of % 7, 'fmb1lb_5300', image_b, 'fmlb_4536', image_a, 'pfidlb_3934', id, 'pfmclb_7523', skin_name, 'pfpzlb_3289', quality, 'sxsjlb_1516', online_date, 'yxmclb_9965', hero_name, 'yxtxlb_8443', image_c) AS part FROM (SELECT *, source_index - 1 AS skin_id_of FROM feed)) SELECT source_index, quality, acquire AS acquire_method, '' AS detail_url, CAST(CASE WHEN skin_id_of % 4 = 3 THEN part ELSE whole END AS VARCHAR) AS raw_json FROM j",
    "feed_head": f"WITH {A.FEED} SELECT source_index, skin_name FROM feed WHERE source_index <= 100",
    "feed_preview": f"WITH {_NORMAL} SELECT source_index, hero_name, skin_name, price_text, (SELECT count(*) FROM normal) AS rows FROM normal ORDER BY 1 LIMIT 10",
    "lenient_json": f"WITH {A.ANSWERS} SELECT skin_id, skin_id % 5 < 3 AS parsed, CASE WHEN skin_id % 5 < 3 THEN ['勇者','史诗','传说','无双','荣耀典藏','?'][skin_id % 6 + 1] END AS tier, CASE WHEN skin_id % 5 < 3 THEN skin_id % 10 + 0.5::DOUBLE END AS detail FROM answers",
    "model_run_summary": f"WITH {A.ANSWERS} SELECT model, count(*) FILTER (WHERE model <> 'vl-c' AND skin_id % 5 < 3) AS ok, count(*) FILTER (WHERE model = 'vl-c') AS missing, count(*) FILTER (WHERE model <> 'vl-c' AND skin_id % 5 >= 3) AS error, bool_or(model <> 'vl-c' AND skin_id % 5 < 3) AS any_ok, round_even(avg(elapsed), 2) AS mean_seconds, round(median(elapsed), 4) AS median_seconds FROM answers GROUP BY 1",
    "vision_fields": f"WITH {PARSED} SELECT skin_id, art AS vlm_art_quality, effect AS vlm_effect_score, harmony AS vlm_color_harmony, composition AS vlm_composition FROM vision",
    "quarantine": f"WITH {PARSED} SELECT skin_id, array_to_string(list_concat(CASE WHEN tier = '?' OR ratio > 1 THEN ['domain'] ELSE [] END, CASE WHEN art < 1 THEN ['detail'] ELSE [] END), ',') AS failed FROM vision",
    "palette": f"WITH {PARSED}, c AS (SELECT hero_name, colour, count(*) AS uses FROM (SELECT hero_name, unnest([colour, '#00ff00', '#0000ff', '#102030', '#a0b0c0']) AS colour FROM vision) GROUP BY ALL), r AS (SELECT hero_name, CAST(row_number() OVER (PARTITION BY hero_name ORDER BY uses DESC, colour) AS INTEGER) AS place, colour, uses FROM c) SELECT *, CAST('0x' || substr(colour, 2, 2) AS INTEGER) AS red, CAST('0x' || substr(colour, 4, 2) AS INTEGER) AS green, CAST('0x' || substr(colour, 6, 2) AS INTEGER) AS blue FROM r WHERE place <= 5",
    "similar_resolved": f"WITH {A.SKINS} SELECT skin_id, count(*) OVER (PARTITION BY hero_name, skin_name) AS items FROM skins QUALIFY skin_id % 5 < 3",
    "code_maps": f"WITH {A.SKINS} SELECT skin_id, ['伴生','勇者','史诗','传说','无双','荣耀典藏'][official_tier + 1] AS tier_label, official_tier AS tier, CASE WHEN skin_id % 6 < 5 THEN CAST(skin_id % 6 AS INTEGER) END AS method, CASE skin_id % 6 WHEN 0 THEN 0.2 WHEN 1 THEN 0.8 WHEN 2 THEN 0.4 WHEN 3 THEN 0.5 WHEN 4 THEN 0.6 ELSE 0 END::DOUBLE AS method_score, CASE WHEN skin_id % 5 < 4 THEN CAST(skin_id % 5 AS INTEGER) END AS density FROM skins",
    "harmonised": f"WITH {_NORMAL} SELECT source_index, TRY_CAST(quality AS INTEGER) AS tier, round({_AMOUNT} * CASE WHEN {_UNIT} = '点券' THEN 0.1::DOUBLE ELSE 1::DOUBLE END, 4) AS amount, TRY_CAST(online_date AS DATE) AS online FROM normal",
    "page_text": r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CAST(length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS INTEGER) AS n_chars FROM pages",
    "clean_dedup": r"WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL), k AS (SELECT * FROM c WHERE length(text) >= 20) SELECT min(doc_id) AS doc_id, CAST(any_value(length(text)) AS INTEGER) AS n_chars FROM k GROUP BY lower(text)",
    "source_union": "SELECT 'forum' AS origin, count(*) AS rows, count(lang) AS with_lang FROM documents UNION ALL SELECT 'chat', count(*), 0 FROM conversations",
    "orphans": "SELECT DISTINCT l_partkey AS skin_id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 97 <> 0)",
    "upsert_latest": f"WITH {A.LISTINGS} SELECT skin_id, price, listed_at, flag FROM listings QUALIFY row_number() OVER (PARTITION BY skin_id ORDER BY listed_at DESC, price DESC, flag DESC) = 1",
    "hero_upsert": f"WITH {A.HERO_EVENTS} SELECT hero_name, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM hero_events GROUP BY 1",
    "duplicate_keys": f"WITH {A.SKINS} SELECT hero_name, skin_name, count(*) AS rows FROM skins GROUP BY 1, 2 HAVING count(*) > 1",
    "catalog_diff": f"WITH {A.SKINS} SELECT skin_id, CASE WHEN skin_id % 10 = 0 THEN 'added' WHEN skin_id % 11 = 0 THEN 'removed' ELSE 'changed' END AS change FROM skins WHERE (skin_id % 10 = 0) <> (skin_id % 11 = 0) OR (skin_id % 10 <> 0 AND skin_id % 11 <> 0 AND skin_id % 7 = 0)",
    "incremental_read": f"WITH {A.HERO_EVENTS}, f AS (SELECT hero_name, min(ts) AS first FROM hero_events GROUP BY 1) SELECT e.hero_name, count(*) AS rows, any_value(first) < TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 30 DAY AS stale FROM hero_events e JOIN f ON e.hero_name = f.hero_name WHERE ts > TIMESTAMP '2024-01-20' GROUP BY 1",
}
