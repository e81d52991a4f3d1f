"""Mixing sources to target weights with a time-varying curriculum.

How much: the sources' targets share all words by weight; a target stops at ``repeat_limit`` times its source's size and
the excess goes to the others by weight. A source is read in passes over its documents, in an order by hash, until its
cumulative demand reaches its target; a document is taken in a pass if its middle lies before that.

When: over training time t in [0, 1] a source's share of the stream changes in proportion to 1 + slope (2t - 1). The integral
of that schedule, target (t + slope (t^2 - t)), is the source's cumulative demand; inverting it at a document's place in its
source's stream gives the time of its reading. What all sources together have demanded by then, in words, is the training
position: the sum of the same integrals. Documents are then sorted by position in ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, running_base, word_count

REPEAT_LIMIT = 3
WEIGHTS = (1, 2, 3)
#: Slopes of the sources' schedules, repeating in the order of the weights: earlier, even, later.
SLOPES = (-0.5, 0.0, 0.5)
#: Documents that one task sums in order, about; the number of blocks of a source's order follows from it.
BLOCK_ROWS = 50_000
LEAST_BLOCKS = 4096
#: Up to so many sources their targets go to every executor.
SENT_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = REPEAT_LIMIT) -> DataFrame:
    """(source, source_size, weight, slope, target, all_size, all_slope), one row per source; ``sizes`` has source and size.

    Sources go by code point, null last, and take the weights in turn. Resharing the excess by weight until no target is
    above its stop ends at target = min(stop, level * weight) with one level for all; sorted by stop / weight, the stopped
    sources are a prefix, so running sums give the level. These windows see one row per source, not rows of documents.
    ``all_size`` is the sum of all targets, which is that of all sizes; ``all_slope`` that of target * slope.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.partitionBy().orderBy(F.col("source").asc_nulls_last()))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), ((F.col("_place") - 1) % len(values) + 1).cast("int"))
    per = per.withColumn("_place", place).withColumn("weight", pick(weights)).withColumn("slope", pick(SLOPES))
    order = W.partitionBy().orderBy(F.col("_ratio"), "_place")
    per = per.withColumn("_stop", F.col("source_size") * F.lit(limit)).withColumn("_ratio", F.col("_stop").cast("double") / F.col("weight"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_stop").over(before), F.lit(0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("_level", left.cast("double") / heavy.cast("double"))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_place", "_level"))).over(everything)["_level"]
    per = per.withColumn("target", F.least(F.col("_stop").cast("double"), level * F.col("weight")))
    every = {"all_size": F.sum("source_size").over(everything), "all_slope": F.sum(F.col("target") * F.col("slope")).over(everything)}
    return per.select("source", "source_size", "weight", "slope", "target", *[c.alias(n) for n, c in every.items()])


def training_time(place: Column, slope: Column) -> Column:
    """Solve t + slope (t^2 - t) = place for t: the inverse of the integrated schedule, for places in [0, 1]."""
    b = F.lit(1.0) - slope
    root = F.sqrt(b * b + F.lit(4.0) * slope * place)
    return F.when(slope == 0, place).otherwise((F.lit(2.0) * place) / (b + root))


def training_position(place: Column, slope: Column, all_size: Column, all_slope: Column) -> Column:
    """Words that all sources together have demanded by the time at which this source's demand reaches ``place`` of its target."""
    t = training_time(F.least(F.lit(1.0), place), slope)
    return F.round(all_size * t + all_slope * (t * t - t)).cast("long")


def _sized(docs: DataFrame, name: str, *more: Column) -> DataFrame:
    """A row number, doc_id, source, size and place in the order of each row, written once: the texts are counted in one scan."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    sized = docs.select(
        *more, F.monotonically_increasing_id().alias("__v_row"), F.col("doc_id").cast("long").alias("__v_doc"), F.col("source").cast("string").alias("__v_source"),
        word_count(F.col("text")).alias("__v_size"), F.md5(own.cast("binary")).alias("__v_order"),
    )
    return materialise(sized, name)


def _planned(sized: DataFrame, weights: tuple[int, ...], limit: int) -> DataFrame:
    """Row numbers with what the mix takes of each row and the place of its first reading in its source's demand."""
    rows = sized.select("__v_row", *[F.col(f"__v_{c}").alias(c) for c in ("doc", "source", "size", "order")])
    targets = materialise(source_targets(rows, weights, limit), "source-targets")
    totals = rows.agg(F.count(F.lit(1))).first()[0], targets.count()
    blocks = max(LEAST_BLOCKS, totals[0] // BLOCK_ROWS)
    rows = rows.withColumn("_block", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * F.lit(blocks) / F.lit(1 << 32)))
    placed = running_base(rows.withColumn("_key", F.struct("order", "doc", "size")), ["source"], "_key", "size", "_block")
    targets = targets.withColumnRenamed("source", "_source")
    how = "broadcast" if totals[1] <= SENT_SOURCES else "merge"
    joined = placed.join(targets.hint(how), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    middle = F.col("base") + F.col("size") / F.lit(2.0)
    passes = F.when((F.col("size") > 0) & (middle < F.col("target")), F.ceil((F.col("target") - middle) / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return joined.withColumn("middle", middle).withColumn("passes", F.least(passes, F.lit(limit).cast("long")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = REPEAT_LIMIT) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source) with size, source_size, target, passes, taken and position, sorted by position.

    ``passes`` is how often the mix takes the document, ``position`` the training position, in words of the whole stream, of
    its first reading; null if it is not taken. Null texts and texts without words have size 0 and are never taken; a table
    without words has targets 0. A null source is a source of its own. Rows that repeat a doc_id and source go side by side
    and count each; rows without a doc_id are ordered by their texts. Extra columns are ignored; an empty table gives no rows.
    """
    plan = _planned(_sized(docs, "sizes"), weights, limit)
    position = F.when(F.col("passes") > 0, training_position(F.col("middle") / F.col("target"), F.col("slope"), F.col("all_size"), F.col("all_slope")))
    rows = plan.select(F.col("doc").alias("doc_id"), "size", "source", "source_size", "target", "passes", (F.col("passes") * F.col("size")).alias("taken"), position.alias("position"))
    rows = materialise(rows, "mix")
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = REPEAT_LIMIT) -> DataFrame:
    """The stream itself: the columns of ``docs``, a row for each time the mix reads it, range-sorted by training position.

    Rows without words go, and those that lie beyond their source's target. Null texts, doc_ids and sources, repeated rows
    and extra columns are as in ``mix``.
    """
    sized = _sized(docs, "sized-documents", *[F.col(f"`{c}`") for c in docs.columns])
    plan = _planned(sized, weights, limit).where("passes > 0")
    plan = plan.select("__v_row", *[F.col(c).alias(f"__v_{c}") for c in ("middle", "passes", "slope", "target", "source_size", "all_size", "all_slope")])
    v = lambda name: F.col(f"__v_{name}")
    rows = sized.select(*[F.col(f"`{c}`") for c in docs.columns], "__v_row").join(materialise(plan, "mix-plan").hint("merge"), "__v_row")
    rows = rows.withColumn("__v_pass", F.explode(F.sequence(F.lit(0).cast("long"), v("passes") - 1)))
    place = (v("middle") + v("pass") * v("source_size")) / v("target")
    rows = rows.withColumn("__v_position", training_position(place, v("slope"), v("all_size"), v("all_slope")))
    return rows.repartitionByRange("__v_position", "__v_row").sortWithinPartitions("__v_position", "__v_row").select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size AS stop, CAST(3 * source_size AS DOUBLE) / ((place - 1) % 3 + 1) AS ratio FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(stop) OVER b, 0) AS DOUBLE)
                / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
      FROM w WINDOW b AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, (ratio, place)) AS level FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, ((place - 1) % 3 - 1) * 0.5::DOUBLE AS slope, least(CAST(stop AS DOUBLE), v.level * weight) AS target FROM l, v),
a AS (SELECT CAST(sum(source_size) AS DOUBLE) AS all_size, sum(target * slope) AS all_slope FROM t),
c AS (SELECT doc_id, source, size, size / 2.0::DOUBLE + coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS middle FROM d),
p AS (SELECT c.*, t.source_size, t.target, t.slope, least(1.0::DOUBLE, middle / target) AS place,
        CASE WHEN size > 0 AND middle < target THEN least(3, CAST(ceil((target - middle) / source_size) AS BIGINT)) ELSE 0 END AS passes
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN slope = 0 THEN place ELSE 2.0 * place / (1.0 - slope + sqrt((1.0 - slope) * (1.0 - slope) + 4.0 * slope * place)) END AS time FROM p)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(passes AS BIGINT) AS passes, CAST(passes * size AS BIGINT) AS taken,
       CASE WHEN passes > 0 THEN CAST(round(all_size * time + all_slope * (time * time - time)) AS BIGINT) END AS position
FROM q, a
"""


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
