"""A list of objects in a large JSON document, read by many tasks.

A document is cut at closing braces by Spark's text reader, which splits files by bytes. A piece does not know whether it starts
within a string, nor how deep; both follow from running sums over the pieces before it, of quotes and of brackets outside
of strings. Pieces up to a brace that closes an entry of a list make that entry.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import kept

#: Depth between the entries of a list that is a value of the document.
BETWEEN = 2


def _before(pieces: DataFrame, size: str, out: str) -> DataFrame:
    """Running sum of ``size`` over the pieces before, in two levels: within a split of a file, and over a file's splits."""
    inner = W.partitionBy("file", "split").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    splits = pieces.groupBy(F.col("file").alias("_file"), F.col("split").alias("_split")).agg(F.sum(size).alias("_size"))
    outer = W.partitionBy("_file").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)  # a row a split
    splits = splits.select("_file", "_split", F.coalesce(F.sum("_size").over(outer), F.lit(0)).alias("_base"))
    joined = pieces.join(splits.hint("merge"), (F.col("file") == F.col("_file")) & (F.col("split") == F.col("_split"))).drop("_file", "_split")
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum(size).over(inner), F.lit(0))).drop("_base")


def read_json_list(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(file, pos, entry): the objects of the list under ``key`` of each document at ``path``, as VARIANT, with their place from 0.

    Each file is one document, a JSON object; a list of other things than objects, a missing or an empty list give no rows, as does a
    document that is cut off before the first entry ends. Unknown keys and nulls of the entries stay.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # without escapes, which stand in strings alone
    pieces = pieces.withColumn("quotes", F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))).withColumn("quotes", F.col("quotes").cast("long"))
    pieces = _before(kept(pieces, "json-pieces"), "quotes", "before")
    inside = F.col("before") % 2
    outside = F.array_join(F.filter(F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1), lambda _, i: (i + inside) % 2 == 0), "")
    ends = ((F.col("before") + F.col("quotes")) % 2 == 0).cast("long")
    delta = F.length(F.regexp_replace(outside, r"[^\[{]", "")) - F.length(F.regexp_replace(outside, r"[^\]]", "")) - ends
    pieces = _before(pieces.select("file", "split", "seq", "value", delta.cast("long").alias("delta"), ends.alias("ends")), "delta", "depth")
    closes = ((F.col("ends") == 1) & (F.col("depth") + F.col("delta") == BETWEEN)).cast("long")
    pieces = _before(pieces.select("file", "split", "seq", "value", closes.alias("closes")), "closes", "no")
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "seq", "value"))), lambda x: x["value"]), "}"), F.lit("}"))
    entries = pieces.groupBy("file", "no").agg(text.alias("text"), F.max("closes").alias("closes")).where("closes = 1")
    goes_on = F.col("text").rlike(r"^\s*,\s*\{")
    header = rf'(?s)"{re.escape(key)}"\s*:\s*\[\s*(\{{.*)$'
    entry = F.when(goes_on, F.regexp_extract("text", r"(?s)^\s*,\s*(\{.*)$", 1)).otherwise(F.regexp_extract("text", header, 1))
    entries = kept(entries.select("file", "no", goes_on.alias("goes_on"), F.try_parse_json(F.nullif(entry, F.lit(""))).alias("entry")), "json-entries")
    lists = entries.where(~F.col("goes_on")).select(F.col("file").alias("_file"), F.col("no").alias("_first"), F.col("entry").isNotNull().alias("_wanted"))
    lists = lists.withColumn("_next", F.lead("_first").over(W.partitionBy("_file").orderBy("_first"))).where("_wanted")  # a row a list
    own = (F.col("file") == F.col("_file")) & (F.col("no") >= F.col("_first")) & (F.col("_next").isNull() | (F.col("no") < F.col("_next")))
    return entries.join(lists.hint("merge"), own).select("file", (F.col("no") - F.col("_first")).cast("int").alias("pos"), "entry")
