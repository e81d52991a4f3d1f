"""Text expressions of the feed: file names, URLs, prices, keys. All are column expressions; nulls stay null unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the feed.
PRICE_UNITS = ("点券", "荣耀积分", "皮肤碎片")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "gif", "webp")
FORBIDDEN = r"[\\/:*?\"<>|\r\n\t]+"
PRICE = r"(?U)[0-9]+(?:\.[0-9]+)?\s*(?:" + "|".join(PRICE_UNITS) + ")"


def safe_name(value: Column, length: int = 140) -> Column:
    """A file name: forbidden runs become one underscore, ends lose blanks and dots, blanks collapse; never empty."""
    out = F.regexp_replace(F.coalesce(value, F.lit("")), FORBIDDEN, "_")
    out = F.regexp_replace(F.btrim(out, F.lit(" .")), r"(?U)\s+", " ")
    return F.left(F.when(out == "", "unknown").otherwise(out), F.lit(length))


def absolute_url(url: Column) -> Column:
    """A scheme-relative URL gets https."""
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)


def url_suffix(url: Column) -> Column:
    """The image suffix of a URL's path in lower case; .jpg where it has none that is an image's."""
    path = F.regexp_extract(F.coalesce(absolute_url(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"[^.].*\.([^.]+)$|^[^.]\.([^.]+)$", 1))
    return F.when(suffix.isin(*IMAGE_SUFFIXES), F.concat(F.lit("."), suffix)).otherwise(F.lit(".jpg"))


def price_text(value: Column) -> Column:
    """Every number with a currency unit, joined by a slash; null where there is none."""
    found = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(PRICE), F.lit(0))
    return F.when(F.size(found) > 0, F.array_join(found, " / "))


def price_amount(text: Column) -> Column:
    """The first number of a price text."""
    return F.nullif(F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")


def price_unit(text: Column) -> Column:
    """The unit after the first number."""
    return F.nullif(F.regexp_extract(text, r"[0-9]+(?:\.[0-9]+)?\s*(" + "|".join(PRICE_UNITS) + ")", 1), F.lit(""))


def source_key(index: Column, skin_id: Column) -> Column:
    """Four digits at least, a dash and the id."""
    return F.format_string("%04d-%s", index.cast("long"), skin_id.cast("string"))


def asset_file(index: Column, skin_id: Column, hero: Column, skin: Column, url: Column) -> Column:
    """The file an image is landed as."""
    return F.concat(safe_name(F.concat_ws("-", source_key(index, skin_id), hero, skin)), url_suffix(url))


def expected_asset(hero: Column, index: Column, skin: Column) -> Column:
    """The listing name of a hero's skin, with its place from 1."""
    return F.concat(F.concat_ws("-", hero, index.cast("string"), skin), F.lit(".jpg"))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def pipe_count(value: Column) -> Column:
    return F.size(F.split(value, r"\|"))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def ratio(new: Column, old: Column) -> Column:
    """(new - old) / old; null where old is 0."""
    return F.try_divide(new - old, old)


def comparison_line(name: Column, other: Column, own: Column) -> Column:
    """One competitor's line; an equal total shows a down arrow and 0."""
    diff = own - other
    arrow = F.when(diff > 0, "↑").otherwise("↓")
    return F.concat(F.lit("- "), name, F.lit(": 情绪溢价 "), other.cast("string"), F.lit(" ("), arrow, F.abs(diff).cast("string"), F.lit(" vs 当前皮肤)"))
