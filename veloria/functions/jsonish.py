"""Model responses that should be JSON: lenient parsing, typed fields, domain checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed domains of the first-level answer.
SCENES = ("indoor", "outdoor", "abstract")
DENSITIES = ("low", "mid", "high", "extreme")


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once a row, however often ``use`` names it: the optimizer doesn't write it out at each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unfenced(text: Column) -> Column:
    """The text without an opening and a closing fence line; a fence that is one line leaves nothing."""

    def cut(text: Column) -> Column:
        no_first = F.when(F.instr(text, "\n") > 0, F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise(F.lit(""))
        no_last = F.regexp_replace(no_first, r"\n?[ \t]*```[ \t]*$", "")
        return F.btrim(F.when(text.startswith("```"), no_last).otherwise(text))

    return once(F.btrim(F.coalesce(text, F.lit(""))), cut)


def lenient_json(text: Column) -> Column:
    """The parsed answer: the text itself, else what stands from its first brace to its last; null if neither parses."""
    some = lambda v: F.when(~F.is_variant_null(v), v)

    def parsed(body: Column) -> Column:
        inner = F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit(""))
        return F.coalesce(once(F.try_parse_json(body), some), once(F.try_parse_json(inner), some))

    return once(unfenced(text), parsed)


def number_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "double")


def text_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def in_domain(tier: Column, scene: Column, ratio: Column, density: Column, colours: Column, tiers: tuple[str, ...]) -> Column:
    """Whether a first-level answer keeps to its domain; null parts do not."""
    fine = tier.isin(*tiers) & scene.isin(*SCENES) & ratio.between(0, 1) & density.isin(*DENSITIES)
    return F.coalesce(fine & (F.size(colours) == 5) & F.forall(colours, lambda c: c.rlike("^#[0-9a-fA-F]{6}$")), F.lit(False))
