"""Codes and labels. Unknown labels give null, except in scores, where they count as 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TIERS = ("伴生", "勇者", "史诗", "传说", "无双", "荣耀典藏")
ACQUISITION = ("direct", "gacha", "battle_pass", "shard", "event")
ACQUISITION_SCORES = {"direct": 0.2, "battle_pass": 0.4, "shard": 0.5, "gacha": 0.8, "event": 0.6}
IP_SOURCES = ("原创", "动漫联动", "影视联动", "文化IP")
DENSITIES = ("low", "mid", "high", "extreme")
UNKNOWN_TYPE = "未知"


def code_of(label: Column, labels: tuple[str, ...]) -> Column:
    """A label's place from 0."""
    return F.nullif(F.array_position(F.array(*map(F.lit, labels)), label), F.lit(0)).cast("int") - 1


def label_of(code: Column, labels: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, labels)), code.cast("int"))


def mapped(label: Column, scores: dict[str, float]) -> Column:
    """A label's score, 0 for others."""
    out = F.lit(0.0)
    for k, v in scores.items():
        out = F.when(label == k, F.lit(v)).otherwise(out)
    return out


def hex_colour(value: Column) -> Column:
    """Red, green and blue of '#rrggbb'; null for anything else."""
    fine = value.rlike("^#[0-9a-fA-F]{6}$")
    part = lambda at: F.conv(F.substring(value, at, 2), 16, 10).cast("int")
    return F.when(fine, F.struct(part(2).alias("red"), part(4).alias("green"), part(6).alias("blue")))
