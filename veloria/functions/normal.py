"""Normalisers to 0..1 and the fit of their bounds. Guards: no range gives 0, no largest rank gives 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def minmax(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (F.lit(float(v)) if isinstance(v, (int, float)) else v for v in (low, high))
    return F.when(high == low, F.lit(0.0)).otherwise((x - low) / (high - low))


def log_scale(x: Column, most: Column) -> Column:
    return F.when(most == 0, F.lit(0.0)).otherwise(F.log1p(x) / F.log1p(most))


def invert_minmax(x: Column, low, high) -> Column:
    return F.lit(1.0) - minmax(x, low, high)


def invert_rank(x: Column, most: Column) -> Column:
    return F.when(most == 0, F.lit(1.0)).otherwise(F.lit(1.0) - x / most)


def binary(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def max_divide(x: Column, most: float) -> Column:
    return x / F.lit(float(most))


def log_clip(x: Column, most: float) -> Column:
    return F.log1p(F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(float(most)))) / F.log1p(F.lit(float(most)))


def fit_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with min_<c> and max_<c> of every column, by one aggregate; 0 for a column without values."""
    return df.agg(*[F.coalesce(f(F.col(c).cast("double")), F.lit(0.0)).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "min"), (F.max, "max"))])
