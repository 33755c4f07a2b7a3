"""Rounding, quantile and share rules shared by the statistics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType


def round_half_away(value: Column, digits: int) -> Column:
    """Round a double on its binary value, ties away from zero.

    ``F.round(x, n)`` rounds the printed decimal, so ``1.005`` becomes ``1.01``;
    scaling first gives ``1.0``, which is what SQL engines that round in floating
    point return.
    """
    scale = float(10**digits)
    return F.round(value.cast("double") * F.lit(scale), 0) / F.lit(scale)


def cut_quantile(cents: Column) -> Column:
    """A quantile of hundredths, cut (not rounded) to whole hundredths."""
    return F.floor(F.round(cents, 4))


def tenths(cents: Column) -> Column:
    """Whole hundredths as a number rounded to one decimal."""
    return F.round(cents / F.lit(10.0), 0) / F.lit(10.0)


def share(part: Column, whole: Column) -> Column:
    """Percentage of ``part`` in ``whole``; NULL when ``whole`` is 0."""
    return part * F.lit(100.0) / F.nullif(whole, F.lit(0))


def clean_number(value: Column, dtype: DataType) -> Column:
    """NaN, infinity and NULL of a numeric column as 0; other types unchanged."""
    if isinstance(dtype, (DoubleType, FloatType)):
        bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
        return F.when(value.isNull() | bad, F.lit(0.0)).otherwise(value)
    if isinstance(dtype, DecimalType) or dtype.typeName() in (
        "byte", "short", "integer", "long",
    ):
        return F.coalesce(value, F.lit(0).cast(dtype))
    return value


def clean_records(df):
    """``clean_number`` over every column of a result frame."""
    return df.select(
        *[clean_number(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]
    )
