"""Small expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TINY = 1e-15
"""Fixed value: metrics up to this size count as zero."""


def zero_if_missing(value: Column) -> Column:
    """NULL and NaN become 0."""
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def zero_if_tiny(value: Column) -> Column:
    return F.when(F.abs(value) <= TINY, F.lit(0.0)).otherwise(value)
