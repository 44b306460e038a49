"""Joins of many rows with one row per group.

The group side has one row per key, so a hot group only makes the row side
uneven. Adaptive execution sees the sizes at run time: it broadcasts a group
table that turns out small and splits the rows of hot keys otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    return rows.join(groups, keys, how)
