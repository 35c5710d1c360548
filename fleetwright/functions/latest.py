"""Newest or first row per key, as aggregations.

Both combine map-side: a key that holds a third of all rows sends one row per map
task through the shuffle, so no task ever sees the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rest(df: DataFrame, keys: Sequence[str]):
    return F.struct(*[c for c in df.columns if c not in set(keys)])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the largest ``order`` per key; ``order`` must end in a unique column."""
    row = F.max_by(_rest(df, keys), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the smallest ``order`` per key."""
    row = F.min_by(_rest(df, keys), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*")
