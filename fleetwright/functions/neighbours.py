"""Previous / next row per key without one task per key.

A plain ``lag`` over a key sorts all rows of that key in one task. Here a key is cut
into time slices first. Inside a slice the window works as usual; only the two rows at
a slice's ends are looked at again, in a second window over the key. A hot key is thus
spread over its slices, and the second window sees two rows per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def time_slice(ts: str, seconds: int = 3600) -> Column:
    """Number of the slice a row falls into.

    Choose ``seconds`` so that one slice of the hottest key fits a task; results do not
    depend on it.
    """
    return F.floor(F.col(ts).cast("timestamp").cast("double") / F.lit(seconds))


def _neighbour(df, keys, order, slice_column, columns, name, forward):
    step = F.lead if forward else F.lag
    back = F.lag if forward else F.lead
    value = F.struct(*columns)
    within = W.partitionBy(*keys, "_slice").orderBy(*order)
    across = W.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_slice", slice_column).select(
        "*",
        step(value).over(within).alias(name),
        back(F.lit(True)).over(within).alias("_inner"),
    )
    inside = rows.filter(F.col(name).isNotNull())
    ends = (
        rows.filter(F.col(name).isNull() | F.col("_inner").isNull())
        .withColumn("_open", F.col(name).isNull())
        .withColumn(name, step(value).over(across))
        .filter("_open")
        .drop("_open")
    )
    return inside.unionByName(ends).drop("_slice", "_inner")


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_column: Column,
    columns: Sequence[str],
    name: str = "previous",
) -> DataFrame:
    """Add struct ``name`` with ``columns`` of the row before, null on a key's first row.

    ``slice_column`` must never decrease when ``order`` grows.
    """
    return _neighbour(df, keys, order, slice_column, columns, name, forward=False)


def with_next(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_column: Column,
    columns: Sequence[str],
    name: str = "next",
) -> DataFrame:
    """Add struct ``name`` with ``columns`` of the row after, null on a key's last row."""
    return _neighbour(df, keys, order, slice_column, columns, name, forward=True)
