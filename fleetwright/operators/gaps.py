"""What a target misses or holds otherwise, found by digests of ranges.

A digest of a stream's rows in a time range is their number and two sums over their hashes that do not
depend on order. Both sides are digested coarsely first; only the time that differing ranges span is
read again for finer digests, and only rows of the finest differing ranges are compared one by one.
Digests combine before the shuffle, so a stream with most rows sends one row per task and range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwright.operators.definitions import KEY
from fleetwright.session import written

#: Widths of ranges in seconds, each a multiple of the next.
LEVELS = (7 * 86_400, 86_400, 3_600)


def range_start(seconds: int) -> Column:
    """Start of the range a row's ``ts`` falls into, in seconds; rows without a time share one range."""
    at = F.floor(F.col("ts").cast("timestamp").cast("double") / F.lit(seconds)) * seconds
    return F.coalesce(at.cast("long"), F.lit(-1 << 62)).alias("range_start")


def range_digests(rows: DataFrame, seconds: int) -> DataFrame:
    """(namespace, name, range_start, rows, digest, mix): rows in any order and any partitioning give the same."""
    columns = sorted(rows.columns)
    parts = rows.select(*KEY, range_start(seconds), F.xxhash64(*columns).alias("one"), F.hash(*columns).alias("other"))
    return parts.groupBy(*KEY, "range_start").agg(
        F.count("*").alias("rows"),
        F.sum(F.col("one").cast("decimal(38,0)")).alias("digest"),
        F.bit_xor(F.xxhash64("other", "one")).alias("mix"),
    )


def _differing(source: DataFrame, target: DataFrame, seconds: int) -> DataFrame:
    """(namespace, name, range_start, source_rows, target_rows) of ranges whose digests differ."""
    sides = (
        range_digests(rows, seconds).select(*KEY, "range_start", F.col("rows").alias(f"{side}_rows"), F.struct("rows", "digest", "mix").alias(side))
        for side, rows in (("source", source), ("target", target))
    )
    both = next(sides).join(next(sides), [*KEY, "range_start"], "full")
    found = both.filter(~F.col("source").eqNullSafe(F.col("target")))
    counts = (F.coalesce(f"{side}_rows", F.lit(0)).cast("long").alias(f"{side}_rows") for side in ("source", "target"))
    return found.select(*KEY, "range_start", *counts)


def within_ranges(rows: DataFrame, ranges: DataFrame, seconds: int) -> DataFrame:
    """Rows of the given ranges; the time that the ranges span prunes the scan."""
    low, high = ranges.agg(F.min("range_start"), F.max("range_start")).first()
    if low is None:
        return rows.filter("false")
    at = F.col("ts").cast("timestamp")
    spanned = (at >= F.timestamp_seconds(F.lit(low))) & (at < F.timestamp_seconds(F.lit(high + seconds)))
    if low < -(1 << 61):
        spanned = F.col("ts").isNull() | (at < F.timestamp_seconds(F.lit(max(high + seconds, 0)))) if high >= 0 else F.col("ts").isNull()
    keyed = rows.filter(spanned).withColumn("_range", range_start(seconds))
    asked = ranges.select(*KEY, F.col("range_start").alias("_range"))
    return keyed.join(asked, [*KEY, "_range"], "left_semi").select(*rows.columns)


def gap_ranges(source: DataFrame, target: DataFrame, levels: Sequence[int] = LEVELS) -> DataFrame:
    """(namespace, name, range_start, source_rows, target_rows): the finest ranges in which the sides differ.

    ``range_start`` counts seconds; a range is ``levels[-1]`` seconds long.
    """
    target = target.select(*source.columns)
    for k, seconds in enumerate(levels):
        found = _differing(source, target, seconds)
        if k + 1 < len(levels):
            found = written(found, "gap-ranges")
            source, target = (within_ranges(rows, found, seconds) for rows in (source, target))
    return found


def missing_rows(
    source: DataFrame, target: DataFrame, ranges: DataFrame, ids: Sequence[str] = ("event_id",), seconds: int = LEVELS[-1]
) -> DataFrame:
    """Source rows of ``ranges`` that the target lacks or holds otherwise, with ``reason``."""
    ranges = written(ranges, "gap-ranges")
    mine, theirs = (within_ranges(rows.select(*source.columns), ranges, seconds) for rows in (source, target))
    held = theirs.groupBy(*ids).agg(F.collect_set(F.xxhash64(*source.columns)).alias("_held"))
    both = mine.join(held, list(ids), "left").filter(
        F.col("_held").isNull() | ~F.array_contains("_held", F.xxhash64(*(mine[c] for c in source.columns)))
    )
    return both.select(*source.columns, F.when(F.col("_held").isNull(), "missing").otherwise("different").alias("reason"))
