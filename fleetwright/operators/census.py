"""Counts over the fleet. All of them combine map-side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.latest import latest_per_key
from fleetwright.operators.definitions import KEY


def phase_census(streams: DataFrame) -> DataFrame:
    return streams.groupBy("stream_class", "phase").agg(F.count(F.lit(1)).alias("streams"))


def run_census(observations: DataFrame) -> DataFrame:
    """Runs per stream by kind, backfill flag and last seen state. Run ids are unique in their namespace."""
    last = latest_per_key(
        observations.select("run_id", *KEY, "ts", "seq", "kind", "is_backfill", "state"),
        ["namespace", "run_id"],
        ["ts", "seq"],
    )
    return last.groupBy(*KEY, "kind", "is_backfill", "state").agg(F.count(F.lit(1)).alias("runs"))


def event_reason_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type", "event_reason").agg(F.count(F.lit(1)).alias("events"))
