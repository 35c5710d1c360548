"""Change feeds: merging, filtering and routing to the owning stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.operators.definitions import KEY


def merged_feed(feeds: dict[str, DataFrame]) -> DataFrame:
    """Bag union of feeds, batch or streaming, each row keeping its record kind."""
    merged = None
    for kind, feed in feeds.items():
        tagged = feed.withColumn("kind", F.lit(kind))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    return merged


def relevant_run_events(events: DataFrame) -> DataFrame:
    """Run events worth a look at their stream.

    Creates and deletes pass, generic events never do. An update passes for a cron job, and
    for a job once it is completed or failed.
    """
    finished = F.col("completed") | F.col("failed")
    return events.filter(
        F.col("kind").isin("Job", "CronJob")
        & (
            F.col("verb").isin("ADDED", "DELETED")
            | ((F.col("verb") == "MODIFIED") & ((F.col("kind") == "CronJob") | finished))
        )
    )


def controller_owner(events: DataFrame) -> DataFrame:
    """One row per event and controlling owner; other owners are dropped before the explode."""
    owners = F.filter("owner_references", lambda o: o["controller"])
    version = F.col("_owner.api_version")
    group = F.when(F.contains(version, F.lit("/")), F.substring_index(version, "/", 1)).otherwise("")
    return events.withColumn("_owner", F.explode(owners)).select(
        *[c for c in events.columns if c != "owner_references"],
        F.col("_owner.name").alias("name"),
        F.col("_owner.kind").alias("kind"),
        group.alias("api_group"),
    )


def event_to_owner(events: DataFrame, streams: DataFrame) -> DataFrame:
    """Events with their controlling stream, where there is one of the owner's group and kind."""
    owner = [*KEY, "api_group", "kind"]
    return controller_owner(events).join(streams.select(*owner, "stream_class"), owner, "inner")


def coalesced_keys(events: DataFrame) -> DataFrame:
    """One work item per stream, however many events name it."""
    return events.select(*KEY).distinct()
