"""Structured Streaming jobs over change feeds and source streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from fleetwright.functions.neighbours import time_slice
from fleetwright.operators.classes import heartbeat_windows
from fleetwright.operators.definitions import KEY
from fleetwright.operators.feeds import coalesced_keys, relevant_run_events
from fleetwright.operators.requests import open_request_events
from fleetwright.streaming.changes import keep_newest, newest_rows, run_available, stored_changes
from fleetwright.vocabulary import NEW


def append_available(stream: DataFrame, checkpoint: str, target: str) -> None:
    """As ``run_available``, appending the rows to parquet files exactly once."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", target)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


ORDER = ["ts", "seq"]
PHASES = "namespace string, name string, ts timestamp_ntz, seq long, phase string, slice long"
PHASE_LOG = "namespace string, name string, ts timestamp_ntz, seq long, from_phase string, to_phase string, sign int"


def track_phases(spark: SparkSession, place: str, slice_seconds: int = 3600) -> Callable[[DataFrame, int], None]:
    """Per-batch step that logs changes of phase, and takes back what a late row proves wrong.

    The log has rows with ``sign`` 1 for a transition and -1 for one that is withdrawn: a row that
    comes late changes what it and its next neighbour follow. A batch looks only at the rows of its own
    keys and time slices, and at the first and last rows of these keys' other slices, so neither
    the whole history nor a hot key is ever in one task. Rows that are known already change nothing.
    A batch reads what earlier batches wrote and overwrites its own folders only, so a repeat gives
    the same.
    """
    for part, schema in (("history/batch_id=-1/edge=true", PHASES), ("log/batch_id=-1", PHASE_LOG)):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{place}/{part}")
    row = [*KEY, *ORDER]

    def step(batch: DataFrame, batch_id: int) -> None:
        came = batch.select(*row, "phase").distinct().withColumn("slice", time_slice("ts", slice_seconds)).persist()
        touched = came.select(*KEY, "slice").distinct()
        low, high = came.agg(F.min("slice"), F.max("slice")).first()
        earlier = spark.read.schema(PHASES).parquet(f"{place}/history").filter(F.col("batch_id") < batch_id)
        inside = earlier.filter(F.col("slice").between(low, high)).join(touched, [*KEY, "slice"], "left_semi")
        outside = earlier.filter("edge = 'true'").join(touched.select(*KEY).distinct(), KEY, "left_semi")
        outside = outside.join(touched, [*KEY, "slice"], "left_anti")
        known = inside.unionByName(outside).select(*came.columns, F.lit(False).alias("fresh"))
        rows = known.unionByName(came.withColumn("fresh", F.lit(True)))
        # A row that is known and came again stays a known one.
        rows = rows.groupBy(*row, "slice").agg(F.min("phase").alias("phase"), F.min("fresh").alias("fresh")).persist()
        log = _followed(rows).select(*row, F.col("phase").alias("to_phase"), F.explode(_corrections()).alias("change"))
        log = log.select(*row, "change.from_phase", "to_phase", "change.sign").filter("from_phase <> to_phase")
        log.write.mode("overwrite").parquet(f"{place}/log/batch_id={batch_id}")
        place_in_slice, slice_rows = F.struct(*ORDER), W.partitionBy(*KEY, "slice")
        ends = (F.min(place_in_slice).over(slice_rows), F.max(place_in_slice).over(slice_rows))
        stored = rows.filter("fresh").withColumn("edge", place_in_slice.isin(*ends)).drop("fresh")
        stored.sortWithinPartitions("edge", "slice", *row).write.mode("overwrite").partitionBy("edge").parquet(
            f"{place}/history/batch_id={batch_id}"
        )
        rows.unpersist()
        came.unpersist()

    return step


def _followed(rows: DataFrame) -> DataFrame:
    """Each row with the row before it (``now``: phase, fresh), and ``old``, the phase of the last known one before.

    As in ``neighbours``: windows within slices first, and one over a key's open slice ends only.
    """
    within, across = W.partitionBy(*KEY, "slice").orderBy(*ORDER), W.partitionBy(*KEY).orderBy(*ORDER)
    before, known = F.struct("phase", "fresh"), F.when(~F.col("fresh"), F.col("phase"))
    until = (W.unboundedPreceding, -1)
    sliced = rows.select(
        "*",
        F.lag(before).over(within).alias("now"),
        F.last(known, ignorenulls=True).over(within.rowsBetween(*until)).alias("old"),
        F.when(F.lead("seq").over(within).isNull(), F.last(known, ignorenulls=True).over(within)).alias("_last_known"),
        F.lead("seq").over(within).isNull().alias("_is_last"),
    ).withColumn("_open", F.col("now").isNull() | (F.col("old").isNull() & ~F.col("fresh")))
    ends = sliced.filter("_open OR _is_last").withColumns(
        {
            "now": F.coalesce("now", F.lag(before).over(across)),
            "old": F.coalesce("old", F.last("_last_known", ignorenulls=True).over(across.rowsBetween(*until))),
        }
    )
    found = sliced.filter("NOT _open").unionByName(ends.filter("_open"))
    return found.drop("_open", "_is_last", "_last_known")


def _corrections() -> Column:
    """What a row of ``_followed`` adds to the log: (from_phase, sign); null for known rows that follow known ones."""

    def change(phase: str, sign: int) -> Column:
        return F.struct(F.coalesce(phase, F.lit(NEW)).alias("from_phase"), F.lit(sign).alias("sign"))

    moved = F.col("now.fresh") & ~F.coalesce("now.phase", F.lit(NEW)).eqNullSafe(F.coalesce("old", F.lit(NEW)))
    return F.when(F.col("fresh"), F.array(change("now.phase", 1))).when(
        moved, F.array(change("old", -1), change("now.phase", 1))
    )


def phase_log(spark: SparkSession, place: str) -> DataFrame:
    """Transitions that hold: those logged, without those withdrawn."""
    log = spark.read.schema(PHASE_LOG).parquet(f"{place}/log")
    held = log.groupBy(*KEY, *ORDER, "from_phase", "to_phase").agg(F.sum("sign").alias("held"))
    return held.filter("held > 0").drop("held")


def status_sink(stream: DataFrame, checkpoint: str, target: str) -> None:
    """Keep the newest status row of each stream; all of a row's columns are written together.

    The sink takes over the newest row's time even where the phase is unchanged, so that a later row
    that is older still changes nothing.
    """
    keep_newest(stream, KEY, ORDER, checkpoint, target)


def status_events(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The rows of ``status_sink`` that an event is raised for: those that change the phase."""
    return stored_changes(spark, target, schema, KEY, "phase", NEW)


def change_capture(stream: DataFrame, checkpoint: str, target: str) -> None:
    """Keep the newest row per key; deletes stay as marks, so that older rows that come late cannot
    bring a key back."""
    keep_newest(stream, KEY, ["ts", "event_id"], checkpoint, target)


def live(spark: SparkSession, target: str, schema: StructType, deleted: Column) -> DataFrame:
    """Target rows that are not deleted; a null mark is none."""
    return newest_rows(spark, target, schema, KEY).filter(~F.coalesce(deleted, F.lit(False)))


def coalesce_keys(work: str) -> Callable[[DataFrame, int], None]:
    """Per-batch step that turns events into one work item per stream."""
    return lambda batch, batch_id: coalesced_keys(batch).write.mode("overwrite").parquet(
        f"{work}/batch_id={batch_id}"
    )


def routed_events(feed: DataFrame, streams: DataFrame, classes: DataFrame) -> DataFrame:
    """Relevant run and request events of a feed with the stream each one concerns.

    Run events name their stream by the controlling owner, request events by their stream
    id; both come as ``owner_name``. Filters are stateless, streams and classes are static.
    """
    runs = relevant_run_events(feed).filter("controller")
    requests = open_request_events(feed, classes)
    columns = ["seq", "kind", "verb", "namespace", "owner_name"]
    both = runs.select(*columns).unionByName(requests.select(*columns))
    return both.withColumnRenamed("owner_name", "name").join(streams.select(*KEY, "phase"), KEY, "inner")


def route_events(
    streams: Callable[[], DataFrame], classes: Callable[[], DataFrame], target: str
) -> Callable[[DataFrame, int], None]:
    """Per-batch step that writes the routed events of a batch, by the definitions as of that batch.

    ``streams`` and ``classes`` read their tables anew, so a stream that is defined while the query
    runs gets its events from the next batch on.
    """
    return lambda batch, batch_id: routed_events(batch, streams(), classes()).write.mode("overwrite").parquet(
        f"{target}/batch_id={batch_id}"
    )


def count_heartbeats(
    target: str, interval: str = "30 seconds", delay: str = "5 seconds"
) -> Callable[[DataFrame, int], None]:
    """Per-batch step that writes the batch's own counts per class and report interval.

    Counts add up, so nothing waits for a window to close and no row comes too late.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        heartbeat_windows(batch, interval, delay).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return step


def counted_heartbeats(spark: SparkSession, target: str) -> DataFrame:
    """Feed rows per class and report interval, over all batches so far."""
    schema = "kind string, window_start timestamp_ntz, window_end timestamp_ntz, beats long"
    parts = spark.read.schema(schema).parquet(target)
    return parts.groupBy("kind", "window_start", "window_end").agg(F.sum("beats").alias("beats"))


def restart_on_change(root: str, checksum: str, run: Callable[[str, str], None]) -> str:
    """Run under a checkpoint and a target named by the configuration's checksum: ``run(checkpoint, target)``.

    The same configuration goes on where it stopped; a changed one starts anew. Returns the target.
    """
    folder = f"{root.rstrip('/')}/{checksum}"
    run(f"{folder}/checkpoint", f"{folder}/target")
    return f"{folder}/target"
