"""The data jobs of a stream: backfill, scheduled reload, hand-off, gap fill.

Source rows carry the stream's ``namespace`` and ``name``, an event time ``ts``, a unique ``event_id`` and
payload columns. Targets are folders of parquet, one sub-folder per load or run, so one that
is repeated after a failure overwrites its own output and nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetwright.functions.latest import latest_per_key
from fleetwright.operators.definitions import KEY


def backfill_rows(source: DataFrame, open_requests: DataFrame) -> DataFrame:
    """All source rows of streams with an open request, tagged with the request as backfill id.

    Spark picks the join by the requests' real size, and splits a stream that holds many rows.
    """
    runs = open_requests.select(*KEY, F.col("request_name").alias("backfill_id"))
    return source.join(runs, KEY, "inner")


def backfill_load(
    spark: SparkSession, source: DataFrame, open_requests: DataFrame, target: str, load_id: str
) -> tuple[DataFrame, DataFrame]:
    """Run all open backfills; returns the loaded rows and the requests to mark completed.

    A load first writes down the requests it answers; its rows and the completed requests both
    come from that list, so one that is opened meanwhile stays open. A load owns one sub-folder
    of ``rows`` and ``requests``, so repeating it after a failure overwrites its own only. Rows are
    gathered by backfill id, so that readers of one id skip the other row groups; the rebalance
    hint splits an id that holds a large part of all rows over many tasks.
    """
    root = target.rstrip("/")
    asked = open_requests.select(*KEY, "request_name")
    asked.write.mode("overwrite").parquet(f"{root}/requests/load_id={load_id}")
    asked = spark.read.schema(asked.schema).parquet(f"{root}/requests/load_id={load_id}")
    rows = backfill_rows(source, asked)
    folder = f"{root}/rows/load_id={load_id}"
    rows.hint("rebalance", "backfill_id").sortWithinPartitions("backfill_id").write.mode("overwrite").parquet(folder)
    loaded = spark.read.schema(rows.schema).parquet(folder)
    return loaded, asked.select("namespace", "request_name", F.lit(True).alias("completed"))


RUN = "run string, attempt string, finished_at timestamp"


def scheduled_batch(spark: SparkSession, source: DataFrame, target: str, run_id: str) -> DataFrame:
    """One scheduled full reload under its own id; returns the run's rows.

    The run counts once its mark is written, after its rows. A repeat writes an attempt of its own, so
    what readers of the earlier one have open stays whole.
    """
    root, attempt = target.rstrip("/"), uuid.uuid4().hex
    folder = f"{root}/rows/run_id={run_id}/attempt={attempt}"
    spark.createDataFrame([], RUN).write.mode("overwrite").parquet(f"{root}/runs/none")
    source.write.parquet(folder)
    mark = spark.range(1).select(
        F.lit(run_id).alias("run"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("finished_at")
    )
    mark.write.parquet(f"{root}/runs/{run_id}-{attempt}")
    return spark.read.schema(source.schema).parquet(folder)


def latest_run(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """Rows of the newest finished run, with its ``run_id``; run ids sort by time as texts.

    Only the marks and that run's own folder are opened. A newest run without rows gives none, and so
    does a target of which a run was begun but none has finished.
    """
    root = target.rstrip("/")
    marks = spark.read.schema(RUN).option("recursiveFileLookup", "true").parquet(f"{root}/runs")
    newest = marks.agg(F.max(F.struct("run", "finished_at", "attempt")).alias("newest")).first()["newest"]
    if newest is None:
        return spark.createDataFrame([], schema).withColumn("run_id", F.lit(""))
    rows = spark.read.schema(schema).parquet(f"{root}/rows/run_id={newest['run']}/attempt={newest['attempt']}")
    return rows.withColumn("run_id", F.lit(newest["run"]))


def handoff_rows(backfill: DataFrame, stream: DataFrame, overlap_start: Column, overlap_end: Column) -> DataFrame:
    """Union of both feeds without loss and without a row twice.

    Only rows in [overlap_start, overlap_end) can be in both, so only those are compared;
    the rest passes without a shuffle.
    """
    rows = backfill.unionByName(stream)
    seam = F.coalesce((F.col("ts") >= overlap_start) & (F.col("ts") < overlap_end), F.lit(False))
    return rows.filter(~seam).unionByName(rows.filter(seam).dropDuplicates(["event_id"]))


def seams(backfill: DataFrame, stream: DataFrame, finished: DataFrame) -> DataFrame:
    """(namespace, name, seam_start, seam_end): per stream, the time that both its feeds may hold.

    It begins with the stream's first change row and ends when its backfill ``finished`` (finished_at).
    """
    first = stream.groupBy(*KEY).agg(F.min("ts").alias("seam_start"))
    return first.join(finished.groupBy(*KEY).agg(F.max("finished_at").alias("seam_end")), KEY)


def handoff_by_stream(backfill: DataFrame, stream: DataFrame, finished: DataFrame) -> DataFrame:
    """Union of both feeds without loss and without a row twice, each stream with its own seam.

    A stream without a change row or without a finished backfill has no seam, so its rows pass as they
    are. Seams are one row per stream; only rows within their stream's seam are compared.
    """
    own = seams(backfill, stream, finished)
    rows = backfill.unionByName(stream).join(own, KEY, "left")
    shared = F.coalesce((F.col("ts") >= F.col("seam_start")) & (F.col("ts") < F.col("seam_end")), F.lit(False))
    rows = rows.withColumn("_shared", shared).drop("seam_start", "seam_end")
    apart, both = rows.filter("NOT _shared").drop("_shared"), rows.filter("_shared").drop("_shared")
    return apart.unionByName(both.dropDuplicates([*KEY, "event_id"]))


def live_rows(rows: DataFrame, keys: Sequence[str], deleted: Column) -> DataFrame:
    """Newest row per key, without keys whose newest row is a delete; a null mark is none."""
    return latest_per_key(rows, list(keys), ["ts", "event_id"]).filter(~F.coalesce(deleted, F.lit(False)))


def backfill_handoff(
    backfill: DataFrame, stream: DataFrame, keys: Sequence[str], deleted: Column
) -> DataFrame:
    """Target after backfill and stream. The newest row per key is the same however often it
    comes, so the seam needs no comparison here."""
    return live_rows(backfill.unionByName(stream), keys, deleted)


def gap_fill(source: DataFrame, target: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Source rows the target misses; a known gap [since, until) prunes both sides first."""
    for bound, keep in ((since, F.col("ts") >= F.lit(since)), (until, F.col("ts") < F.lit(until))):
        if bound is not None:
            source, target = source.filter(keep), target.filter(keep)
    return source.join(target.select("event_id"), "event_id", "left_anti")
