"""Backfill requests and their streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.latest import first_per_key
from fleetwright.operators.definitions import KEY
from fleetwright.vocabulary import BATCH_JOB, NEW


def open_requests(requests: DataFrame) -> DataFrame:
    """At most one open request per stream, the one with the smallest id."""
    unfinished = requests.filter(~F.col("completed")).select(
        "namespace",
        F.col("stream_id").alias("name"),
        "request_id",
        "request_name",
        F.col("stream_class").alias("request_class"),
    )
    return first_per_key(unfinished, KEY, ["request_id"])


def stream_open_request(streams: DataFrame, requests: DataFrame) -> DataFrame:
    """Streams with their open request, or nulls; the request's class is not compared."""
    return streams.join(open_requests(requests), KEY, "left")


def initial_backfill_requests(streams: DataFrame) -> DataFrame:
    """First request of each new, active batch-job stream.

    The suffix of the name comes from the key, so that running twice gives the same name.
    """
    suffix = F.substring(F.md5(F.concat_ws("/", *KEY)), 1, 5)
    return streams.filter(
        (F.col("phase") == NEW) & ~F.col("suspended") & (F.col("backend") == BATCH_JOB)
    ).select(
        "namespace",
        F.concat(F.col("name"), F.lit("-initial-backfill-"), suffix).alias("request_name"),
        F.col("name").alias("stream_id"),
        "stream_class",
        F.lit(False).alias("completed"),
    )


def open_request_events(events: DataFrame, classes: DataFrame) -> DataFrame:
    """Created or deleted unfinished requests of the given classes; updates are dropped."""
    wanted = (
        (F.col("kind") == "BackfillRequest")
        & F.col("verb").isin("ADDED", "DELETED")
        & ~F.col("completed")
    )
    return events.filter(wanted).join(classes.select("stream_class"), "stream_class", "left_semi")


def request_to_stream(request_events: DataFrame, streams: DataFrame) -> DataFrame:
    """Streams named by request events (``namespace``, ``stream_id``)."""
    routed = request_events.withColumnRenamed("stream_id", "name")
    return routed.join(streams.select(*KEY, "phase"), KEY, "inner")
