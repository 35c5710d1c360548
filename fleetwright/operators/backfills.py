"""Backfills that resume where they stopped.

A ledger cuts the source into chunks of like size: consecutive ranges of (namespace, name, time slice).
A chunk is loaded into a folder of its own attempt and counts once its mark, which names the attempt, is
written; a resumed load takes the chunks without a mark, so each chunk is read once unless its load was
cut off. The ranges leave nothing out: a row that the source gets later lies in some chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetwright.functions.neighbours import time_slice
from fleetwright.operators.definitions import KEY
from fleetwright.session import written

LEDGER = "chunk long, rows long, namespace string, name string, slice long, next struct<namespace: string, name: string, slice: long>"
MARK = "chunk long, attempt string, loaded_at timestamp"


def _slice(seconds: int) -> Column:
    return F.coalesce(time_slice("ts", seconds), F.lit(-1 << 62)).alias("slice")


def chunks(source: DataFrame, rows_per_chunk: int, slice_seconds: int = 3600) -> DataFrame:
    """(chunk, rows, namespace, name, slice, next): where each chunk begins, and where the next one does.

    Rows are counted per stream and slice; a chunk ends with the slice that fills it, so chunks are
    like in size unless one slice of one stream holds more. The running sum over all slices is made
    of sums within the parts of a range sort and the parts' totals.
    """
    place = [*KEY, "slice"]
    counts = source.groupBy(*KEY, _slice(slice_seconds)).agg(F.count("*").alias("n"))
    sorted_ = counts.repartitionByRange(*place).select("*", F.spark_partition_id().alias("part"))
    sorted_ = written(sorted_, "backfill-counts")
    # One row per part of the sort.
    totals = sorted_.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("n").over(W.partitionBy("part").orderBy(*place).rowsBetween(W.unboundedPreceding, -1))
    ranked = sorted_.join(bases, "part").withColumn("before", F.col("base") + F.coalesce(inside, F.lit(0)))
    chunk = F.floor(F.col("before") / rows_per_chunk).cast("long").alias("chunk")
    found = ranked.groupBy(chunk).agg(F.sum("n").alias("rows"), F.min(F.struct(*place)).alias("first"))
    following = F.lead("first").over(W.orderBy("chunk"))
    return found.select("chunk", "rows", "first.*", following.alias("next"))


def plan_backfill(spark: SparkSession, source: DataFrame, target: str, rows_per_chunk: int, slice_seconds: int = 3600) -> None:
    """Write the ledger of a backfill, once and before its first load."""
    root = target.rstrip("/")
    spark.createDataFrame([], MARK).write.mode("overwrite").parquet(f"{root}/marks/none")
    chunks(source, rows_per_chunk, slice_seconds).write.parquet(f"{root}/ledger")


def _marks(spark: SparkSession, root: str) -> DataFrame:
    """The newest attempt of each finished chunk."""
    marks = spark.read.schema(MARK).option("recursiveFileLookup", "true").parquet(f"{root}/marks")
    return marks.groupBy("chunk").agg(F.max_by("attempt", F.struct("loaded_at", "attempt")).alias("attempt"))


def open_chunks(spark: SparkSession, target: str) -> DataFrame:
    """Chunks of the ledger that no mark says are loaded."""
    root = target.rstrip("/")
    return spark.read.schema(LEDGER).parquet(f"{root}/ledger").join(_marks(spark, root), "chunk", "left_anti")


def _rows_of(source: DataFrame, first: bool, chunk, slice_seconds: int) -> DataFrame:
    """Source rows from where a chunk begins to where the next one does; bounds on the stream reach the scan."""
    at = F.struct(*KEY, _slice(slice_seconds))
    rows = source

    def bound(place) -> Column:
        return F.struct(F.lit(place["namespace"]).alias("namespace"), F.lit(place["name"]).alias("name"), F.lit(place["slice"]).alias("slice"))

    if not first:
        rows = rows.filter((F.col("namespace") >= chunk["namespace"]) & (at >= bound(chunk)))
    if chunk["next"] is not None:
        rows = rows.filter((F.col("namespace") <= chunk["next"]["namespace"]) & (at < bound(chunk["next"])))
    return rows


def resume_backfill(spark: SparkSession, source: DataFrame, target: str, slice_seconds: int = 3600) -> Iterator[int]:
    """Load the open chunks one by one, in order; gives the number of each once its mark is written.

    The ledger has one row per chunk, so its length is the chosen number of loads.
    """
    root = target.rstrip("/")
    for chunk in open_chunks(spark, root).orderBy("chunk").collect():
        attempt = uuid.uuid4().hex
        number = chunk["chunk"]
        _rows_of(source, number == 0, chunk, slice_seconds).write.parquet(f"{root}/rows/chunk={number}/attempt={attempt}")
        mark = spark.range(1).select(F.lit(number).cast("long").alias("chunk"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("loaded_at"))
        mark.write.parquet(f"{root}/marks/{number}-{attempt}")
        yield number


def backfilled_rows(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """Rows of finished chunks; what a load that was cut off left behind is not read."""
    root = target.rstrip("/")
    folders = [f"{root}/rows/chunk={r['chunk']}/attempt={r['attempt']}" for r in _marks(spark, root).collect()]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)
