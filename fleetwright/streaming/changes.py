"""Newest row per key, kept in Spark's streaming state.

The state is one streaming aggregation (``max_by`` of the whole row) in update mode: it combines
before the shuffle, is checkpointed by Spark and gives each batch's touched keys with their newest
row. A batch writes those to a folder of its own and overwrites only that, so a repeated batch
changes nothing. A reader takes each key's row of the last batch that has one, by one aggregation over
the folders. Their compaction is left to a table format or a retention job: a copy of the newest rows
under a later batch number may take the place of all before it. For many keys choose RocksDB
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from fleetwright.functions.latest import latest_per_key


def run_available(
    stream: DataFrame, checkpoint: str, per_batch: Callable[[DataFrame, int], None], mode: str = "append"
) -> None:
    """Process what is there and stop; the next call with the same checkpoint goes on from there."""
    query = (
        stream.writeStream.foreachBatch(per_batch)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def keep_newest(stream: DataFrame, keys: Sequence[str], order: Sequence[str], checkpoint: str, target: str) -> None:
    """Take over what is there: the row with the largest ``order`` (unique per key), whatever the order of arrival."""
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{target}/batch_id=-1")
    run_available(
        latest_per_key(stream, keys, order),
        checkpoint,
        lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}"),
        "update",
    )


def stored_rows(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The newest row of each key as of each batch that had rows of the key, with ``batch_id``."""
    rows = spark.read.schema(schema).parquet(target)
    return rows.withColumn("batch_id", F.col("batch_id").cast("long"))


def newest_rows(spark: SparkSession, target: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """Newest row of each key over all batches."""
    return latest_per_key(stored_rows(spark, target, schema), list(keys), ["batch_id"]).select(*schema.names)


def stored_changes(
    spark: SparkSession, target: str, schema: StructType, keys: Sequence[str], column: str, start: str
) -> DataFrame:
    """Stored rows whose ``column`` differs from the key's row before, which is ``start`` at first.

    A batch stores one row per key, so even the busiest key has no more rows here than there were batches.
    """
    before = F.lag(column).over(W.partitionBy(*keys).orderBy("batch_id"))
    rows = stored_rows(spark, target, schema).withColumn("_before", F.coalesce(before, F.lit(start)))
    return rows.filter(~F.col("_before").eqNullSafe(F.col(column))).drop("_before")
