"""Files in the cluster's shared folder, and rows kept there between steps."""

from __future__ import annotations

import os
import uuid

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetwright.session import new_folder


def let_workers_import(spark: SparkSession) -> None:
    """Workers on this machine find this package where the driver found it; a cluster ships it (``--py-files``)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once below the shared folder and read from there: lineage ends here, and
    values that depend on the partitioning stay as they are when executors are lost."""
    spark = df.sparkSession
    folder = new_folder(spark, purpose)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def write_file(folder: str, name: str, content: bytes) -> None:
    """Write a file under its final name at once, so that a repeated task leaves no half a file."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    attempt = f"{root}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(attempt, compression=None) as out:
        out.write(content)
    fs.move(attempt, f"{root}/{name}")


def open_file(folder: str, name: str):
    """A file for random reads."""
    fs, root = pafs.FileSystem.from_uri(folder)
    return fs.open_input_file(f"{root}/{name}")


def uri_of(folder: str) -> str:
    """An absolute path or URI that tasks on any machine understand."""
    return folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def bases(totals: DataFrame, part: str, amount: str) -> DataFrame:
    """Sum of ``amount`` over all lower ``part`` numbers. One row per partition of a job comes in,
    so the window over all of them is short however large the data."""
    sums = totals.groupBy(part).agg(F.sum(amount).alias("_sum"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias("base"))


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether an id belongs to the part that nothing is learned from; a null one does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))
