"""Plugin sources: parquet and JSON files, as tables or as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "json")


def _checked(file_format: str) -> str:
    if file_format not in FORMATS:
        raise ValueError(f"unknown source format {file_format!r}, known are {FORMATS}")
    return file_format


def source_table(spark: SparkSession, file_format: str, path: str, schema: StructType | str) -> DataFrame:
    """Files below ``path`` with a given schema; nothing is inferred, so no extra pass."""
    return spark.read.format(_checked(file_format)).schema(schema).load(path)


def source_stream(
    spark: SparkSession,
    file_format: str,
    path: str,
    schema: StructType | str,
    max_bytes_per_trigger: int | None = None,
) -> DataFrame:
    """New files below ``path`` as a stream; ``max_bytes_per_trigger`` bounds a micro-batch."""
    reader = spark.readStream.format(_checked(file_format)).schema(schema)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return reader.load(path)


def change_feed(
    spark: SparkSession, folders: dict[str, str], schema: StructType | str, file_format: str = "parquet"
) -> dict[str, DataFrame]:
    """One stream per record kind, to be merged with ``operators.feeds.merged_feed``."""
    return {kind: source_stream(spark, file_format, path, schema) for kind, path in folders.items()}
