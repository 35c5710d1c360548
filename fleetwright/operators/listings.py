"""The columns an operator lists for each record kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.operators.definitions import KEY


def class_listing(classes: DataFrame) -> DataFrame:
    return classes.select(
        "class_name", "api_group_ref", "api_version", "kind_ref", "plural_name", "phase"
    )


def template_listing(templates: DataFrame) -> DataFrame:
    """Limits and image of a template's first container."""
    first = F.get("containers", F.lit(0))
    return templates.select(
        *KEY,
        F.element_at(first["limits"], "memory").alias("memory_limit"),
        F.element_at(first["limits"], "cpu").alias("cpu_limit"),
        first["image"].alias("image"),
    )


def request_listing(requests: DataFrame) -> DataFrame:
    return requests.select("namespace", "request_name", "stream_class", "stream_id", "completed")


def stream_listing(streams: DataFrame) -> DataFrame:
    return streams.select(*KEY, "stream_class", "phase", "suspended")


def activation_batch(streams: DataFrame, size: int = 300) -> DataFrame:
    """The first suspended streams by key, to be activated together (top-k, no full sort)."""
    return (
        streams.filter(F.col("phase") == "Suspended").select(*KEY, "stream_class").orderBy(*KEY).limit(size)
    )
