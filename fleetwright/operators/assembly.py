"""Runs put together from the templates that streams refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.operators.definitions import KEY
from fleetwright.operators.parameters import run_parameters
from fleetwright.vocabulary import LABEL_PREFIX

_TEMPLATE = ["template_namespace", "template_name"]
_ENV = "array<struct<name:string,value:string,value_from:string>>"


def _with_template(resolved: DataFrame, templates: DataFrame) -> DataFrame:
    """Resolved references with the template's ``containers``, null where there is no such template."""
    known = templates.select(
        F.col("namespace").alias("template_namespace"), F.col("name").alias("template_name"), "containers"
    )
    return resolved.filter("error IS NULL").select(*KEY, *_TEMPLATE).join(known, _TEMPLATE, "left")


def assembled_runs(
    streams: DataFrame, resolved: DataFrame, templates: DataFrame, secrets: DataFrame, prefix: str = LABEL_PREFIX
) -> DataFrame:
    """Runs of all streams whose resolved template exists, after all steps.

    ``streams`` carry their open request. The template's containers start without variables and
    keep their images; ``secret_names`` are those of the class's fields (``secret_ref_fields``), in
    order, for every container. Names only, never values.
    """
    names = secrets.filter("secret_name IS NOT NULL").groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("position", "secret_name"))).getField("secret_name").alias("secret_names")
    )
    started = F.transform(
        "containers", lambda c: F.struct(c["name"].alias("name"), F.array().cast(_ENV).alias("env"))
    )
    rows = (
        streams.join(_with_template(resolved, templates).filter("containers IS NOT NULL"), KEY)
        .join(names, KEY, "left")
        .withColumns(
            {
                "images": F.transform("containers", lambda c: c["image"]),
                "containers": started,
                "secret_names": F.coalesce("secret_names", F.array().cast("array<string>")),
                "labels": F.create_map().cast("map<string,string>"),
                "annotations": F.create_map().cast("map<string,string>"),
                "owner_references": F.array().cast(
                    "array<struct<api_version:string,kind:string,name:string,uid:string,controller:boolean>>"
                ),
            }
        )
    )
    return run_parameters(rows, prefix)


def run_images(built: DataFrame) -> DataFrame:
    """One row per container of an assembled run, with its image and the secrets it is given."""
    both = F.arrays_zip(F.col("containers.name").alias("container"), F.col("images").alias("image"))
    rows = built.filter("error IS NULL").select(*KEY, F.inline(both), "secret_names")
    return rows.withColumn("secret_names", F.array_join("secret_names", ","))


def failed_runs(resolved: DataFrame, templates: DataFrame) -> DataFrame:
    """The events of runs that cannot be built, as their template does not exist."""
    lost = _with_template(resolved, templates).filter("containers IS NULL")
    # Type, reason and the start of the message as the platform writes them.
    message = F.concat(
        F.lit("failed to create job: failed to get template ("), F.concat_ws("/", *_TEMPLATE), F.lit(")")
    )
    return lost.select(
        *KEY, F.lit("Warning").alias("event_type"), F.lit("FailedCreateJob").alias("event_reason"), message.alias("message")
    )
