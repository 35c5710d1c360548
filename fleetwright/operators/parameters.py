"""Parameters of a run: variables, labels, annotations and owners.

Each step says what it changes; ``build`` applies a list of steps in order, in one pass
over a row. The first step that fails stops the chain: its text goes into ``error`` and the
row stays as it was. Rows carry ``containers``, ``labels``, ``annotations`` and
``owner_references``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.environment import Variable, has_variable, put, set_variables
from fleetwright.functions.text import configuration_checksum, request_json
from fleetwright.operators.definitions import KEY
from fleetwright.vocabulary import (
    BACKFILL,
    BACKFILL_ID,
    CONFIGURATION_HASH,
    CRON_JOB,
    LABEL_PREFIX,
    PENDING,
    RUN_ID_FIELD,
    STREAM_ID,
    STREAM_KIND,
    VARIABLE_PREFIX,
)


@dataclass(frozen=True)
class Step:
    """What one step changes on a run. ``only`` restricts it to some rows."""

    columns: dict[str, Column] = field(default_factory=dict)
    variables: tuple[Variable, ...] = ()
    labels: dict[str, Column] = field(default_factory=dict)
    annotations: dict[str, Column] = field(default_factory=dict)
    owner: Column | None = None
    error: Column | None = None
    only: Column | None = None

    def where(self, value: Column) -> Column:
        return value if self.only is None else F.when(self.only, value)


def _latest(steps: Sequence[Step], part: str) -> dict[str, Column]:
    """Entries of all steps by key; where several steps set a key, the last that holds wins."""
    entries: dict[str, Column] = {}
    for step in steps:
        for key, value in getattr(step, part).items():
            value = step.where(value)
            entries[key] = F.coalesce(value, entries[key]) if key in entries else value
    return entries


def build(runs: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Runs after all steps."""
    errors = [s.where(s.error) for s in steps if s.error is not None]
    variables = [
        replace(v, only=s.only) if s.only is not None else v for s in steps for v in s.variables
    ]
    owners = [s.where(s.owner) for s in steps if s.owner is not None]
    changes = {name: value for s in steps for name, value in s.columns.items()}
    if variables:
        changes["containers"] = set_variables(F.col("containers"), variables)
    for part in ("labels", "annotations"):
        entries = _latest(steps, part)
        if entries:
            changes[part] = put(F.col(part), entries)
    if owners:
        changes["owner_references"] = F.concat("owner_references", F.array_compact(F.array(*owners)))
    checked = runs.withColumn("error", F.coalesce(*errors) if errors else F.lit(None).cast("string"))
    valid = F.col("error").isNull()
    return checked.withColumns(
        {
            name: F.when(valid, value).otherwise(F.col(name)) if name in runs.columns else F.when(valid, value)
            for name, value in changes.items()
        }
    )


def run_key() -> Step:
    """Take name and namespace from the stream; neither may be empty."""
    error = F.when(F.col("name") == "", "job name is empty").when(
        F.col("namespace") == "", "namespace is empty"
    )
    return Step(columns={"run_name": F.col("name"), "run_namespace": F.col("namespace")}, error=error)


def stream_metadata(prefix: str = LABEL_PREFIX) -> Step:
    """Stream id and kind as variables, which must not be taken yet, and as labels."""
    taken = "environment variable {} already present"
    error = (
        F.when(F.col("name") == "", "stream id is empty")
        .when(F.col("kind") == "", "stream kind is empty")
        .when(has_variable(F.col("containers"), STREAM_ID), taken.format(STREAM_ID))
        .when(has_variable(F.col("containers"), STREAM_KIND), taken.format(STREAM_KIND))
    )
    return Step(
        variables=(
            Variable(STREAM_ID, F.col("name"), always_new=True),
            Variable(STREAM_KIND, F.col("kind"), always_new=True),
        ),
        labels={f"{prefix}/stream-id": F.col("name"), f"{prefix}/stream-kind": F.col("kind")},
        error=error,
    )


def stream_context(key: str, json_column: str, only: Column | None = None) -> Step:
    """A JSON text as variable; a second one of the same name is simply added."""
    value = F.coalesce(json_column, F.lit(""))
    return Step(variables=(Variable(VARIABLE_PREFIX + key.upper(), value, always_new=True),), only=only)


def owner_reference() -> Step:
    """Add the stream as controlling owner; owners already there stay."""
    return Step(
        owner=F.struct("api_version", "kind", "name", "uid", F.lit(True).alias("controller"))
    )


def backfill_flag(flag: Column, only: Column | None = None, prefix: str = LABEL_PREFIX) -> Step:
    """Whether the run is a backfill, as variable and as label."""
    text = flag.cast("string")
    return Step(variables=(Variable(BACKFILL, text),), labels={f"{prefix}/backfilling": text}, only=only)


def static_backfill_id(value: str, only: Column | None = None) -> Step:
    """Backfill id given by the request's name."""
    return Step(variables=(Variable(BACKFILL_ID, F.coalesce(value, F.lit(""))),), only=only)


def dynamic_backfill_id(only: Column | None = None) -> Step:
    """Backfill id that each run takes from its own name."""
    return Step(variables=(Variable(BACKFILL_ID, value_from=F.lit(RUN_ID_FIELD)),), only=only)


def request_part(prefix: str = LABEL_PREFIX) -> list[Step]:
    """No request: no backfill. A request: its spec as OVERRIDE, the flag and its name as id."""
    asked = F.col("override_json").isNotNull()
    return [
        stream_context("override", "override_json", only=asked),
        backfill_flag(asked, prefix=prefix),
        static_backfill_id("request_name", only=asked),
    ]


def checksum_annotation() -> Step:
    """Checksum the run is made from; it must not be empty, other annotations stay."""
    error = F.when(F.coalesce("checksum", F.lit("")) == "", "configuration checksum is empty")
    return Step(annotations={CONFIGURATION_HASH: F.col("checksum")}, error=error)


def scheduled_run() -> Column:
    """Whether the run to be built is a scheduled one; a pending stream answers its open request by a batch job."""
    return (F.col("backend") == CRON_JOB) & ~((F.col("phase") == PENDING) & F.col("request_name").isNotNull())


def with_request_columns(streams: DataFrame) -> DataFrame:
    """Add ``scheduled``, ``override_json``, ``request_name`` and ``checksum`` of the run to be built.

    Scheduled runs are always built with an empty placeholder request.
    """
    streams = streams.withColumn("scheduled", scheduled_run())
    cron = F.col("scheduled")
    asked = cron | F.col("request_name").isNotNull()
    spec = request_json(
        F.when(~cron, F.col("request_class")), F.when(~cron, F.col("name")), F.lit(False)
    )
    return streams.withColumns(
        {
            "override_json": F.when(asked, spec),
            "request_name": F.when(~cron, F.col("request_name")),
        }
    ).withColumn("checksum", configuration_checksum(F.col("spec_json"), F.col("override_json")))


def run_parameters(streams: DataFrame, prefix: str = LABEL_PREFIX) -> DataFrame:
    """All steps in the platform's order, for streams that carry their open request.

    Scheduled runs lose their labels in the end: only the inner part of the job goes into
    the cron job, whose own annotation is the checksum without the placeholder.
    """
    cron = F.col("scheduled")
    built = build(
        with_request_columns(streams),
        [
            run_key(),
            stream_metadata(prefix),
            stream_context("spec", "spec_json"),
            owner_reference(),
            backfill_flag(F.lit(True), only=cron, prefix=prefix),
            dynamic_backfill_id(only=cron),
            *request_part(prefix),
            checksum_annotation(),
        ],
    )
    nothing = F.create_map().cast("map<string,string>")
    own = F.create_map(F.lit(CONFIGURATION_HASH), F.md5("spec_json"))
    return built.withColumns(
        {
            "labels": F.when(cron, nothing).otherwise(F.col("labels")),
            "annotations": F.when(cron, own).otherwise(F.col("annotations")),
            "owner_references": F.when(cron, F.slice("owner_references", -1, 1)).otherwise(
                F.col("owner_references")
            ),
        }
    )


def variables(built: DataFrame) -> DataFrame:
    """One row per container and variable of runs without an error."""
    containers = built.filter("error IS NULL").select(*KEY, F.explode("containers").alias("c"))
    return containers.select(
        *KEY, F.col("c.name").alias("container"), F.posexplode("c.env").alias("position", "v")
    ).select(*KEY, "container", "position", F.col("v.name").alias("variable"), "v.value", "v.value_from")


def entries(built: DataFrame, column: str) -> DataFrame:
    """One row per label or annotation of runs without an error."""
    return built.filter("error IS NULL").select(*KEY, F.explode(column).alias("entry", "value"))


def owners(built: DataFrame) -> DataFrame:
    """One row per owner of runs without an error."""
    return (
        built.filter("error IS NULL")
        .select(*KEY, F.posexplode("owner_references").alias("position", "o"))
        .select(
            *KEY,
            "position",
            F.col("o.kind").alias("owner_kind"),
            F.col("o.name").alias("owner_name"),
            F.col("o.controller").alias("controller"),
        )
    )


def errors(built: DataFrame) -> DataFrame:
    return built.filter("error IS NOT NULL").select(*KEY, "error")


def configuration_checksums(streams: DataFrame) -> DataFrame:
    """Checksum of each stream's spec, and the combined one while a request is open."""
    request = request_json(F.col("request_class"), F.col("name"), F.lit(False))
    combined = configuration_checksum(
        F.col("spec_json"), F.when(F.col("request_name").isNotNull(), request)
    )
    return streams.select(*KEY, F.md5("spec_json").alias("spec_checksum"), combined.alias("checksum"))


def request_override(streams: DataFrame) -> DataFrame:
    """Settings a run ends up with: fields of ``override_json`` win over those of ``spec_json``."""
    fields = "map<string,string>"
    spec = F.coalesce(F.from_json("spec_json", fields), F.create_map().cast(fields))
    override = F.coalesce(F.from_json("override_json", fields), F.create_map().cast(fields))
    merged = F.map_concat(
        F.map_filter(spec, lambda k, _: ~F.map_contains_key(override, k)), override
    )
    return streams.select(*KEY, F.explode(merged).alias("field", "value"))
