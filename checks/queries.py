"""Every operator as a query over the sample tables: ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetwright.operators import (
    assembly,
    backfills,
    census,
    classes,
    definitions,
    feeds,
    gaps,
    listings,
    loads,
    parameters,
    requests,
    runs,
    schedules,
    status,
)
from fleetwright.plans import class_lifecycle, lifecycle
from fleetwright.session import new_folder
from fleetwright.sources.files import change_feed, source_stream, source_table
from fleetwright.sources.sample_fleet import fleet_table
from fleetwright.streaming import jobs
from fleetwright.streaming.changes import newest_rows
from fleetwright.vocabulary import BATCH_JOB, CRON_JOB, NO_BACKEND

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEY = definitions.KEY

# The data source of the load queries: when the backfill was taken and the stream started.
BACKFILL_END = "2024-01-15"
STREAM_START = "2024-01-14"
GAP = ("2024-01-10", "2024-01-12")


def deleted() -> Column:
    return F.col("event_type") == "error"



def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


class Fleet:
    """Short access to the fleet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return fleet_table(self.spark, self.folder, name)

    @property
    def state(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        return self.stream_def, self.backfill_request, self.job_run, self.cron_run

    @property
    def hashed_streams(self) -> DataFrame:
        return self.stream_def.withColumn("current_hash", F.md5("spec_json"))

    @property
    def definitions_with_request(self) -> DataFrame:
        normalized = definitions.definitions_normalized(self.raw_definition)
        return requests.stream_open_request(normalized, self.backfill_request)

    @property
    def built_runs(self) -> DataFrame:
        asked = requests.stream_open_request(self.stream_run, self.backfill_request)
        return parameters.run_parameters(asked)

    @property
    def bare_runs(self) -> DataFrame:
        """Runs before any step, with their request columns."""
        asked = requests.stream_open_request(self.stream_run, self.backfill_request)
        return parameters.with_request_columns(asked)

    @property
    def source(self) -> DataFrame:
        return self.source_row


# Definitions


@query
def definitions_normalized(spark, folder):
    return definitions.definitions_normalized(Fleet(spark, folder).raw_definition)


@query
def definitions_quarantine(spark, folder):
    return definitions.definitions_quarantine(Fleet(spark, folder).raw_definition)


@query
def backend_resolved(spark, folder):
    normalized = definitions.definitions_normalized(Fleet(spark, folder).raw_definition)
    return normalized.select(*KEY, "backend")


@query
def schedule_resolved(spark, folder):
    normalized = definitions.definitions_normalized(Fleet(spark, folder).raw_definition)
    return normalized.select(*KEY, "backend", "schedule")


@query
def template_ref_resolved(spark, folder):
    return definitions.template_ref_resolved(Fleet(spark, folder).definitions_with_request)


# Requests


@query
def stream_open_request(spark, folder):
    f = Fleet(spark, folder)
    return requests.stream_open_request(f.stream_def, f.backfill_request).select(
        *KEY, "request_id", "request_name", "request_class"
    )


@query
def initial_backfill_requests(spark, folder):
    return requests.initial_backfill_requests(Fleet(spark, folder).stream_def)


@query
def open_request_events(spark, folder):
    f = Fleet(spark, folder)
    return requests.open_request_events(f.watch_event, f.stream_class).select(
        "seq", "namespace", "owner_name", "verb", "stream_class"
    )


@query
def request_to_stream(spark, folder):
    f = Fleet(spark, folder)
    events = f.backfill_request.select("namespace", "stream_id", "request_name")
    return requests.request_to_stream(events, f.stream_def)


# Runs


@query
def job_state(spark, folder):
    f = Fleet(spark, folder)
    nothing = F.lit(None).cast("array<struct<type:string,status:string>>")
    every = (
        f.job_run.select(*KEY, F.lit(BATCH_JOB).alias("backend"), "conditions")
        .unionByName(f.cron_run.select(*KEY, F.lit(CRON_JOB).alias("backend"), nothing.alias("conditions")))
        .unionByName(
            f.stream_def.filter(F.col("backend") == NO_BACKEND).select(
                *KEY, "backend", nothing.alias("conditions")
            )
        )
    )
    return runs.job_state(every).drop("conditions")


@query
def is_backfill_run(spark, folder):
    return Fleet(spark, folder).job_run.select(*KEY, "job_id", runs.is_backfill_run().alias("is_backfill"))


@query
def stream_job(spark, folder):
    f = Fleet(spark, folder)
    return runs.stream_job(f.stream_def.select(*KEY, "phase"), f.job_run)


@query
def previous_backend(spark, folder):
    f = Fleet(spark, folder)
    with_job = runs.stream_job(f.stream_def.select(*KEY, "layout_version", "backend"), f.job_run)
    return runs.previous_backend(with_job, f.cron_run).select(*KEY, "backend", "previous_backend")


@query
def configuration_drift(spark, folder):
    f = Fleet(spark, folder)
    return runs.configuration_drift(f.hashed_streams, f.job_run, f.cron_run)


@query
def orphan_runs(spark, folder):
    f = Fleet(spark, folder)
    return runs.orphan_runs(f.remaining_stream, f.job_run, f.cron_run)


@query
def suspended_but_running(spark, folder):
    f = Fleet(spark, folder)
    return runs.suspended_but_running(f.stream_def, f.job_run, f.cron_run)


@query
def missing_templates(spark, folder):
    f = Fleet(spark, folder)
    resolved = definitions.template_ref_resolved(f.definitions_with_request)
    return runs.missing_templates(resolved, f.template_record)


# Life cycle


@query
def lifecycle_plan(spark, folder):
    return lifecycle.lifecycle_plan(*Fleet(spark, folder).state)


@query
def apply_outcomes(spark, folder):
    f = Fleet(spark, folder)
    return lifecycle.apply_outcomes(lifecycle.lifecycle_plan(*f.state), f.hashed_streams, f.job_run, f.cron_run)


@query
def lifecycle_plan_summary(spark, folder):
    plan = lifecycle.lifecycle_plan(*Fleet(spark, folder).state)
    return plan.groupBy("rule", "action", "next_phase").agg(F.count(F.lit(1)).alias("streams"))


@query
def lifecycle_events(spark, folder):
    return lifecycle.lifecycle_events(lifecycle.lifecycle_plan(*Fleet(spark, folder).state))


@query
def event_reason_counts(spark, folder):
    plan = lifecycle.lifecycle_plan(*Fleet(spark, folder).state)
    return census.event_reason_counts(lifecycle.lifecycle_events(plan))


@query
def backend_transitions(spark, folder):
    return lifecycle.backend_transitions(*Fleet(spark, folder).state)


@query
def class_lifecycle_plan(spark, folder):
    return class_lifecycle.class_lifecycle_plan(Fleet(spark, folder).class_state)


# Listings and counts


@query
def class_listing(spark, folder):
    return listings.class_listing(Fleet(spark, folder).class_state)


@query
def template_listing(spark, folder):
    return listings.template_listing(Fleet(spark, folder).template_record)


@query
def request_listing(spark, folder):
    return listings.request_listing(Fleet(spark, folder).backfill_request)


@query
def stream_listing(spark, folder):
    return listings.stream_listing(Fleet(spark, folder).stream_def)


@query
def activation_batch(spark, folder):
    return listings.activation_batch(Fleet(spark, folder).stream_def)


@query
def phase_census(spark, folder):
    return census.phase_census(Fleet(spark, folder).stream_def)


@query
def run_census(spark, folder):
    return census.run_census(Fleet(spark, folder).run_observation)


# Status


@query
def status_conditions(spark, folder):
    f = Fleet(spark, folder)
    return status.status_conditions(requests.stream_open_request(f.stream_def, f.backfill_request))


@query
def status_rows(spark, folder):
    f = Fleet(spark, folder)
    asked = requests.stream_open_request(f.stream_def, f.backfill_request)
    return status.status_rows(asked, status.phase_transitions(f.phase_event))


@query
def phase_transitions(spark, folder):
    return status.phase_transitions(Fleet(spark, folder).phase_event)


@query
def time_in_phase(spark, folder):
    return status.time_in_phase(Fleet(spark, folder).phase_event)


@query
def latest_state(spark, folder):
    return status.latest_state(Fleet(spark, folder).phase_event)


# Classes


@query
def class_streams(spark, folder):
    f = Fleet(spark, folder)
    return classes.class_streams(f.stream_class, f.stream_def)


@query
def secret_ref_fields(spark, folder):
    f = Fleet(spark, folder)
    specs = definitions.definitions_normalized(f.raw_definition).select(*KEY, "spec_json")
    streams = f.stream_def.select(*KEY, "stream_class").join(specs, KEY)
    return classes.secret_ref_fields(f.class_registry_state, streams)


@query
def class_metric_tags(spark, folder):
    return classes.class_metric_tags(Fleet(spark, folder).class_state)


@query
def metric_export_rows(spark, folder):
    rows = classes.metric_export_rows(Fleet(spark, folder).class_state)
    return rows.withColumn("tags", F.array_join("tags", ","))


@query
def class_registry(spark, folder):
    return classes.class_registry(Fleet(spark, folder).class_feed)


@query
def heartbeat_counts(spark, folder):
    return classes.heartbeat_counts(Fleet(spark, folder).class_feed)


def _intervals(feed):
    ticks = classes.Ticks(*classes.feed_range(feed))
    return classes.heartbeat_intervals(feed, ticks), ticks


@query
def heartbeat_intervals(spark, folder):
    spans, ticks = _intervals(Fleet(spark, folder).class_feed)
    return spans.select("*", *(ticks.at(F.col(f"{end}_tick")).alias(f"{end}_at") for end in ("first", "last")))


@query
def heartbeats_at(spark, folder):
    """Whether the class of each watched event was last reported as live."""
    fleet = Fleet(spark, folder)
    spans, ticks = _intervals(fleet.class_feed)
    asked = fleet.watch_event.select("seq", "ts", F.expr("concat('Kind', cast(seq % 7 AS STRING), 'Stream')").alias("kind"))
    return classes.heartbeats_at(spans, ticks, asked)


@query
def heartbeat_windows(spark, folder):
    return classes.heartbeat_windows(Fleet(spark, folder).class_feed)


# Feeds


@query
def merged_feed(spark, folder):
    f = Fleet(spark, folder)
    jobs_feed = f.job_run.select(*KEY, "job_id")
    crons = f.cron_run.select(*KEY)
    asked = f.backfill_request.select("namespace", F.col("stream_id").alias("name"), "request_id")
    return feeds.merged_feed({"Job": jobs_feed, "CronJob": crons, "BackfillRequest": asked})


@query
def relevant_job_events(spark, folder):
    return feeds.relevant_run_events(Fleet(spark, folder).watch_event).select(
        "seq", "kind", "verb", "namespace", "owner_name"
    )


@query
def event_to_owner(spark, folder):
    f = Fleet(spark, folder)
    return feeds.event_to_owner(f.owned_event, f.stream_def)


# Run parameters


@query
def configuration_checksums(spark, folder):
    f = Fleet(spark, folder)
    return parameters.configuration_checksums(
        requests.stream_open_request(f.stream_def, f.backfill_request)
    )


@query
def run_parameters(spark, folder):
    return parameters.variables(Fleet(spark, folder).built_runs)


@query
def run_labels(spark, folder):
    return parameters.entries(Fleet(spark, folder).built_runs, "labels")


@query
def run_annotations(spark, folder):
    return parameters.entries(Fleet(spark, folder).built_runs, "annotations")


@query
def run_owners(spark, folder):
    return parameters.owners(Fleet(spark, folder).built_runs)


@query
def run_parameter_errors(spark, folder):
    return parameters.errors(Fleet(spark, folder).built_runs)


def _built(spark, folder, *steps) -> DataFrame:
    return parameters.build(Fleet(spark, folder).bare_runs, steps)


@query
def run_key(spark, folder):
    return _built(spark, folder, parameters.run_key()).select(*KEY, "run_name", "run_namespace", "error")


@query
def stream_metadata_variables(spark, folder):
    return parameters.variables(_built(spark, folder, parameters.stream_metadata()))


@query
def spec_variable(spark, folder):
    return parameters.variables(_built(spark, folder, parameters.stream_context("spec", "spec_json")))


@query
def backfill_flag(spark, folder):
    asked = F.col("override_json").isNotNull()
    return parameters.variables(_built(spark, folder, parameters.backfill_flag(asked)))


@query
def static_backfill_id(spark, folder):
    asked = F.col("override_json").isNotNull()
    return parameters.variables(_built(spark, folder, parameters.static_backfill_id("request_name", asked)))


@query
def dynamic_backfill_id(spark, folder):
    return parameters.variables(_built(spark, folder, parameters.dynamic_backfill_id(F.col("scheduled"))))


@query
def request_part(spark, folder):
    return parameters.variables(_built(spark, folder, *parameters.request_part()))


@query
def checksum_annotation(spark, folder):
    return parameters.entries(_built(spark, folder, parameters.checksum_annotation()), "annotations")


@query
def owner_reference(spark, folder):
    return parameters.owners(_built(spark, folder, parameters.owner_reference()))


@query
def request_override(spark, folder):
    f = Fleet(spark, folder)
    asked = requests.stream_open_request(f.stream_def, f.backfill_request)
    override = F.concat(
        F.lit('{"destination":"redo-'), F.col("request_id").cast("string"), F.lit('","streamId":"'),
        F.col("name"), F.lit('"}'),
    )
    return parameters.request_override(asked.withColumn("override_json", override))


def _assembled(f: Fleet) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    specs = definitions.definitions_normalized(f.raw_definition).select(*KEY, "spec_json")
    classed = f.stream_def.select(*KEY, "stream_class").join(specs, KEY)
    return (
        requests.stream_open_request(f.stream_def, f.backfill_request),
        definitions.template_ref_resolved(f.definitions_with_request),
        f.template_record,
        classes.secret_ref_fields(f.class_registry_state, classed),
    )


@query
def built_runs(spark, folder):
    return parameters.variables(assembly.assembled_runs(*_assembled(Fleet(spark, folder))))


@query
def built_run_images(spark, folder):
    return assembly.run_images(assembly.assembled_runs(*_assembled(Fleet(spark, folder))))


@query
def failed_runs(spark, folder):
    _, resolved, templates, _ = _assembled(Fleet(spark, folder))
    return assembly.failed_runs(resolved, templates)


# Data jobs


@query
def plugin_source_files(spark, folder):
    """The source written once as JSON and once as parquet, read back by the plugin readers."""
    f, place = Fleet(spark, folder), new_folder(spark, "source")
    rows, parts = f.source, []
    for file_format in ("parquet", "json"):
        path = f"{place}/{file_format}"
        rows.write.format(file_format).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").save(path)
        parts.append(
            source_table(spark, file_format, path, rows.schema).withColumn("format", F.lit(file_format))
        )
    return parts[0].unionByName(parts[1])


@query
def backfill_load(spark, folder):
    f = Fleet(spark, folder)
    asked = requests.open_requests(f.backfill_request)
    loaded, _ = loads.backfill_load(spark, f.source, asked, new_folder(spark, "backfill"), "1")
    return loaded


@query
def backfill_completed_requests(spark, folder):
    f = Fleet(spark, folder)
    asked = requests.open_requests(f.backfill_request)
    _, completed = loads.backfill_load(spark, f.source, asked, new_folder(spark, "backfill"), "1")
    return completed


@query
def scheduled_batch(spark, folder):
    f, target = Fleet(spark, folder), new_folder(spark, "scheduled")
    first = f.source.filter(F.col("ts") < F.lit(BACKFILL_END))
    loads.scheduled_batch(spark, first, target, "20240115T000000")
    loads.scheduled_batch(spark, f.source, target, "20240131T000000")
    return loads.latest_run(spark, target, f.source.schema)


def _feeds(f: Fleet) -> tuple[DataFrame, DataFrame]:
    return (
        f.source.filter(F.col("ts") < F.lit(BACKFILL_END)),
        f.source.filter(F.col("ts") >= F.lit(STREAM_START)),
    )


@query
def backfill_handoff(spark, folder):
    return loads.backfill_handoff(*_feeds(Fleet(spark, folder)), KEY, deleted())


@query
def backfill_handoff_rows(spark, folder):
    seam = (F.lit(STREAM_START).cast("timestamp_ntz"), F.lit(BACKFILL_END).cast("timestamp_ntz"))
    return loads.handoff_rows(*_feeds(Fleet(spark, folder)), *seam)


@query
def gap_fill(spark, folder):
    f = Fleet(spark, folder)
    hole = (F.col("ts") >= F.lit(GAP[0])) & (F.col("ts") < F.lit(GAP[1])) & (F.col("event_type") != "click")
    return loads.gap_fill(f.source, f.source.filter(~hole), *GAP)


@query
def configuration_number_texts(spark, folder):
    """Specs with numbers as the platform spells them, whose checksums are compared with those of runs."""
    found = definitions.definitions_normalized(fleet_table(spark, folder, "numbered_definition"))
    return found.select(*KEY, "spec_json", F.md5("spec_json").alias("checksum"))


@query
def scheduled_runs_allowed(spark, folder):
    """Which planned runs start where a stream's runs must not overlap; one stream has a third of them."""
    planned = fleet_table(spark, folder, "planned_run")
    return schedules.runs_allowed(planned).select(*KEY, "run_id", "allowed")


def _holed(f: Fleet) -> DataFrame:
    """The source with rows missing, rows changed and rows too many."""
    gone = (F.col("ts") >= "2024-01-10") & (F.col("ts") < "2024-01-10 06:00:00") & (F.col("event_type") != "click")
    kept = f.source.filter(~(gone | (F.col("event_id") % 501 == 5)))
    value = F.when(F.col("event_id") % 777 == 9, F.col("value") + 1).otherwise(F.col("value"))
    extra = f.source.filter("event_id % 901 = 1").withColumn("event_id", F.col("event_id") + 1_000_000_000)
    return kept.withColumn("value", value).unionByName(extra)


@query
def gap_ranges(spark, folder):
    """Hours in which a target differs from its source, found from weeks to days to hours."""
    f = Fleet(spark, folder)
    return gaps.gap_ranges(f.source, _holed(f))


@query
def gap_rows(spark, folder):
    f = Fleet(spark, folder)
    target = _holed(f)
    return gaps.missing_rows(f.source, target, gaps.gap_ranges(f.source, target))


@query
def backfill_chunks(spark, folder):
    return backfills.chunks(Fleet(spark, folder).source, 300).drop("next")


@query
def resumable_backfill(spark, folder):
    """A load that is stopped after three chunks and cut off in the fourth, and then resumed."""
    source, place = Fleet(spark, folder).source, new_folder(spark, "resumable")
    backfills.plan_backfill(spark, source, place, rows_per_chunk=source.count() // 8 + 1)
    load = backfills.resume_backfill(spark, source, place)
    done = [next(load) for _ in range(3)]
    source.filter("event_id % 2 = 0").write.parquet(f"{place}/rows/chunk={done[-1] + 1}/attempt=cut-off")
    for _ in backfills.resume_backfill(spark, source, place):
        pass
    return backfills.backfilled_rows(spark, place, source.schema)


@query
def handoff_by_stream(spark, folder):
    """Each stream has its own days on which its backfill finished and its changes began."""
    source = Fleet(spark, folder).source
    number = F.expr("CAST(substr(name, 8) AS INT)")
    finished_at = F.lit("2024-01-15").cast("timestamp_ntz") + F.make_dt_interval(number % 5)
    began_at = F.lit("2024-01-12").cast("timestamp_ntz") + F.make_dt_interval(number % 3)
    finished = source.select(*KEY, finished_at.alias("finished_at")).distinct()
    return loads.handoff_by_stream(source.filter(F.col("ts") < finished_at), source.filter(F.col("ts") >= began_at), finished)


# Streams


def _land(rows: DataFrame, feed: str) -> None:
    rows.write.mode("append").parquet(feed)


def _in_two_runs(spark, rows: DataFrame, place: str, run) -> None:
    """Land the rows in two parts by time; ``run(stream, checkpoint)`` after each, on one checkpoint."""
    feed = f"{place}/feed"
    for part in (F.col("ts") < F.lit(BACKFILL_END), F.col("ts") >= F.lit(BACKFILL_END)):
        _land(rows.filter(part), feed)
        run(source_stream(spark, "parquet", feed, rows.schema), f"{place}/checkpoint")


def _shuffled(spark, rows: DataFrame, place: str, run) -> None:
    """Five batches that are not in order of time, each by a new start on one checkpoint."""
    feed = f"{place}/feed"
    for part in (3, 0, 4, 1, 2):
        _land(rows.filter(F.col("seq") % 5 == part), feed)
        run(source_stream(spark, "parquet", feed, rows.schema), f"{place}/checkpoint")


@query
def change_feed_rows(spark, folder):
    """All four record kinds through one streaming source each, merged into one feed."""
    events, place = Fleet(spark, folder).watch_event, new_folder(spark, "feed")
    events.write.partitionBy("kind").parquet(f"{place}/feed")
    plain = StructType([f for f in events.schema if f.name != "kind"])
    kinds = {k: f"{place}/feed/kind={k}" for k in ("Job", "CronJob", "BackfillRequest", "Stream")}
    stream = feeds.merged_feed(change_feed(spark, kinds, plain))
    jobs.append_available(stream, f"{place}/checkpoint", f"{place}/out")
    return spark.read.schema(stream.schema).parquet(f"{place}/out").select("seq", "ts", "kind", "verb", "owner_name")


@query
def event_feed_filter(spark, folder):
    f, place = Fleet(spark, folder), new_folder(spark, "routed")
    events = f.watch_event
    _land(events, f"{place}/feed")
    feed = source_stream(spark, "parquet", f"{place}/feed", events.schema)
    routed = jobs.routed_events(feed, f.stream_def, f.stream_class)
    jobs.append_available(routed, f"{place}/checkpoint", f"{place}/out")
    return spark.read.schema(routed.schema).parquet(f"{place}/out")


@query
def events_of_changing_streams(spark, folder):
    """Odd streams are defined between the two batches; their earlier events concern nobody."""
    f, place = Fleet(spark, folder), new_folder(spark, "changing")
    events = f.watch_event
    f.stream_def.filter("c_custkey % 2 = 0").write.parquet(f"{place}/streams")
    step = jobs.route_events(
        lambda: spark.read.schema(f.stream_def.schema).parquet(f"{place}/streams"), lambda: f.stream_class, f"{place}/out"
    )
    for k, part in enumerate((F.col("ts") < F.lit(BACKFILL_END), F.col("ts") >= F.lit(BACKFILL_END))):
        _land(events.filter(part), f"{place}/feed")
        if k:
            f.stream_def.filter("c_custkey % 2 = 1").write.mode("append").parquet(f"{place}/streams")
        jobs.run_available(source_stream(spark, "parquet", f"{place}/feed", events.schema), f"{place}/checkpoint", step)
    schema = "namespace string, name string, seq long, kind string, verb string, phase string, batch_id long"
    return spark.read.schema(schema).parquet(f"{place}/out")


@query
def keyed_coalescing(spark, folder):
    events, place = Fleet(spark, folder).watch_event, new_folder(spark, "work")
    rows = events.withColumnRenamed("owner_name", "name")
    step = jobs.coalesce_keys(f"{place}/work")
    _in_two_runs(spark, rows, place, lambda stream, checkpoint: jobs.run_available(stream, checkpoint, step))
    schema = "namespace string, name string, batch_id long"
    return spark.read.schema(schema).parquet(f"{place}/work")


@query
def stream_phase_tracker(spark, folder):
    rows, place = Fleet(spark, folder).phase_event, new_folder(spark, "phases")
    step = jobs.track_phases(spark, place)
    _in_two_runs(spark, rows, place, lambda stream, checkpoint: jobs.run_available(stream, checkpoint, step))
    return jobs.phase_log(spark, place)


@query
def phase_log_under_disorder(spark, folder):
    """Five batches out of order: the log takes back what later rows prove wrong."""
    rows, place = Fleet(spark, folder).phase_event, new_folder(spark, "late-phases")
    step = jobs.track_phases(spark, place)
    _shuffled(spark, rows, place, lambda stream, checkpoint: jobs.run_available(stream, checkpoint, step))
    return jobs.phase_log(spark, place)


@query
def streaming_status_sink(spark, folder):
    rows, place = Fleet(spark, folder).phase_event, new_folder(spark, "status")
    _in_two_runs(spark, rows, place, lambda stream, checkpoint: jobs.status_sink(stream, checkpoint, f"{place}/status"))
    return newest_rows(spark, f"{place}/status", rows.schema, KEY).select(*KEY, "phase")


@query
def status_sink(spark, folder):
    """Two batches of wanted status, the second with all rows of the first; events are real changes only."""
    rows, place = Fleet(spark, folder).phase_event, new_folder(spark, "status")
    for batch in (rows.filter(F.col("ts") < F.lit(BACKFILL_END)), rows):
        _land(batch, f"{place}/feed")
        stream = source_stream(spark, "parquet", f"{place}/feed", rows.schema)
        jobs.status_sink(stream, f"{place}/checkpoint", f"{place}/status")
    return jobs.status_events(spark, f"{place}/status", rows.schema)


@query
def streaming_status_rows(spark, folder):
    """Phase, configuration checksum and condition of each stream's newest event, written together."""
    f, place = Fleet(spark, folder), new_folder(spark, "status-rows")
    asked = requests.stream_open_request(f.stream_def, f.backfill_request)
    defined = asked.select(*KEY, "spec_json", "request_name", "request_class")
    rows = f.phase_event.drop("namespace").join(defined, "name")

    def run(stream, checkpoint):
        written = status.with_status(stream).drop("spec_json", "request_name", "request_class")
        jobs.status_sink(written, checkpoint, f"{place}/status")

    _shuffled(spark, rows, place, run)
    schema = status.with_status(rows).drop("spec_json", "request_name", "request_class").schema
    return newest_rows(spark, f"{place}/status", schema, KEY)


@query
def streaming_heartbeats(spark, folder):
    feed, place = Fleet(spark, folder).class_feed, new_folder(spark, "beats")
    _land(feed, f"{place}/feed")
    stream = source_stream(spark, "parquet", f"{place}/feed", feed.schema)
    jobs.run_available(stream, f"{place}/checkpoint", jobs.count_heartbeats(f"{place}/out"))
    return jobs.counted_heartbeats(spark, f"{place}/out")


@query
def status_under_disorder(spark, folder):
    """The feed in five batches that are not in order of time, with a restart in between."""
    rows, place = Fleet(spark, folder).phase_event, new_folder(spark, "disorder")
    _shuffled(spark, rows, place, lambda stream, checkpoint: jobs.status_sink(stream, checkpoint, f"{place}/status"))
    return newest_rows(spark, f"{place}/status", rows.schema, KEY).select(*KEY, "ts", "phase")


@query
def change_capture(spark, folder):
    rows, place = Fleet(spark, folder).source, new_folder(spark, "capture")
    _land(rows, f"{place}/feed")
    stream = source_stream(spark, "parquet", f"{place}/feed", rows.schema)
    jobs.change_capture(stream, f"{place}/checkpoint", f"{place}/target")
    return jobs.live(spark, f"{place}/target", rows.schema, deleted())


@query
def suspend_resume(spark, folder):
    """Stopped after the first half, resumed on the same checkpoint: as one full run."""
    rows, place = Fleet(spark, folder).source, new_folder(spark, "resume")
    _in_two_runs(spark, rows, place, lambda stream, checkpoint: jobs.change_capture(stream, checkpoint, f"{place}/target"))
    return jobs.live(spark, f"{place}/target", rows.schema, deleted())


@query
def restart_on_change(spark, folder):
    """The same feed under two configurations, which differ in what marks a delete.

    The second starts anew, with its own checkpoint and target.
    """
    rows, place = Fleet(spark, folder).source, new_folder(spark, "restart")
    _land(rows, f"{place}/feed")
    for marker in ("error", "purchase"):
        checksum = hashlib.md5(f'{{"deletedBy":"{marker}"}}'.encode()).hexdigest()
        stream = source_stream(spark, "parquet", f"{place}/feed", rows.schema)
        marked = stream.withColumn("deleted", F.col("event_type") == marker)
        last = jobs.restart_on_change(place, checksum, lambda checkpoint, target: jobs.change_capture(marked, checkpoint, target))
    return jobs.live(spark, last, marked.schema, F.col("deleted")).drop("deleted")
