"""Runs (jobs and cron jobs): state, drift, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwright.operators.definitions import KEY
from fleetwright.vocabulary import BATCH_JOB, CONFIGURATION_HASH, CRON_JOB, LABEL_PREFIX, NO_BACKEND


def has_condition(conditions: str, kind: str) -> Column:
    """A condition of the kind is present with status True."""
    return F.exists(conditions, lambda c: (c["type"] == kind) & (c["status"] == "True"))


def job_state(runs: DataFrame) -> DataFrame:
    """Add ``is_completed`` and ``is_failed`` to runs with ``backend`` and ``conditions``.

    Only batch jobs are read from their conditions. Cron jobs are neither; the empty
    backend counts as completed.
    """
    is_job = F.col("backend") == BATCH_JOB
    return runs.withColumns(
        {
            "is_completed": (F.col("backend") == NO_BACKEND)
            | (is_job & F.coalesce(has_condition("conditions", "Complete"), F.lit(False))),
            "is_failed": is_job & F.coalesce(has_condition("conditions", "Failed"), F.lit(False)),
        }
    )


def is_backfill_run(labels: str = "labels", prefix: str = LABEL_PREFIX) -> Column:
    """The backfilling label says true, in any case; no label means no."""
    value = F.element_at(F.col(labels), F.lit(f"{prefix}/backfilling"))
    return F.coalesce(F.lower(value) == "true", F.lit(False))


def stream_job(streams: DataFrame, jobs: DataFrame) -> DataFrame:
    """Streams with the job of the same key, or nulls."""
    state = jobs.select(
        *KEY,
        "job_id",
        F.lit(True).alias("job_exists"),
        has_condition("conditions", "Complete").alias("job_completed"),
        has_condition("conditions", "Failed").alias("job_failed"),
    )
    return streams.join(state, KEY, "left").fillna(
        False, ["job_exists", "job_completed", "job_failed"]
    )


def previous_backend(streams_with_job: DataFrame, cron_jobs: DataFrame) -> DataFrame:
    """Backend of the run that exists now: a cron job before a job; old layouts know jobs only."""
    crons = cron_jobs.select(*KEY, F.lit(True).alias("_cron"))
    return (
        streams_with_job.join(crons, KEY, "left")
        .withColumn(
            "previous_backend",
            F.when(F.col("layout_version") == "", BATCH_JOB)
            .when(F.col("_cron"), CRON_JOB)
            .when(F.col("job_exists"), BATCH_JOB),
        )
        .drop("_cron")
    )


def runs_by_kind(jobs: DataFrame, cron_jobs: DataFrame) -> DataFrame:
    """Jobs and cron jobs in one table, with the hash they were made from."""
    applied = F.element_at("annotations", F.lit(CONFIGURATION_HASH)).alias("run_hash")
    return jobs.select(*KEY, F.lit(BATCH_JOB).alias("run_kind"), applied).unionByName(
        cron_jobs.select(*KEY, F.lit(CRON_JOB).alias("run_kind"), applied)
    )


def configuration_drift(streams: DataFrame, jobs: DataFrame, cron_jobs: DataFrame) -> DataFrame:
    """What applying each stream would do to its run: create, keep, recreate, or an error.

    ``current_hash`` is the checksum of the spec alone; a request is never part of it, so
    an existing backfill run always differs.
    """
    runs = runs_by_kind(jobs, cron_jobs).withColumnRenamed("run_kind", "backend")
    wanted = streams.filter(F.col("backend") != NO_BACKEND).select(*KEY, "backend", "current_hash")
    joined = wanted.join(runs.withColumn("_run", F.lit(True)), [*KEY, "backend"], "left")
    drift = (
        F.when(F.col("_run").isNull(), "create")
        .when(F.col("run_hash").isNull(), "error")
        .when(F.col("run_hash") == F.col("current_hash"), "keep")
        .otherwise("recreate")
    )
    return joined.select(*KEY, "backend", "current_hash", "run_hash", drift.alias("drift"))


def orphan_runs(streams: DataFrame, jobs: DataFrame, cron_jobs: DataFrame) -> DataFrame:
    """Runs whose stream is gone, and runs of a kind the stream no longer uses.

    One left join answers both; a backfill job of a scheduled stream is still a wrong kind.
    """
    runs = runs_by_kind(jobs, cron_jobs).select(*KEY, "run_kind")
    joined = runs.join(streams.select(*KEY, "backend", F.lit(True).alias("_stream")), KEY, "left")
    reason = F.when(F.col("_stream").isNull(), "stream is gone").when(
        ~F.col("backend").eqNullSafe(F.col("run_kind")), "backend has changed"
    )
    return joined.select(*KEY, "run_kind", reason.alias("reason")).filter("reason IS NOT NULL")


def suspended_but_running(streams: DataFrame, jobs: DataFrame, cron_jobs: DataFrame) -> DataFrame:
    """Suspended streams that still have a run."""
    runs = runs_by_kind(jobs, cron_jobs).select(*KEY)
    return streams.filter("suspended").select(*KEY, "phase", "backend").join(runs, KEY, "left_semi")


def missing_templates(resolved: DataFrame, templates: DataFrame) -> DataFrame:
    """Streams whose resolved template does not exist, with the event their run would raise."""
    known = templates.select(
        F.col("namespace").alias("template_namespace"), F.col("name").alias("template_name")
    )
    lost = resolved.filter("error IS NULL").drop("error")
    return lost.join(known, ["template_namespace", "template_name"], "left_anti").select(
        *KEY,
        "template_namespace",
        "template_name",
        F.lit("Warning").alias("event_type"),
        F.lit("FailedCreateJob").alias("event_reason"),
    )
