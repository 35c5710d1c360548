"""One life-cycle decision per stream.

The rules are an ordered list; the first one that holds decides. A single ``when`` chain
over a row that already has the stream's open request, job and previous backend finds the
rule's number; action, next phase and event come from a rule table of fixed size, which is
joined by that number. The plan is three key joins and one small broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwright.operators.definitions import KEY
from fleetwright.operators.requests import stream_open_request
from fleetwright.operators.runs import previous_backend, runs_by_kind, stream_job
from fleetwright.vocabulary import (
    BACKFILLING,
    BATCH_JOB,
    CRON_JOB,
    FAILED,
    NEW,
    NO_BACKEND,
    PENDING,
    RUNNING,
    SCHEDULED,
    SUSPENDED,
)


@dataclass(frozen=True)
class Rule:
    """One case. ``on_backend`` marks work done by the stream's own backend, which the empty
    backend answers with the bare event. ``{}`` in a message stands for the stream's name."""

    name: str
    when: str
    action: str
    next_phase: str
    event: tuple[str, str, str] | None
    on_backend: bool = True


NO_REQUEST = "request_name IS NULL"
REQUEST = "request_name IS NOT NULL"
CHANGED = f"{NO_REQUEST} AND previous_backend IS NOT NULL AND previous_backend <> backend"

# Actions, next phases and event texts of the platform's life cycle, in order.
RULES = [
    Rule("backfill job failed", f"phase = '{BACKFILLING}' AND job_failed", "remove", FAILED,
         ("Warning", "StreamingJobFailed", "The backfill job {} has failed"), False),
    Rule("job failed", "job_failed", "remove", FAILED,
         ("Warning", "StreamingJobFailed", "The streaming job {} has failed")),
    Rule("failed, suspended with request", f"phase = '{FAILED}' AND suspended AND {REQUEST}", "remove", SUSPENDED,
         ("Normal", "StreamSuspended", "The stream was suspended"), False),
    Rule("failed, suspended", f"phase = '{FAILED}' AND suspended", "remove", SUSPENDED,
         ("Normal", "StreamSuspended", "The stream was suspended")),
    Rule("failed", f"phase = '{FAILED}'", "remove", FAILED,
         ("Warning", "StreamingJobFailed", "The stream {} has failed")),
    Rule("new without backend", f"phase = '{NEW}' AND backend = '{NO_BACKEND}'", "none", NEW,
         ("Warning", "NoValidBackend", "No valid streaming backend configured for {}")),
    Rule("new, suspended", f"phase = '{NEW}' AND suspended", "remove", SUSPENDED,
         ("Normal", "StreamSuspended", "The new stream {} was added in the suspended state, nothing to do")),
    Rule("new batch job", f"phase = '{NEW}' AND backend = '{BATCH_JOB}'", "create request", PENDING,
         ("Normal", "StreamCreated", "Backfill was requested for the new stream definition: {}"), False),
    Rule("new cron job", f"phase = '{NEW}'", "none", PENDING, None),
    Rule("pending cron job", f"phase = '{PENDING}' AND {NO_REQUEST} AND backend = '{CRON_JOB}'", "apply", SCHEDULED,
         None),
    Rule("pending", f"phase = '{PENDING}' AND {NO_REQUEST}", "apply", RUNNING, None),
    Rule("pending with request", f"phase = '{PENDING}'", "apply", BACKFILLING, None, False),
    Rule("running, suspended", f"phase = '{RUNNING}' AND suspended", "remove", SUSPENDED,
         ("Normal", "StreamSuspended", "The streaming job for stream {} has been suspended")),
    Rule("running with request", f"phase = '{RUNNING}' AND {REQUEST}", "remove", PENDING,
         ("Normal", "BackfillRequested",
          "A backfill requested for stream {}, stopping the streaming job to start backfilling")),
    Rule("running, changed to batch job", f"phase = '{RUNNING}' AND {CHANGED} AND backend = '{BATCH_JOB}'",
         "switch", PENDING, ("Normal", "StreamScheduled", "The stream {} has been scheduled")),
    Rule("running, changed to cron job", f"phase = '{RUNNING}' AND {CHANGED} AND backend = '{CRON_JOB}'",
         "switch", PENDING, ("Normal", "StreamStarted", "The stream {} has been started")),
    Rule("running, changed to unknown backend", f"phase = '{RUNNING}' AND {CHANGED}", "error", "", None),
    Rule("running", f"phase = '{RUNNING}'", "apply", RUNNING,
         ("Normal", "StreamingContinued", "The streaming job for stream {} is continuing")),
    Rule("suspended, suspended with request", f"phase = '{SUSPENDED}' AND suspended AND {REQUEST}", "none", SUSPENDED,
         ("Normal", "BackfillSuspended", "A backfill was suspended for suspended stream {}")),
    Rule("suspended with request", f"phase = '{SUSPENDED}' AND NOT suspended AND {REQUEST}", "none", PENDING,
         ("Normal", "BackfillRequested", "A backfill was requested for suspended stream {}")),
    Rule("suspended, suspended", f"phase = '{SUSPENDED}' AND suspended", "remove", SUSPENDED,
         ("Normal", "StreamSuspended", "The stream {} remains suspended")),
    Rule("suspended", f"phase = '{SUSPENDED}'", "none", PENDING,
         ("Normal", "StreamResumed", "The stream {} has been resumed")),
    Rule("backfilling, suspended", f"phase = '{BACKFILLING}' AND suspended", "remove", SUSPENDED,
         ("Normal", "StreamSuspended", "The backfilling for stream {} has been suspended"), False),
    Rule("backfilling without request", f"phase = '{BACKFILLING}' AND {NO_REQUEST}", "complete", PENDING,
         ("Normal", "BackfillNotRequested", "The backfill request for stream {} not found, probably deleted"), False),
    Rule("backfilling without job", f"phase = '{BACKFILLING}' AND NOT job_exists", "apply", BACKFILLING,
         ("Normal", "BackfillStarted", "Backfill job for stream {} has been started")),
    Rule("backfilling, job completed", f"phase = '{BACKFILLING}' AND job_completed", "complete", PENDING,
         ("Normal", "BackfillCompleted", "Backfill for stream {} has been completed"), False),
    Rule("backfilling", f"phase = '{BACKFILLING}'", "none", BACKFILLING,
         ("Normal", "BackfillInProgress", "Backfill for stream {} is still in progress")),
    Rule("scheduled, suspended", f"phase = '{SCHEDULED}' AND suspended", "remove", SUSPENDED,
         ("Normal", "StreamSuspended", "The streaming job {} was suspended")),
    Rule("scheduled with request", f"phase = '{SCHEDULED}' AND {REQUEST}", "remove", PENDING,
         ("Normal", "BackfillRequested",
          "A backfill requested for stream {}, stopping the streaming job to start backfilling")),
    Rule("scheduled, changed to batch job", f"phase = '{SCHEDULED}' AND {CHANGED} AND backend = '{BATCH_JOB}'",
         "switch", PENDING, ("Normal", "StreamScheduled", "The stream {} has been scheduled")),
    Rule("scheduled, changed to cron job", f"phase = '{SCHEDULED}' AND {CHANGED} AND backend = '{CRON_JOB}'",
         "switch", PENDING, ("Normal", "StreamStarted", "The stream {} has been started")),
    Rule("scheduled, changed to unknown backend", f"phase = '{SCHEDULED}' AND {CHANGED}", "error", "", None),
    Rule("scheduled", f"phase = '{SCHEDULED}'", "apply", SCHEDULED,
         ("Normal", "StreamingScheduled", "The stream {} is scheduled")),
]


# Error texts, around the stream, its phase and its backend, and the event that shows them.
STEP_FAILED = ("failed to reconcile Stream FSM for ", ". Current state: phase=")
NO_TRANSITION = ("failed to transit backend for stream ", ": unknown backend ", " for stream ")
NOTHING_TO_APPLY = "no backend to apply for stream "
ERROR_EVENT = ("Warning", "StreamSuspended", "Failed to reconcile the stream: ")
UNMATCHED = Rule("unknown phase", "", "error", "", None, False)


def _literal(value) -> str:
    return "CAST(NULL AS STRING)" if value is None else repr(value).lower() if isinstance(value, bool) else f"'{value}'"


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as a table; its size is that of the list above."""
    rows = [
        f"({number}, "
        + ", ".join(
            _literal(v)
            for v in (r.name, r.action, r.next_phase, r.on_backend, *(r.event or (None, None, None)))
        )
        + ")"
        for number, r in enumerate([*RULES, UNMATCHED])
    ]
    columns = "rule_no, rule, rule_action, rule_phase, on_backend, rule_event_type, rule_event_reason, rule_event_message"
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS rules({columns})")


def rule_number() -> Column:
    """Number of the first rule that holds."""
    cases = " ".join(f"WHEN {rule.when} THEN {number}" for number, rule in enumerate(RULES))
    return F.expr(f"CASE {cases} ELSE {len(RULES)} END")


def stream_state(
    streams: DataFrame, requests: DataFrame, jobs: DataFrame, cron_jobs: DataFrame
) -> DataFrame:
    """Streams joined by key with their open request, job and previous backend."""
    with_request = stream_open_request(streams, requests)
    return previous_backend(stream_job(with_request, jobs), cron_jobs)


def decide(state: DataFrame) -> DataFrame:
    """Apply the rules to rows of ``stream_state``."""
    decided = state.withColumn("rule_no", rule_number()).join(
        F.broadcast(rule_table(state.sparkSession)), "rule_no"
    )

    idle = F.col("on_backend") & (F.col("backend") == NO_BACKEND)
    where = F.concat_ws("/", *KEY)
    error = (
        F.when(
            F.col("rule") == UNMATCHED.name,
            F.concat(F.lit(STEP_FAILED[0]), where, F.lit(STEP_FAILED[1]), F.col("phase")),
        )
        .when(
            F.col("rule_action") == "error",
            F.concat(F.lit(NO_TRANSITION[0]), where, F.lit(NO_TRANSITION[1]), F.col("backend"), F.lit(NO_TRANSITION[2]), where),
        )
        .when(
            idle & (F.col("rule_action") == "apply") & F.col("rule_event_reason").isNull(),
            F.concat(F.lit(NOTHING_TO_APPLY), where),
        )
    )
    failed = F.col("error").isNotNull()
    seen = F.col("idle") | (F.col("next_phase") != F.col("phase"))

    def event(field: str, on_error: Column) -> Column:
        shown = F.replace(F.col(f"rule_{field}"), F.lit("{}"), F.col("name"))
        return F.when(failed, on_error).when(seen, shown).alias(field)

    return (
        decided.withColumns({"idle": idle, "error": error})
        .withColumn("next_phase", F.when(failed | F.col("idle"), F.col("phase")).otherwise(F.col("rule_phase")))
        .select(
            *KEY,
            "stream_class",
            "phase",
            "rule",
            F.when(failed, "error").when(F.col("idle"), "none").otherwise(F.col("rule_action")).alias("action"),
            "next_phase",
            event("event_type", F.lit(ERROR_EVENT[0])),
            event("event_reason", F.lit(ERROR_EVENT[1])),
            event("event_message", F.concat(F.lit(ERROR_EVENT[2]), F.col("error"))),
            F.when(F.col("rule") == "backfilling, job completed", F.col("request_name")).alias(
                "completed_request"
            ),
            "error",
        )
    )


def lifecycle_plan(
    streams: DataFrame, requests: DataFrame, jobs: DataFrame, cron_jobs: DataFrame
) -> DataFrame:
    """The next step of every stream."""
    return decide(stream_state(streams, requests, jobs, cron_jobs))


def apply_outcomes(plan: DataFrame, streams: DataFrame, jobs: DataFrame, cron_jobs: DataFrame) -> DataFrame:
    """What each step that applies a stream does to its run: create, keep, recreate, or an error.

    A step towards a backfill applies a job whatever the stream's backend. Creating a job sets a suspended stream
    going again (``unsuspends``); recreating one, or creating a cron job, does not. A run without its
    configuration's checksum stops the step, and the phase stays. ``streams`` carries ``current_hash``.
    """
    runs = runs_by_kind(jobs, cron_jobs).withColumn("_run", F.lit(True))
    of_backfill = F.col("next_phase") == BACKFILLING
    applied = plan.filter("action = 'apply'").select(*KEY, "phase", "rule", "next_phase")
    wanted = applied.join(streams.select(*KEY, "backend", "suspended", "current_hash"), KEY).withColumn(
        "run_kind", F.when(of_backfill, BATCH_JOB).otherwise(F.col("backend"))
    )
    outcome = (
        F.when(F.col("_run").isNull(), "create")
        .when(F.col("run_hash").isNull(), "error")
        .when(F.col("run_hash") == F.col("current_hash"), "keep")
        .otherwise("recreate")
    )
    found = wanted.join(runs, [*KEY, "run_kind"], "left").withColumn("outcome", outcome)
    created = (F.col("outcome") == "create") & (F.col("run_kind") == BATCH_JOB)
    return found.select(
        *KEY,
        "rule",
        "run_kind",
        "outcome",
        (created & F.col("suspended")).alias("unsuspends"),
        F.when(F.col("outcome") == "error", F.col("phase")).otherwise(F.col("next_phase")).alias("reached_phase"),
    )


def lifecycle_events(plan: DataFrame) -> DataFrame:
    """Events of a plan; steps that leave the phase as it is stay silent."""
    return plan.filter("event_reason IS NOT NULL").select(
        *KEY, "event_type", "event_reason", "event_message"
    )


def backend_transitions(
    streams: DataFrame, requests: DataFrame, jobs: DataFrame, cron_jobs: DataFrame
) -> DataFrame:
    """Active streams whose run is of another kind than their definition asks for."""
    steady = stream_state(streams, requests, jobs, cron_jobs).filter(
        F.col("phase").isin(RUNNING, SCHEDULED) & ~F.col("suspended") & ~F.col("job_failed")
    )
    changed = steady.filter(F.expr(CHANGED))
    known = F.col("backend") != NO_BACKEND
    return changed.select(
        *KEY,
        "previous_backend",
        "backend",
        F.when(known, F.when(F.col("backend") == BATCH_JOB, CRON_JOB).otherwise(BATCH_JOB)).alias(
            "removed_kind"
        ),
        F.when(known, PENDING).otherwise(F.col("phase")).alias("next_phase"),
        F.when(~known, "unknown backend").alias("error"),
    )
