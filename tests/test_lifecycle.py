"""Transitions of a single stream: (phase, suspended, backend, job, request, cron) -> outcome."""

import pytest

from fleetwright.plans.lifecycle import apply_outcomes, lifecycle_events, lifecycle_plan

STREAM = "namespace string, name string, stream_class string, phase string, suspended boolean, backend string, layout_version string"
REQUEST = "namespace string, stream_id string, request_id long, request_name string, stream_class string, completed boolean"
JOB = "namespace string, name string, job_id long, conditions array<struct<type:string,status:string>>, annotations map<string,string>"
CRON = "namespace string, name string, annotations map<string,string>"
BATCH, SCHEDULE, NONE = "BatchJobBackend", "CronJob", ""

# name, phase, suspended, backend, job condition (None: no job), open request, cron job exists,
# -> action, next phase, shown event reason.
CASES = [
    ("new to suspended", "", True, BATCH, None, False, False, "remove", "Suspended", "StreamSuspended"),
    ("new to pending", "", False, BATCH, None, False, False, "create request", "Pending", "StreamCreated"),
    ("new to pending with schedule", "", False, SCHEDULE, None, False, False, "none", "Pending", None),
    ("new without backend", "", False, NONE, None, False, False, "none", "", "NoValidBackend"),
    ("pending to running without job", "Pending", False, BATCH, None, False, False, "apply", "Running", None),
    ("pending ignores suspended", "Pending", True, BATCH, None, False, False, "apply", "Running", None),
    ("pending to running with job", "Pending", False, BATCH, "Active", False, False, "apply", "Running", None),
    ("pending to scheduled", "Pending", False, SCHEDULE, None, False, False, "apply", "Scheduled", None),
    ("pending to backfilling", "Pending", False, BATCH, None, True, False, "apply", "Backfilling", None),
    ("pending to backfilling with schedule", "Pending", False, SCHEDULE, None, True, False, "apply", "Backfilling", None),
    ("pending without backend", "Pending", False, NONE, None, False, False, "error", "Pending", "StreamSuspended"),
    ("running to suspended", "Running", True, BATCH, "Active", False, False, "remove", "Suspended", "StreamSuspended"),
    ("running to suspended without job", "Running", True, BATCH, None, False, False, "remove", "Suspended",
     "StreamSuspended"),
    ("running goes on", "Running", False, BATCH, "Active", False, False, "apply", "Running", None),
    ("running to pending with schedule", "Running", False, SCHEDULE, "Active", False, False, "switch", "Pending",
     "StreamStarted"),
    ("running, backend gone", "Running", False, NONE, "Active", False, False, "error", "Running", "StreamSuspended"),
    ("running without backend and run", "Running", False, NONE, None, False, False, "none", "Running",
     "StreamingContinued"),
    ("running with request", "Running", False, BATCH, None, True, False, "remove", "Pending", "BackfillRequested"),
    ("suspended with request stays", "Suspended", True, BATCH, None, True, False, "none", "Suspended", None),
    ("suspended with request resumes", "Suspended", False, BATCH, None, True, False, "none", "Pending",
     "BackfillRequested"),
    ("suspended stays", "Suspended", True, BATCH, "Active", False, False, "remove", "Suspended", None),
    ("suspended resumes", "Suspended", False, BATCH, None, False, False, "none", "Pending", "StreamResumed"),
    ("backfilling completed", "Backfilling", False, BATCH, "Complete", True, False, "complete", "Pending",
     "BackfillCompleted"),
    ("backfilling, request deleted", "Backfilling", False, BATCH, "Active", False, False, "complete", "Pending",
     "BackfillNotRequested"),
    ("backfilling, job running", "Backfilling", False, BATCH, "Active", True, False, "none", "Backfilling", None),
    ("backfilling, no job", "Backfilling", False, BATCH, None, True, False, "apply", "Backfilling", None),
    ("backfilling to suspended", "Backfilling", True, BATCH, "Active", True, False, "remove", "Suspended",
     "StreamSuspended"),
    ("backfilling, job failed", "Backfilling", False, BATCH, "Failed", True, False, "remove", "Failed",
     "StreamingJobFailed"),
    ("running, job failed", "Running", False, BATCH, "Failed", False, False, "remove", "Failed", "StreamingJobFailed"),
    ("suspended, job failed", "Suspended", True, BATCH, "Failed", False, False, "remove", "Failed",
     "StreamingJobFailed"),
    ("failed stays failed", "Failed", False, BATCH, "Failed", False, False, "remove", "Failed", None),
    ("failed stays failed without job", "Failed", False, BATCH, None, False, False, "remove", "Failed", None),
    ("failed to suspended", "Failed", True, BATCH, None, False, False, "remove", "Suspended", "StreamSuspended"),
    ("failed to suspended with request", "Failed", True, BATCH, None, True, False, "remove", "Suspended",
     "StreamSuspended"),
    ("scheduled goes on", "Scheduled", False, SCHEDULE, None, False, True, "apply", "Scheduled", None),
    ("scheduled without cron job", "Scheduled", False, SCHEDULE, None, False, False, "apply", "Scheduled", None),
    ("scheduled to batch job", "Scheduled", False, BATCH, None, False, True, "switch", "Pending", "StreamScheduled"),
    ("scheduled to suspended", "Scheduled", True, SCHEDULE, None, False, True, "remove", "Suspended",
     "StreamSuspended"),
    ("scheduled with request", "Scheduled", False, SCHEDULE, None, True, True, "remove", "Pending",
     "BackfillRequested"),
    ("unknown phase", "Elsewhere", False, BATCH, None, False, False, "error", "Elsewhere", "StreamSuspended"),
]


@pytest.fixture(scope="module")
def outcome(spark):
    streams, requests, jobs, crons = [], [], [], []
    for name, phase, suspended, backend, job, asked, cron, *_ in CASES:
        streams.append(("ns", name, "c", phase, suspended, backend, "v2"))
        if asked:
            requests += [("ns", name, n, f"bf-{n}", "c", n == 1) for n in (1, 2, 3)]
        if job:
            jobs.append(("ns", name, 1, [] if job == "Active" else [(job, "True")], {}))
        if cron:
            crons.append(("ns", name, {}))
    plan = lifecycle_plan(
        spark.createDataFrame(streams, STREAM),
        spark.createDataFrame(requests, REQUEST),
        spark.createDataFrame(jobs, JOB),
        spark.createDataFrame(crons, CRON),
    )
    return {row["name"]: row for row in plan.collect()}, lifecycle_events(plan).count()


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_transition(outcome, case):
    row = outcome[0][case[0]]
    assert (row.action, row.next_phase, row.event_reason) == case[-3:]


def test_request_is_completed_with_its_backfill(outcome):
    completed = {n: r.completed_request for n, r in outcome[0].items() if r.completed_request}
    assert completed == {"backfilling completed": "bf-2"}


def test_events_are_the_shown_ones(outcome):
    assert outcome[1] == sum(case[-1] is not None for case in CASES)


def test_old_layout_never_changes_backend(spark):
    streams = spark.createDataFrame([("ns", "a", "c", "Running", False, BATCH, "")], STREAM)
    row = lifecycle_plan(
        streams, spark.createDataFrame([], REQUEST), spark.createDataFrame([], JOB),
        spark.createDataFrame([("ns", "a", {})], CRON),
    ).first()
    assert (row.action, row.next_phase) == ("apply", "Running")


def test_apply_outcomes(spark):
    """Each step that applies, with no run, one of the same, of another and of no configuration."""
    applied = [("new", "Pending", "Running", "BatchJobBackend"), ("cron", "Pending", "Scheduled", "CronJob"),
               ("redo", "Pending", "Backfilling", "CronJob")]
    hashes = {"none": None, "same": "h", "other": "x", "lost": None}
    plan = [("n", f"{a} {h}", p, a, "apply", q) for a, p, q, _ in applied for h in hashes] + [("n", "idle", "Failed", "r", "remove", "Failed")]
    streams = [("n", f"{a} {h}", b, True, "h") for a, _, _, b in applied for h in hashes]
    runs = {k: [("n", f"{a} {h}", {} if v is None else {"configuration-hash": v}) for a, _, _, b in applied for h, v in hashes.items()
                if h != "none" and (b if a != "redo" else "BatchJobBackend") == k] for k in ("BatchJobBackend", "CronJob")}
    frames = [spark.createDataFrame(runs[k], "namespace string, name string, annotations map<string,string>") for k in runs]
    found = apply_outcomes(
        spark.createDataFrame(plan, "namespace string, name string, phase string, rule string, action string, next_phase string"),
        spark.createDataFrame(streams, "namespace string, name string, backend string, suspended boolean, current_hash string"),
        *frames,
    ).collect()
    outcomes = {"none": "create", "same": "keep", "other": "recreate", "lost": "error"}
    assert len(found) == 12
    for row in found:
        step, run = row["name"].split()
        kind = "CronJob" if step == "cron" else "BatchJobBackend"
        reached = {"new": "Running", "cron": "Scheduled", "redo": "Backfilling"}[step] if run != "lost" else "Pending"
        assert (row["run_kind"], row["outcome"], row["reached_phase"]) == (kind, outcomes[run], reached)
        assert row["unsuspends"] == (run == "none" and step != "cron")
