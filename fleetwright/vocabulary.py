"""Names and texts that make up the platform's contract."""

from __future__ import annotations

# Phases of a stream and of a stream class.
NEW = ""
PENDING = "Pending"
RUNNING = "Running"
BACKFILLING = "Backfilling"
SUSPENDED = "Suspended"
FAILED = "Failed"
SCHEDULED = "Scheduled"
READY = "Ready"
STOPPED = "Stopped"

# Backends.
NO_BACKEND = ""
BATCH_JOB = "BatchJobBackend"
CRON_JOB = "CronJob"

# Run parameters, annotation and label names.
VARIABLE_PREFIX = "STREAMCONTEXT__"
STREAM_ID = "STREAMCONTEXT__STREAM_ID"
STREAM_KIND = "STREAMCONTEXT__STREAM_KIND"
BACKFILL = "STREAMCONTEXT__BACKFILL"
BACKFILL_ID = "STREAMCONTEXT__BACKFILL_ID"
RUN_ID_FIELD = "metadata.labels['job-name']"
CONFIGURATION_HASH = "configuration-hash"

# Status condition per phase, as (type, reason, message).
CONDITIONS = {
    PENDING: ("Warning", "StreamPending", "The stream is pending and will start soon"),
    BACKFILLING: (
        "Ready",
        "StreamBackfilling",
        "The stream is currently backfilling data, request ID: ",
    ),
    RUNNING: ("Ready", "StreamRunning", "The stream is currently running."),
    SUSPENDED: ("Warning", "StreamSuspended", "The stream is suspended."),
    FAILED: ("Error", "StreamFailed", "The stream has failed."),
    SCHEDULED: ("Ready", "StreamScheduled", "The stream is scheduled to run at the specified time."),
}

# The platform prefixes its labels and metric tags with its own domain. The prefix is
# a setting here; pass the one your platform uses.
LABEL_PREFIX = "fleet"
TAG_PREFIX = "fleet.metrics"
