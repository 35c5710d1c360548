"""The registered queries as plain SQL over the sample tables.

Written apart from the Spark code, on the flat fleet tables; nothing here calls it.
"""

from __future__ import annotations

from fleetwright.sources.sample_fleet import with_clause

ORACLES: dict[str, str] = {}


def oracle(name: str, tables: str, body: str, *extra: tuple[str, str]) -> None:
    """``extra`` are further WITH entries between the fleet tables and the body."""
    parts = [with_clause(tables.split())] if tables else []
    parts += [f"{n} AS ({text})" for n, text in extra]
    ORACLES[name] = (f"WITH {', '.join(parts)}\n" if parts else "") + body


# Definitions

FIELDS = (
    "fields",
    """
SELECT *, COALESCE(json_extract_string(j, '$.spec.execution.layoutVersion'), '') AS layout,
  json_type(j, '$.spec.execution.streamingBackend.changeCapture') = 'OBJECT' IS TRUE AS capture,
  json_type(j, '$.spec.execution.streamingBackend.batch') = 'OBJECT' IS TRUE AS batch
FROM (SELECT namespace, name, json_valid(doc) AS ok, CASE WHEN json_valid(doc) THEN doc ELSE '{}' END AS j
      FROM raw_definition) d""",
)


def _no_text(path: str) -> str:
    """Whether a reference has a known field that is neither text nor null."""
    fields = ("apiVersion", "fieldPath", "kind", "name", "namespace", "resourceVersion", "uid")
    return "(" + " OR ".join(f"COALESCE(json_type(j, '{path}.{f}') NOT IN ('VARCHAR', 'NULL'), FALSE)" for f in fields) + ")"


_EXECUTION = "$.spec.execution"
_STREAMING = f"{_EXECUTION}.streamingBackend"
JUDGED = (
    "judged",
    f"""
SELECT *, CASE WHEN NOT ok THEN 'document is not JSON'
  WHEN json_type(j, '$.spec') <> 'OBJECT' THEN 'layout is not readable'
  WHEN layout NOT IN ('', 'v1', 'v2') THEN 'layout is unknown'
  WHEN layout <> '' AND json_type(j, '{_EXECUTION}.suspended') NOT IN ('BOOLEAN', 'NULL') THEN 'execution is not readable'
  WHEN layout <> '' AND ({_no_text(f'{_STREAMING}.changeCapture.jobTemplateRef')}
    OR {_no_text(f'{_STREAMING}.batch.jobTemplateRef')}
    OR layout = 'v1' AND {_no_text(f'{_EXECUTION}.backfillJobTemplateRef')}
    OR layout = 'v2' AND {_no_text(f'{_STREAMING}.changeCapture.backfillJobTemplateRef')}) THEN 'execution is not readable'
  WHEN layout = '' AND json_type(j, '$.spec.suspended') IS NULL THEN 'suspended is missing'
  WHEN layout = '' AND json_type(j, '$.spec.suspended') <> 'BOOLEAN' THEN 'suspended is not a boolean'
  WHEN layout = '' AND json_type(j, '$.spec.jobTemplateRef') IS NULL THEN 'job template is missing'
  WHEN layout = '' AND {_no_text('$.spec.jobTemplateRef')} THEN 'job template is not readable'
  WHEN layout = '' AND json_type(j, '$.spec.backfillJobTemplateRef') IS NULL THEN 'backfill template is missing'
  WHEN layout = '' AND {_no_text('$.spec.backfillJobTemplateRef')} THEN 'backfill template is not readable'
  WHEN layout = 'v1' AND json_type(j, '$.spec.execution.backfillJobTemplateRef') IS NULL
    THEN 'backfill template is missing'
  WHEN layout = 'v2' AND capture
    AND json_type(j, '$.spec.execution.streamingBackend.changeCapture.backfillJobTemplateRef') IS NULL
    THEN 'backfill template is missing' END AS reason
FROM fields""",
)


def _ref(field: str) -> str:
    """Template references of a layout, as columns."""
    e = "$.spec.execution"
    s = f"{e}.streamingBackend"
    x = "json_extract_string(j, '{}')".format
    return f"""
  COALESCE(CASE WHEN layout = '' THEN {x(f'$.spec.jobTemplateRef.{field}')}
    ELSE {x(f'{s}.changeCapture.jobTemplateRef.{field}')} END, '') AS run_template_{field},
  COALESCE({x(f'{s}.batch.jobTemplateRef.{field}')}, '') AS batch_template_{field},
  COALESCE(CASE layout WHEN '' THEN {x(f'$.spec.backfillJobTemplateRef.{field}')}
    WHEN 'v1' THEN {x(f'{e}.backfillJobTemplateRef.{field}')}
    ELSE {x(f'{s}.changeCapture.backfillJobTemplateRef.{field}')} END, '') AS backfill_template_{field}"""


NORMALIZED = (
    "normalized",
    f"""
SELECT namespace, name, layout AS layout_version, json_extract_string(j, '$.kind') AS kind,
  COALESCE(json_extract_string(j, '$.status.phase'), '') AS phase,
  COALESCE(TRY_CAST(json_extract_string(j, CASE WHEN layout = '' THEN '$.spec.suspended'
    ELSE '$.spec.execution.suspended' END) AS BOOLEAN), FALSE) AS suspended,
  CASE WHEN layout = '' THEN 'BatchJobBackend' WHEN batch THEN 'CronJob' WHEN capture THEN 'BatchJobBackend'
    ELSE '' END AS backend,
  CASE WHEN layout <> '' AND batch
    THEN json_extract_string(j, '$.spec.execution.streamingBackend.batch.schedule') END AS schedule,
  layout <> '' AND capture AS has_capture, layout <> '' AND batch AS has_batch,
  {_ref('namespace')}, {_ref('name')},
  COALESCE(json_extract_string(j, '$.status.configurationHash'), '') AS applied_hash,
  CAST(json_extract(j, '$.spec') AS VARCHAR) AS spec_json,
  md5(CAST(json_extract(j, '$.spec') AS VARCHAR)) AS current_hash
FROM judged WHERE reason IS NULL""",
)
DEFINITIONS = (FIELDS, JUDGED, NORMALIZED)
OPEN = (
    "open_request",
    """
SELECT namespace, stream_id AS name, request_id, request_name, stream_class AS request_class FROM (
  SELECT *, row_number() OVER (PARTITION BY namespace, stream_id ORDER BY request_id) AS n
  FROM backfill_request WHERE NOT completed) r WHERE n = 1""",
)
RESOLVED = (
    "resolved",
    """
SELECT namespace, name,
  CASE WHEN layout_version = '' AND run_template_namespace = '' THEN namespace
    WHEN layout_version = '' THEN run_template_namespace
    WHEN request_name IS NOT NULL AND (layout_version = 'v1' OR has_capture) THEN backfill_template_namespace
    WHEN request_name IS NOT NULL THEN NULL WHEN has_capture THEN run_template_namespace
    WHEN has_batch THEN batch_template_namespace END AS template_namespace,
  CASE WHEN layout_version = '' AND request_name IS NULL THEN run_template_name
    WHEN layout_version = '' THEN backfill_template_name
    WHEN request_name IS NOT NULL AND (layout_version = 'v1' OR has_capture) THEN backfill_template_name
    WHEN request_name IS NOT NULL THEN NULL WHEN has_capture THEN run_template_name
    WHEN has_batch THEN batch_template_name END AS template_name
FROM normalized LEFT JOIN open_request USING (namespace, name)""",
)
oracle("definitions_normalized", "raw_definition", "SELECT * FROM normalized", *DEFINITIONS)
oracle("definitions_quarantine", "raw_definition",
       "SELECT namespace, name, reason FROM judged WHERE reason IS NOT NULL", FIELDS, JUDGED)
oracle("backend_resolved", "raw_definition", "SELECT namespace, name, backend FROM normalized", *DEFINITIONS)
oracle("schedule_resolved", "raw_definition", "SELECT namespace, name, backend, schedule FROM normalized",
       *DEFINITIONS)
oracle("template_ref_resolved", "raw_definition backfill_request",
       """SELECT *, CASE WHEN template_name IS NULL THEN 'the definition has no such template' END AS error
FROM resolved""", *DEFINITIONS, OPEN, RESOLVED)

# Requests

oracle("stream_open_request", "stream_def backfill_request",
       """SELECT namespace, name, request_id, request_name, request_class
FROM stream_def LEFT JOIN open_request USING (namespace, name)""", OPEN)
oracle("initial_backfill_requests", "stream_def",
       """SELECT namespace, name || '-initial-backfill-' || substr(md5(namespace || '/' || name), 1, 5) AS request_name,
  name AS stream_id, stream_class, FALSE AS completed
FROM stream_def WHERE phase = '' AND NOT suspended AND backend = 'BatchJobBackend'""")
oracle("open_request_events", "watch_event stream_class",
       """SELECT seq, namespace, owner_name, verb, stream_class FROM watch_event
WHERE kind = 'BackfillRequest' AND verb IN ('ADDED', 'DELETED') AND NOT completed
  AND stream_class IN (SELECT stream_class FROM stream_class)""")
oracle("request_to_stream", "backfill_request stream_def",
       """SELECT r.namespace, d.name, r.request_name, d.phase
FROM backfill_request r JOIN stream_def d ON d.namespace = r.namespace AND d.name = r.stream_id""")

# Runs

oracle("job_state", "job cron_job stream_def",
       """SELECT namespace, name, 'BatchJobBackend' AS backend,
  condition_type = 'Complete' AND condition_status = 'True' AS is_completed,
  condition_type = 'Failed' AND condition_status = 'True' AS is_failed FROM job
UNION ALL SELECT namespace, name, 'CronJob', FALSE, FALSE FROM cron_job
UNION ALL SELECT namespace, name, '', TRUE, FALSE FROM stream_def WHERE backend = ''""")
oracle("is_backfill_run", "job",
       "SELECT namespace, name, job_id, COALESCE(lower(backfill_label) = 'true', FALSE) AS is_backfill FROM job")
oracle("stream_job", "stream_def job",
       """SELECT d.namespace, d.name, d.phase, j.job_id, j.job_id IS NOT NULL AS job_exists,
  COALESCE(condition_type = 'Complete' AND condition_status = 'True', FALSE) AS job_completed,
  COALESCE(condition_type = 'Failed' AND condition_status = 'True', FALSE) AS job_failed
FROM stream_def d LEFT JOIN job j ON j.namespace = d.namespace AND j.name = d.name""")
PREVIOUS = """CASE WHEN d.layout_version = '' THEN 'BatchJobBackend' WHEN c.name IS NOT NULL THEN 'CronJob'
    WHEN j.name IS NOT NULL THEN 'BatchJobBackend' END AS previous_backend"""
WITH_RUNS = """stream_def d LEFT JOIN job j ON j.namespace = d.namespace AND j.name = d.name
  LEFT JOIN cron_job c ON c.namespace = d.namespace AND c.name = d.name"""
oracle("previous_backend", "stream_def job cron_job",
       f"SELECT d.namespace, d.name, d.backend, {PREVIOUS} FROM {WITH_RUNS}")
RUN = (
    "run",
    """SELECT namespace, name, 'BatchJobBackend' AS run_kind, configuration_hash AS run_hash FROM job
UNION ALL SELECT namespace, name, 'CronJob', configuration_hash FROM cron_job""",
)
oracle("configuration_drift", "stream_def job cron_job",
       """SELECT d.namespace, d.name, d.backend, md5(d.spec_json) AS current_hash, r.run_hash,
  CASE WHEN r.name IS NULL THEN 'create' WHEN r.run_hash IS NULL THEN 'error'
    WHEN r.run_hash = md5(d.spec_json) THEN 'keep' ELSE 'recreate' END AS drift
FROM stream_def d LEFT JOIN run r ON r.namespace = d.namespace AND r.name = d.name AND r.run_kind = d.backend
WHERE d.backend <> ''""", RUN)
oracle("orphan_runs", "stream_def job cron_job",
       """SELECT r.namespace, r.name, r.run_kind, 'stream is gone' AS reason FROM run r
WHERE NOT EXISTS (SELECT 1 FROM stream_def d WHERE d.namespace = r.namespace AND d.name = r.name
  AND d.phase <> 'Unheard')
UNION ALL SELECT r.namespace, r.name, r.run_kind, 'backend has changed'
FROM run r JOIN stream_def d ON d.namespace = r.namespace AND d.name = r.name
WHERE d.phase <> 'Unheard' AND d.backend <> r.run_kind""", RUN)
oracle("suspended_but_running", "stream_def job cron_job",
       """SELECT namespace, name, phase, backend FROM stream_def d WHERE suspended
AND EXISTS (SELECT 1 FROM run r WHERE r.namespace = d.namespace AND r.name = d.name)""", RUN)
oracle("missing_templates", "raw_definition backfill_request job_template",
       """SELECT namespace, name, template_namespace, template_name, 'Warning' AS event_type,
  'FailedCreateJob' AS event_reason FROM resolved r WHERE template_name IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM job_template t WHERE t.namespace = r.template_namespace AND t.template_name = r.template_name)""",
       *DEFINITIONS, OPEN, RESOLVED)

# Life cycle

STATE = (
    "state",
    f"""
SELECT d.namespace, d.name, d.stream_class, d.phase, d.suspended, d.backend, q.request_name, {PREVIOUS},
  j.name IS NOT NULL AS has_job,
  COALESCE(condition_type = 'Complete' AND condition_status = 'True', FALSE) AS done,
  COALESCE(condition_type = 'Failed' AND condition_status = 'True', FALSE) AS failed
FROM {WITH_RUNS} LEFT JOIN open_request q ON q.namespace = d.namespace AND q.name = d.name""",
)
CASED = (
    "cased",
    """
SELECT *, CASE WHEN failed THEN CASE WHEN phase = 'Backfilling' THEN 'backfill job failed' ELSE 'job failed' END
  WHEN phase = 'Failed' THEN CASE WHEN NOT suspended THEN 'failed' WHEN request_name IS NULL THEN 'failed, suspended'
    ELSE 'failed, suspended with request' END
  WHEN phase = '' THEN CASE WHEN backend = '' THEN 'new without backend' WHEN suspended THEN 'new, suspended'
    WHEN backend = 'BatchJobBackend' THEN 'new batch job' ELSE 'new cron job' END
  WHEN phase = 'Pending' THEN CASE WHEN request_name IS NOT NULL THEN 'pending with request'
    WHEN backend = 'CronJob' THEN 'pending cron job' ELSE 'pending' END
  WHEN phase IN ('Running', 'Scheduled') THEN lower(phase) || CASE WHEN suspended THEN ', suspended'
    WHEN request_name IS NOT NULL THEN ' with request'
    WHEN previous_backend IS NULL OR previous_backend = backend THEN ''
    WHEN backend = 'BatchJobBackend' THEN ', changed to batch job'
    WHEN backend = 'CronJob' THEN ', changed to cron job' ELSE ', changed to unknown backend' END
  WHEN phase = 'Suspended' THEN CASE WHEN suspended THEN 'suspended, suspended' ELSE 'suspended' END
    || CASE WHEN request_name IS NOT NULL THEN ' with request' ELSE '' END
  WHEN phase = 'Backfilling' THEN CASE WHEN suspended THEN 'backfilling, suspended'
    WHEN request_name IS NULL THEN 'backfilling without request' WHEN NOT has_job THEN 'backfilling without job'
    WHEN done THEN 'backfilling, job completed' ELSE 'backfilling' END
  ELSE 'unknown phase' END AS rule
FROM state""",
)
# Rule, action, next phase, whether the stream's own backend does it, event.
PLAN_ROWS = [
    ("backfill job failed", "remove", "Failed", 0, "Warning", "StreamingJobFailed", "The backfill job {} has failed"),
    ("job failed", "remove", "Failed", 1, "Warning", "StreamingJobFailed", "The streaming job {} has failed"),
    ("failed, suspended with request", "remove", "Suspended", 0, "Normal", "StreamSuspended", "The stream was suspended"),
    ("failed, suspended", "remove", "Suspended", 1, "Normal", "StreamSuspended", "The stream was suspended"),
    ("failed", "remove", "Failed", 1, "Warning", "StreamingJobFailed", "The stream {} has failed"),
    ("new without backend", "none", "", 1, "Warning", "NoValidBackend",
     "No valid streaming backend configured for {}"),
    ("new, suspended", "remove", "Suspended", 1, "Normal", "StreamSuspended",
     "The new stream {} was added in the suspended state, nothing to do"),
    ("new batch job", "create request", "Pending", 0, "Normal", "StreamCreated",
     "Backfill was requested for the new stream definition: {}"),
    ("new cron job", "none", "Pending", 1, None, None, None),
    ("pending", "apply", "Running", 1, None, None, None),
    ("pending cron job", "apply", "Scheduled", 1, None, None, None),
    ("pending with request", "apply", "Backfilling", 0, None, None, None),
    ("running, suspended", "remove", "Suspended", 1, "Normal", "StreamSuspended",
     "The streaming job for stream {} has been suspended"),
    ("scheduled, suspended", "remove", "Suspended", 1, "Normal", "StreamSuspended",
     "The streaming job {} was suspended"),
    ("running with request", "remove", "Pending", 1, "Normal", "BackfillRequested",
     "A backfill requested for stream {}, stopping the streaming job to start backfilling"),
    ("scheduled with request", "remove", "Pending", 1, "Normal", "BackfillRequested",
     "A backfill requested for stream {}, stopping the streaming job to start backfilling"),
    ("running, changed to batch job", "switch", "Pending", 1, "Normal", "StreamScheduled",
     "The stream {} has been scheduled"),
    ("scheduled, changed to batch job", "switch", "Pending", 1, "Normal", "StreamScheduled",
     "The stream {} has been scheduled"),
    ("running, changed to cron job", "switch", "Pending", 1, "Normal", "StreamStarted",
     "The stream {} has been started"),
    ("scheduled, changed to cron job", "switch", "Pending", 1, "Normal", "StreamStarted",
     "The stream {} has been started"),
    ("running", "apply", "Running", 1, "Normal", "StreamingContinued",
     "The streaming job for stream {} is continuing"),
    ("scheduled", "apply", "Scheduled", 1, "Normal", "StreamingScheduled", "The stream {} is scheduled"),
    ("suspended, suspended with request", "none", "Suspended", 1, "Normal", "BackfillSuspended",
     "A backfill was suspended for suspended stream {}"),
    ("suspended with request", "none", "Pending", 1, "Normal", "BackfillRequested",
     "A backfill was requested for suspended stream {}"),
    ("suspended, suspended", "remove", "Suspended", 1, "Normal", "StreamSuspended",
     "The stream {} remains suspended"),
    ("suspended", "none", "Pending", 1, "Normal", "StreamResumed", "The stream {} has been resumed"),
    ("backfilling, suspended", "remove", "Suspended", 0, "Normal", "StreamSuspended",
     "The backfilling for stream {} has been suspended"),
    ("backfilling without request", "complete", "Pending", 0, "Normal", "BackfillNotRequested",
     "The backfill request for stream {} not found, probably deleted"),
    ("backfilling without job", "apply", "Backfilling", 1, "Normal", "BackfillStarted",
     "Backfill job for stream {} has been started"),
    ("backfilling, job completed", "complete", "Pending", 0, "Normal", "BackfillCompleted",
     "Backfill for stream {} has been completed"),
    ("backfilling", "none", "Backfilling", 1, "Normal", "BackfillInProgress",
     "Backfill for stream {} is still in progress"),
    ("unknown phase", "error", "", 0, None, None, None),
    ("running, changed to unknown backend", "error", "", 1, None, None, None),
    ("scheduled, changed to unknown backend", "error", "", 1, None, None, None),
]


def _values(rows: list[tuple]) -> str:
    def cell(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


PLANNED = (
    "planned",
    f"""
SELECT namespace, name, stream_class, phase, rule, request_name, event_type, event_reason,
  replace(event_message, '{{}}', name) AS event_message, error, idle,
  CASE WHEN error IS NOT NULL THEN 'error' WHEN idle THEN 'none' ELSE action END AS action,
  CASE WHEN error IS NOT NULL OR idle THEN phase ELSE rule_phase END AS next_phase
FROM (SELECT *, own = 1 AND backend = '' AS idle,
  CASE WHEN rule = 'unknown phase'
      THEN 'failed to reconcile Stream FSM for ' || namespace || '/' || name || '. Current state: phase=' || phase
    WHEN action = 'error' THEN 'failed to transit backend for stream ' || namespace || '/' || name
      || ': unknown backend  for stream ' || namespace || '/' || name
    WHEN own = 1 AND backend = '' AND action = 'apply' AND event_reason IS NULL
      THEN 'no backend to apply for stream ' || namespace || '/' || name END AS error
FROM cased JOIN (VALUES {_values(PLAN_ROWS)})
  AS rules(rule, action, rule_phase, own, event_type, event_reason, event_message) USING (rule)) p""",
)
PLAN = (
    "plan",
    """
SELECT namespace, name, stream_class, phase, rule, action, next_phase,
  CASE WHEN error IS NOT NULL THEN 'Warning' WHEN idle OR next_phase <> phase THEN event_type END AS event_type,
  CASE WHEN error IS NOT NULL THEN 'StreamSuspended' WHEN idle OR next_phase <> phase THEN event_reason END
    AS event_reason,
  CASE WHEN error IS NOT NULL THEN 'Failed to reconcile the stream: ' || error
    WHEN idle OR next_phase <> phase THEN event_message END AS event_message,
  CASE WHEN rule = 'backfilling, job completed' THEN request_name END AS completed_request, error
FROM planned""",
)
PLANNING = (OPEN, STATE, CASED, PLANNED, PLAN)
FLEET = "stream_def backfill_request job cron_job"
oracle("lifecycle_plan", FLEET, "SELECT * FROM plan", *PLANNING)
oracle("apply_outcomes", FLEET,
       """SELECT namespace, name, rule, run_kind, outcome, outcome = 'create' AND run_kind = 'BatchJobBackend' AND suspended
    AS unsuspends, CASE WHEN outcome = 'error' THEN phase ELSE next_phase END AS reached_phase
FROM (SELECT a.*, CASE WHEN r.name IS NULL THEN 'create' WHEN r.run_hash IS NULL THEN 'error'
    WHEN r.run_hash = a.spec_hash THEN 'keep' ELSE 'recreate' END AS outcome
  FROM (SELECT p.namespace, p.name, p.phase, p.rule, p.next_phase, d.suspended, md5(d.spec_json) AS spec_hash,
      CASE WHEN p.next_phase = 'Backfilling' THEN 'BatchJobBackend' ELSE d.backend END AS run_kind
    FROM plan p JOIN stream_def d ON d.namespace = p.namespace AND d.name = p.name WHERE p.action = 'apply') a
  LEFT JOIN run r ON r.namespace = a.namespace AND r.name = a.name AND r.run_kind = a.run_kind) o""", *PLANNING, RUN)
oracle("lifecycle_plan_summary", FLEET,
       "SELECT rule, action, next_phase, count(*) AS streams FROM plan GROUP BY ALL", *PLANNING)
oracle("lifecycle_events", FLEET,
       """SELECT namespace, name, event_type, event_reason, event_message FROM plan
WHERE event_reason IS NOT NULL""", *PLANNING)
oracle("event_reason_counts", FLEET,
       """SELECT event_type, event_reason, count(*) AS events FROM plan WHERE event_reason IS NOT NULL
GROUP BY event_type, event_reason""", *PLANNING)
oracle("backend_transitions", FLEET,
       """SELECT namespace, name, previous_backend, backend,
  CASE backend WHEN 'BatchJobBackend' THEN 'CronJob' WHEN 'CronJob' THEN 'BatchJobBackend' END AS removed_kind,
  CASE WHEN backend = '' THEN phase ELSE 'Pending' END AS next_phase,
  CASE WHEN backend = '' THEN 'unknown backend' END AS error
FROM state WHERE phase IN ('Running', 'Scheduled') AND NOT suspended AND NOT failed AND request_name IS NULL
  AND previous_backend <> backend""", OPEN, STATE)
oracle("class_lifecycle_plan", "class_state",
       """SELECT class_name, phase, step, next_phase, controller,
  CASE controller WHEN 'stop' THEN 'REMOVE' WHEN 'start' THEN 'ADD' END AS registry,
  CASE WHEN next_phase <> phase THEN CASE WHEN step IN ('recovered', 'exited') THEN 'Warning' ELSE 'Normal' END END
    AS event_type,
  CASE WHEN next_phase <> phase THEN CASE step WHEN 'created' THEN 'StreamClassCreated'
    WHEN 'ready' THEN 'StreamClassReady' WHEN 'recovered' THEN 'StreamClassRecovered'
    WHEN 'reconciled' THEN 'StreamClassReconciled' ELSE 'StreamControllerError' END END AS event_reason,
  CASE WHEN next_phase <> phase THEN CASE step
    WHEN 'created' THEN 'New StreamClass has been created and is pending processing'
    WHEN 'ready' THEN 'StreamClass is ready and stream controller has been started'
    WHEN 'recovered' THEN 'StreamClass was found in Failed state and recovery was attempted'
    WHEN 'reconciled' THEN 'StreamClass is reconciled and stream controller is running'
    ELSE 'Stream controller exited with error, StreamClass moved to Failed state' END END AS event_message,
  CASE WHEN step = 'error' THEN 'failed to reconcile StreamClass FSM for ' || class_name || '. Current state: ' || phase
    END AS error
FROM (SELECT *, CASE step WHEN 'exited' THEN 'Failed' WHEN 'created' THEN 'Pending' WHEN 'deleted' THEN phase
    WHEN 'error' THEN phase ELSE CASE WHEN NOT controller_running AND start_fails THEN 'Failed' ELSE 'Ready' END END
    AS next_phase,
  CASE WHEN step = 'deleted' AND controller_running THEN 'stop'
    WHEN step IN ('ready', 'recovered', 'reconciled') AND NOT controller_running AND NOT start_fails THEN 'start'
    ELSE 'keep' END AS controller
  FROM (SELECT *, CASE WHEN deleted THEN 'deleted' WHEN controller_exited THEN 'exited' WHEN phase = '' THEN 'created'
      WHEN phase = 'Pending' THEN 'ready' WHEN phase = 'Failed' THEN 'recovered' WHEN phase = 'Ready' THEN 'reconciled'
      ELSE 'error' END AS step FROM class_state) s) p""")

# Listings and counts

oracle("class_listing", "class_state",
       "SELECT class_name, api_group_ref, api_version, kind_ref, plural_name, phase FROM class_state")
oracle("template_listing", "job_template",
       "SELECT namespace, template_name AS name, memory_limit, cpu_limit, image FROM job_template")
oracle("request_listing", "backfill_request",
       "SELECT namespace, request_name, stream_class, stream_id, completed FROM backfill_request")
oracle("stream_listing", "stream_def", "SELECT namespace, name, stream_class, phase, suspended FROM stream_def")
oracle("activation_batch", "stream_def",
       """SELECT namespace, name, stream_class FROM stream_def WHERE phase = 'Suspended'
ORDER BY namespace, name LIMIT 300""")
oracle("phase_census", "stream_def",
       "SELECT stream_class, phase, count(*) AS streams FROM stream_def GROUP BY stream_class, phase")
oracle("run_census", "run_observation",
       """SELECT namespace, name, kind, is_backfill, state, count(*) AS runs FROM (
  SELECT *, row_number() OVER (PARTITION BY namespace, run_id ORDER BY ts DESC, seq DESC) AS n FROM run_observation) o
WHERE n = 1 GROUP BY namespace, name, kind, is_backfill, state""")

# Status

oracle("status_conditions", "stream_def backfill_request",
       """SELECT namespace, name, phase,
  CASE phase WHEN 'Pending' THEN 'Warning' WHEN 'Suspended' THEN 'Warning' WHEN 'Failed' THEN 'Error'
    ELSE 'Ready' END AS type,
  'True' AS status, 'Stream' || phase AS reason,
  CASE phase WHEN 'Pending' THEN 'The stream is pending and will start soon'
    WHEN 'Backfilling' THEN 'The stream is currently backfilling data, request ID: ' || COALESCE(request_name, '')
    WHEN 'Running' THEN 'The stream is currently running.' WHEN 'Suspended' THEN 'The stream is suspended.'
    WHEN 'Failed' THEN 'The stream has failed.' ELSE 'The stream is scheduled to run at the specified time.' END
    AS message
FROM stream_def LEFT JOIN open_request USING (namespace, name) WHERE phase NOT IN ('', 'Unheard')""", OPEN)
CHANGES = (
    "changes",
    """SELECT namespace, name, ts, seq, from_phase, phase AS to_phase FROM (SELECT *, COALESCE(lag(phase) OVER
  (PARTITION BY namespace, name ORDER BY ts, seq), '') AS from_phase FROM phase_event) e WHERE from_phase <> phase""",
)
oracle("phase_transitions", "phase_event", "SELECT * FROM changes", CHANGES)
oracle("stream_phase_tracker", "phase_event", "SELECT * FROM changes", CHANGES)
oracle("phase_log_under_disorder", "phase_event", "SELECT * FROM changes", CHANGES)
oracle("time_in_phase", "phase_event",
       """SELECT namespace, name, ts, seq, to_phase AS phase,
  (epoch_us(lead(ts) OVER (PARTITION BY namespace, name ORDER BY ts, seq)) - epoch_us(ts)) // 1000 AS dwell_ms
FROM changes""", CHANGES)
NEWEST = "SELECT *, row_number() OVER (PARTITION BY namespace, name ORDER BY ts DESC, seq DESC) AS n FROM phase_event"
oracle("latest_state", "phase_event", f"SELECT namespace, name, ts, seq, phase FROM ({NEWEST}) e WHERE n = 1")
oracle("streaming_status_sink", "phase_event", f"SELECT namespace, name, phase FROM ({NEWEST}) e WHERE n = 1")
oracle("status_under_disorder", "phase_event", f"SELECT namespace, name, ts, phase FROM ({NEWEST}) e WHERE n = 1")
oracle("status_sink", "phase_event",
       f"""SELECT namespace, name, ts, seq, phase, CAST(0 AS BIGINT) AS batch_id FROM early WHERE n = 1
UNION ALL SELECT e.namespace, e.name, e.ts, e.seq, e.phase, CAST(1 AS BIGINT) FROM ({NEWEST}) e
LEFT JOIN (SELECT * FROM early WHERE n = 1) b ON b.namespace = e.namespace AND b.name = e.name
WHERE e.n = 1 AND (b.phase IS NULL OR b.phase <> e.phase)""",
       ("early", f"{NEWEST} WHERE ts < TIMESTAMP '2024-01-15 00:00:00'"))

# Classes

oracle("class_streams", "stream_class stream_def",
       """SELECT d.api_group, d.api_version, d.kind, d.namespace, d.name, c.stream_class AS class_name
FROM stream_def d JOIN stream_class c ON c.api_group_ref = d.api_group AND c.api_version = d.api_version
  AND c.kind_ref = d.kind""")
oracle("secret_ref_fields", "raw_definition stream_class",
       """SELECT n.namespace, n.name, CAST(position AS INTEGER) AS position, field,
  json_extract_string(n.spec_json, '$.' || field || '.name') AS secret_name
FROM normalized n JOIN stream_def d ON d.namespace = n.namespace AND d.name = n.name
JOIN stream_class c ON c.stream_class = d.stream_class
JOIN (VALUES (1, 0, 'secretRef'), (2, 0, 'secretRef'), (2, 1, 'source')) AS f(form, position, field)
  ON f.form = c.class_id % 3""", *DEFINITIONS)
TAGS = (
    "tags",
    r"""SELECT class_name, 'fleet.metrics/' || tag AS tag, value FROM (
SELECT class_name, 'namespace' AS tag, CASE WHEN namespace = '' THEN 'unknown' ELSE lower(namespace) END AS value
FROM class_state
UNION ALL SELECT class_name, 'kind_ref', CASE WHEN kind_ref = '' THEN 'unknown'
  ELSE lower(regexp_replace(kind_ref, '([a-z])([A-Z])', '\1_\2', 'g')) END FROM class_state
UNION ALL SELECT class_name, 'kind', CASE WHEN kind = '' THEN 'unknown'
  ELSE lower(regexp_replace(kind, '([a-z])([A-Z])', '\1_\2', 'g')) END FROM class_state
UNION ALL SELECT class_name, 'phase', lower(phase) FROM class_state) t""",
)
oracle("class_metric_tags", "class_state", "SELECT * FROM tags", TAGS)
oracle("metric_export_rows", "class_state",
       """SELECT class_name, 'stream_class' AS metric, 1 AS value,
  string_agg(tag || ':' || value, ',' ORDER BY tag || ':' || value) AS tags FROM tags GROUP BY class_name""", TAGS)
oracle("class_registry", "class_feed",
       """SELECT kind, phase, seq FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, seq DESC) AS n
FROM class_feed) f WHERE n = 1 AND verb = 'ADD'""")
BEATS = """SELECT f.kind, t.at AS reported_at, 1 AS value
FROM (SELECT unnest(generate_series(date_trunc('second', min(ts)) + INTERVAL 35 SECOND, date_trunc('second', max(ts)),
  INTERVAL 30 SECOND)) AS at FROM class_feed) t
JOIN (SELECT kind, ts, verb, lead(ts) OVER (PARTITION BY kind ORDER BY ts, seq) AS until FROM class_feed) f
  ON f.ts <= t.at AND (f.until IS NULL OR f.until > t.at) WHERE f.verb = 'ADD'"""
oracle("heartbeat_counts", "class_feed", BEATS)
oracle("heartbeat_intervals", "class_feed",
       f"""SELECT kind, min(n) AS first_tick, max(n) AS last_tick, min(reported_at) AS first_at, max(reported_at) AS last_at
FROM (SELECT *, n - row_number() OVER (PARTITION BY kind ORDER BY n) AS island FROM (
  SELECT kind, reported_at, (epoch_us(reported_at) - epoch_us((SELECT date_trunc('second', min(ts)) FROM class_feed)) - 5000000)
    // 30000000 AS n FROM ({BEATS}) beats) numbered) islands
GROUP BY kind, island""")
oracle("heartbeats_at", "watch_event class_feed",
       f"""SELECT seq, ts, kind, reported_at FROM (
  SELECT seq, ts, 'Kind' || CAST(seq % 7 AS VARCHAR) || 'Stream' AS kind,
    time_bucket(INTERVAL 30 SECOND, ts, (SELECT date_trunc('second', min(ts)) + INTERVAL 5 SECOND FROM class_feed)) AS tick
  FROM watch_event) asked
LEFT JOIN (SELECT kind, reported_at, reported_at AS tick FROM ({BEATS}) b) beats USING (kind, tick)""")
for name in ("heartbeat_windows", "streaming_heartbeats"):
    oracle(name, "class_feed",
           """SELECT kind, w AS window_start, w + INTERVAL 30 SECOND AS window_end, count(*) AS beats FROM (
  SELECT kind, time_bucket(INTERVAL 30 SECOND, ts, TIMESTAMP '2024-01-01 00:00:05') AS w FROM class_feed) f
GROUP BY kind, w""")

# Feeds

oracle("merged_feed", "job cron_job backfill_request",
       """SELECT namespace, name, job_id, 'Job' AS kind, NULL::BIGINT AS request_id FROM job
UNION ALL SELECT namespace, name, NULL, 'CronJob', NULL FROM cron_job
UNION ALL SELECT namespace, stream_id, NULL, 'BackfillRequest', request_id FROM backfill_request""")
RELEVANT = """kind IN ('Job', 'CronJob') AND (verb IN ('ADDED', 'DELETED')
  OR verb = 'MODIFIED' AND (kind = 'CronJob' OR completed OR failed))"""
oracle("relevant_job_events", "watch_event",
       f"SELECT seq, kind, verb, namespace, owner_name FROM watch_event WHERE {RELEVANT}")
oracle("event_to_owner", "job_event stream_def",
       """SELECT e.namespace, d.name, d.api_group, d.kind, e.seq, e.condition_type, e.condition_status, d.stream_class
FROM job_event e JOIN stream_def d ON d.namespace = e.namespace AND d.name = e.owner_name AND d.kind = e.owner_kind
WHERE e.controller AND e.owner_api_version LIKE d.api_group || '/%'""")
oracle("event_feed_filter", "watch_event stream_def stream_class",
       f"""SELECT e.namespace, d.name, e.seq, e.kind, e.verb, d.phase
FROM (SELECT * FROM watch_event WHERE ({RELEVANT}) AND controller
  OR kind = 'BackfillRequest' AND verb IN ('ADDED', 'DELETED') AND NOT completed) e
JOIN stream_def d ON d.namespace = e.namespace AND d.name = e.owner_name""")
oracle("events_of_changing_streams", "watch_event stream_def stream_class",
       f"""SELECT e.namespace, d.name, e.seq, e.kind, e.verb, d.phase,
  CAST(CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 0 ELSE 1 END AS BIGINT) AS batch_id
FROM (SELECT * FROM watch_event WHERE ({RELEVANT}) AND controller
  OR kind = 'BackfillRequest' AND verb IN ('ADDED', 'DELETED') AND NOT completed) e
JOIN stream_def d ON d.namespace = e.namespace AND d.name = e.owner_name
WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' OR c_custkey % 2 = 0""")
oracle("keyed_coalescing", "watch_event",
       """SELECT DISTINCT namespace, owner_name AS name,
  CAST(CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 0 ELSE 1 END AS BIGINT) AS batch_id FROM watch_event""")
oracle("change_feed_rows", "watch_event", "SELECT seq, ts, kind, verb, owner_name FROM watch_event")

# Run parameters

ASKED = (
    "asked",
    """SELECT *, cron OR open_name IS NOT NULL AS has_request,
  CASE WHEN NOT cron THEN COALESCE(open_name, '') ELSE '' END AS id_value,
  CASE WHEN cron THEN '{"streamClass":"","streamId":""}'
    WHEN open_name IS NOT NULL THEN '{"streamClass":"' || request_class || '","streamId":"' || name || '"}'
    END AS override_json
FROM (SELECT d.*, q.request_id, q.request_name AS open_name, q.request_class, c_custkey % 31 = 0 AS taken,
    d.backend = 'CronJob' AND NOT (d.phase = 'Pending' AND q.request_name IS NOT NULL) AS cron
  FROM stream_def d LEFT JOIN open_request q ON q.namespace = d.namespace AND q.name = d.name) s""",
)
# Variables a container starts with: position, container, name, value.
PRESET = (
    "preset",
    """SELECT a.namespace, a.name, 'main' AS container, 0 AS place, 'LOG_LEVEL' AS variable, 'DEBUG' AS value FROM asked a
UNION ALL SELECT namespace, name, 'main', 1, 'STREAMCONTEXT__BACKFILL', 'false' FROM asked WHERE c_custkey % 2 = 0
UNION ALL SELECT namespace, name, 'main', 2, 'STREAMCONTEXT__BACKFILL', 'kept' FROM asked WHERE c_custkey % 10 = 0
UNION ALL SELECT namespace, name, 'main', 3, 'STREAMCONTEXT__STREAM_ID', 'preset' FROM asked WHERE taken""",
)
BOTH = "(VALUES ('main'), ('sidecar')) AS c(container)"
NUMBERED = """SELECT namespace, name, container,
  CAST(row_number() OVER (PARTITION BY namespace, name, container ORDER BY place) - 1 AS INTEGER) AS position,
  variable, value, value_from FROM ({}) v"""


def _variables(*added: str, flag: str | None = None, where: str = "TRUE") -> str:
    """Presets (the first flag variable overwritten by ``flag``) and added rows, numbered."""
    value = "p.value"
    if flag:
        value = f"CASE WHEN p.place = 1 THEN CAST({flag} AS VARCHAR) ELSE p.value END"
    rows = [
        f"""SELECT p.namespace, p.name, p.container, p.place, p.variable, {value} AS value, CAST(NULL AS VARCHAR) AS value_from
FROM preset p JOIN asked a USING (namespace, name) WHERE {where}"""
    ]
    if flag:
        rows.append(
            f"""SELECT namespace, name, container, {{flag_place}}, 'STREAMCONTEXT__BACKFILL', CAST({flag} AS VARCHAR), NULL
FROM asked a, {BOTH} WHERE {where} AND NOT (container = 'main' AND c_custkey % 2 = 0)"""
        )
    rows += added
    return NUMBERED.format(" UNION ALL ".join(rows))


def _added(place: int | str, variable: str, value: str, where: str = "TRUE", value_from: str = "NULL") -> str:
    return f"""SELECT namespace, name, container, {place}, '{variable}', {value}, {value_from}
FROM asked a, {BOTH} WHERE {where}"""


RUN_TABLES = "stream_def backfill_request"
JOB_NAME = "'metadata.labels[''job-name'']'"
oracle("run_parameters", RUN_TABLES,
       _variables(
           _added(10, "STREAMCONTEXT__STREAM_ID", "name", "NOT taken"),
           _added(11, "STREAMCONTEXT__STREAM_KIND", "kind", "NOT taken"),
           _added(12, "STREAMCONTEXT__SPEC", "spec_json", "NOT taken"),
           _added("CASE WHEN cron THEN 14 ELSE 17 END", "STREAMCONTEXT__BACKFILL_ID", "id_value",
                  "NOT taken AND has_request", f"CASE WHEN cron THEN {JOB_NAME} END"),
           _added(15, "STREAMCONTEXT__OVERRIDE", "override_json", "NOT taken AND has_request"),
           flag="a.has_request", where="NOT taken",
       ).replace("{flag_place}", "CASE WHEN cron THEN 13 ELSE 16 END"),
       OPEN, ASKED, PRESET)
oracle("run_labels", RUN_TABLES,
       """SELECT namespace, name, entry, value FROM asked a, LATERAL (VALUES ('team', 'a'),
  ('fleet/stream-id', a.name), ('fleet/stream-kind', a.kind),
  ('fleet/backfilling', CAST(a.has_request AS VARCHAR))) AS l(entry, value) WHERE NOT taken AND NOT cron""",
       OPEN, ASKED)
CHECKSUM = """CASE WHEN override_json IS NULL THEN md5(spec_json)
  ELSE lower(hex(md5(spec_json))) || ':' || lower(hex(md5(override_json))) END"""
oracle("run_annotations", RUN_TABLES,
       f"""SELECT namespace, name, 'configuration-hash' AS entry,
  CASE WHEN cron THEN md5(spec_json) ELSE {CHECKSUM} END AS value FROM asked WHERE NOT taken
UNION ALL SELECT namespace, name, 'note', 'n' FROM asked WHERE NOT taken AND NOT cron""", OPEN, ASKED)
oracle("run_owners", RUN_TABLES,
       """SELECT namespace, name, CAST(CASE WHEN c_custkey % 4 = 0 AND NOT cron THEN 1 ELSE 0 END AS INTEGER) AS position,
  kind AS owner_kind, name AS owner_name, TRUE AS controller FROM asked WHERE NOT taken
UNION ALL SELECT namespace, name, 0, 'Other', 'first', FALSE FROM asked
WHERE NOT taken AND NOT cron AND c_custkey % 4 = 0""", OPEN, ASKED)
oracle("run_parameter_errors", RUN_TABLES,
       """SELECT namespace, name, 'environment variable STREAMCONTEXT__STREAM_ID already present' AS error
FROM asked WHERE taken""", OPEN, ASKED)
oracle("run_key", RUN_TABLES,
       """SELECT namespace, name, name AS run_name, namespace AS run_namespace, CAST(NULL AS VARCHAR) AS error
FROM asked""", OPEN, ASKED)
oracle("stream_metadata_variables", RUN_TABLES,
       _variables(_added(10, "STREAMCONTEXT__STREAM_ID", "name", "NOT taken"),
                  _added(11, "STREAMCONTEXT__STREAM_KIND", "kind", "NOT taken"), where="NOT taken"),
       OPEN, ASKED, PRESET)
oracle("spec_variable", RUN_TABLES, _variables(_added(10, "STREAMCONTEXT__SPEC", "spec_json")), OPEN, ASKED, PRESET)
oracle("backfill_flag", RUN_TABLES, _variables(flag="a.has_request").replace("{flag_place}", "10"),
       OPEN, ASKED, PRESET)
oracle("static_backfill_id", RUN_TABLES,
       _variables(_added(10, "STREAMCONTEXT__BACKFILL_ID", "id_value", "has_request")), OPEN, ASKED, PRESET)
oracle("dynamic_backfill_id", RUN_TABLES,
       _variables(_added(10, "STREAMCONTEXT__BACKFILL_ID", "''", "cron", JOB_NAME)), OPEN, ASKED, PRESET)
oracle("request_part", RUN_TABLES,
       _variables(_added(10, "STREAMCONTEXT__OVERRIDE", "override_json", "has_request"),
                  _added(12, "STREAMCONTEXT__BACKFILL_ID", "id_value", "has_request"),
                  flag="a.has_request").replace("{flag_place}", "11"), OPEN, ASKED, PRESET)
oracle("checksum_annotation", RUN_TABLES,
       f"""SELECT namespace, name, 'configuration-hash' AS entry, {CHECKSUM} AS value FROM asked
UNION ALL SELECT namespace, name, 'note', 'n' FROM asked""", OPEN, ASKED)
oracle("owner_reference", RUN_TABLES,
       """SELECT namespace, name, CAST(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS position,
  kind AS owner_kind, name AS owner_name, TRUE AS controller FROM asked
UNION ALL SELECT namespace, name, 0, 'Other', 'first', FALSE FROM asked WHERE c_custkey % 4 = 0""", OPEN, ASKED)
oracle("configuration_checksums", RUN_TABLES,
       """SELECT d.namespace, d.name, md5(d.spec_json) AS spec_checksum,
  CASE WHEN q.request_name IS NULL THEN md5(d.spec_json) ELSE lower(hex(md5(d.spec_json))) || ':'
    || lower(hex(md5('{"streamClass":"' || q.request_class || '","streamId":"' || d.name || '"}'))) END AS checksum
FROM stream_def d LEFT JOIN open_request q USING (namespace, name)""", OPEN)
STATUS_HASH = """CASE WHEN d.open_name IS NULL THEN md5(d.spec_json) ELSE
    lower(hex(md5(d.spec_json))) || ':'
    || lower(hex(md5('{"streamClass":"' || d.request_class || '","streamId":"' || d.name || '"}'))) END"""
# The platform's conditions.
STATUS_CONDITION = """  CASE WHEN d.phase IN ('Pending', 'Suspended') THEN 'Warning' WHEN d.phase = 'Failed' THEN 'Error'
    WHEN d.phase NOT IN ('', 'Unheard') THEN 'Ready' END AS type,
  CASE WHEN d.phase NOT IN ('', 'Unheard') THEN 'Stream' || d.phase END AS reason,
  CASE d.phase WHEN 'Pending' THEN 'The stream is pending and will start soon'
    WHEN 'Backfilling' THEN 'The stream is currently backfilling data, request ID: ' || COALESCE(d.open_name, '')
    WHEN 'Running' THEN 'The stream is currently running.' WHEN 'Suspended' THEN 'The stream is suspended.'
    WHEN 'Failed' THEN 'The stream has failed.'
    WHEN 'Scheduled' THEN 'The stream is scheduled to run at the specified time.' END AS message,
"""
oracle("status_rows", RUN_TABLES + " phase_event",
       f"""SELECT d.namespace, d.name, d.phase, {STATUS_HASH} AS configuration_hash,
{STATUS_CONDITION}  c.ts AS condition_since
FROM asked d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY namespace, name ORDER BY ts DESC, seq DESC) AS n
  FROM changes) c ON c.n = 1 AND c.namespace = d.namespace AND c.name = d.name AND c.to_phase = d.phase""",
       OPEN, ASKED, CHANGES)
oracle("streaming_status_rows", RUN_TABLES + " phase_event",
       f"""SELECT namespace, name, ts, seq, phase, {STATUS_HASH} AS configuration_hash,
{STATUS_CONDITION.rstrip().rstrip(",")}
FROM (SELECT a.* EXCLUDE (phase), e.ts, e.seq, e.phase,
    row_number() OVER (PARTITION BY a.namespace, a.name ORDER BY e.ts DESC, e.seq DESC) AS n
  FROM asked a JOIN phase_event e ON e.name = a.name) d WHERE n = 1""", OPEN, ASKED)
oracle("request_override", RUN_TABLES,
       """SELECT namespace, name, field, value FROM (SELECT namespace, name, 'source' AS field,
  json_extract_string(spec_json, '$.source') AS value FROM asked
UNION ALL SELECT namespace, name, 'destination', CASE WHEN request_id IS NULL
  THEN json_extract_string(spec_json, '$.destination') ELSE 'redo-' || request_id END FROM asked
UNION ALL SELECT namespace, name, 'streamId', name FROM asked WHERE request_id IS NOT NULL) s""", OPEN, ASKED)

# Data jobs

# Runs from templates: as above, with containers that start empty.

BUILT_ASKED = (
    "asked",
    f"""SELECT a.* EXCLUDE (c_custkey, taken), 1 AS c_custkey, FALSE AS taken, t.image, t.template_name
FROM ({ASKED[1]}) a JOIN resolved r ON r.namespace = a.namespace AND r.name = a.name
JOIN job_template t ON t.namespace = r.template_namespace AND t.template_name = r.template_name""",
)
NO_PRESET = (
    "preset",
    "SELECT namespace, name, 'main' AS container, 0 AS place, '' AS variable, '' AS value FROM asked WHERE FALSE",
)
BUILT_TABLES = "stream_def raw_definition backfill_request job_template"
oracle("built_runs", BUILT_TABLES,
       _variables(
           _added(10, "STREAMCONTEXT__STREAM_ID", "name"),
           _added(11, "STREAMCONTEXT__STREAM_KIND", "kind"),
           _added(12, "STREAMCONTEXT__SPEC", "spec_json"),
           _added("CASE WHEN cron THEN 14 ELSE 17 END", "STREAMCONTEXT__BACKFILL_ID", "id_value",
                  "has_request", f"CASE WHEN cron THEN {JOB_NAME} END"),
           _added(15, "STREAMCONTEXT__OVERRIDE", "override_json", "has_request"),
           flag="a.has_request",
       ).replace("{flag_place}", "CASE WHEN cron THEN 13 ELSE 16 END"),
       *DEFINITIONS, OPEN, RESOLVED, BUILT_ASKED, NO_PRESET)
oracle("built_run_images", BUILT_TABLES + " stream_class",
       """SELECT a.namespace, a.name, c.container,
  CASE c.container WHEN 'main' THEN a.image ELSE 'registry.example.org/sidecar:1' END AS image,
  CASE k.class_id % 3 WHEN 0 THEN '' WHEN 1 THEN COALESCE(json_extract_string(n.spec_json, '$.secretRef.name'), '')
    ELSE concat_ws(',', json_extract_string(n.spec_json, '$.secretRef.name'),
      json_extract_string(n.spec_json, '$.source.name')) END AS secret_names
FROM asked a JOIN normalized n ON n.namespace = a.namespace AND n.name = a.name
JOIN stream_class k ON k.stream_class = a.stream_class, (VALUES ('main'), ('sidecar')) AS c(container)""",
       *DEFINITIONS, OPEN, RESOLVED, BUILT_ASKED)
# The platform's event.
oracle("failed_runs", "raw_definition backfill_request job_template",
       """SELECT namespace, name, 'Warning' AS event_type, 'FailedCreateJob' AS event_reason,
  'failed to create job: failed to get template (' || template_namespace || '/' || template_name || ')' AS message
FROM resolved r WHERE template_name IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM job_template t WHERE t.namespace = r.template_namespace AND t.template_name = r.template_name)""",
       *DEFINITIONS, OPEN, RESOLVED)

SOURCE = ("source", "SELECT * FROM source_row")
LIVE = """SELECT namespace, name, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER
  (PARTITION BY namespace, name ORDER BY ts DESC, event_id DESC) AS n FROM source) s WHERE n = 1 AND event_type <> 'error'"""
oracle("plugin_source_files", "source_row",
       "SELECT source.*, format FROM source, (VALUES ('parquet'), ('json')) AS f(format)",
       SOURCE)
oracle("backfill_load", "source_row backfill_request",
       "SELECT s.*, q.request_name AS backfill_id FROM source s JOIN open_request q ON q.namespace = s.namespace AND q.name = s.name", OPEN, SOURCE)
oracle("backfill_completed_requests", "backfill_request",
       "SELECT namespace, request_name, TRUE AS completed FROM open_request", OPEN)
oracle("scheduled_batch", "source_row", "SELECT *, '20240131T000000' AS run_id FROM source", SOURCE)
for name in ("backfill_handoff", "change_capture", "suspend_resume"):
    oracle(name, "source_row", LIVE, SOURCE)
oracle("backfill_handoff_rows", "source_row", "SELECT * FROM source", SOURCE)
oracle("gap_fill", "source_row",
       """SELECT * FROM source WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'
AND event_type <> 'click'""", SOURCE)
oracle("restart_on_change", "source_row", LIVE.replace("'error'", "'purchase'"), SOURCE)

oracle("handoff_by_stream", "source_row", "SELECT * FROM source", SOURCE)
oracle("resumable_backfill", "source_row", "SELECT * FROM source", SOURCE)
oracle("backfill_chunks", "source_row",
       """SELECT chunk, CAST(sum(n) AS BIGINT) AS rows, arg_min(namespace, place) AS namespace, arg_min(name, place) AS name,
  arg_min(slice, place) AS slice
FROM (SELECT *, row_number() OVER (ORDER BY namespace, name, slice) AS place,
    CAST((COALESCE(sum(n) OVER (ORDER BY namespace, name, slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      // 300 AS BIGINT) AS chunk
  FROM (SELECT namespace, name, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slice, count(*) AS n FROM source
    GROUP BY namespace, name, slice) c) r GROUP BY chunk""", SOURCE)
GONE = ("""(event_id % 501 = 5 OR ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-10 06:00:00'
  AND event_type <> 'click')""")
oracle("gap_ranges", "source_row",
       f"""SELECT namespace, name, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS range_start, count(*) AS source_rows,
  count(*) FILTER (NOT {GONE}) + count(*) FILTER (event_id % 901 = 1) AS target_rows
FROM source GROUP BY namespace, name, range_start
HAVING bool_or({GONE} OR event_id % 777 = 9 OR event_id % 901 = 1)""", SOURCE)
oracle("gap_rows", "source_row",
       f"""SELECT *, CASE WHEN {GONE} THEN 'missing' ELSE 'different' END AS reason FROM source
WHERE {GONE} OR event_id % 777 = 9""", SOURCE)
oracle("scheduled_runs_allowed", "planned_run",
       """SELECT * FROM (WITH RECURSIVE runs AS (
  SELECT *, CASE WHEN ends_at IS NOT NULL THEN greatest(starts_at, ends_at) END AS over_at,
    row_number() OVER (PARTITION BY namespace, name ORDER BY starts_at, run_id) AS n
  FROM planned_run WHERE starts_at IS NOT NULL),
following AS MATERIALIZED (SELECT r.namespace, r.name, r.n, min(s.n) AS m FROM runs r JOIN runs s
  ON s.namespace = r.namespace AND s.name = r.name AND s.n > r.n AND s.starts_at >= r.over_at
  GROUP BY r.namespace, r.name, r.n),
chain AS (SELECT DISTINCT namespace, name, CAST(1 AS BIGINT) AS n FROM runs
  UNION ALL SELECT c.namespace, c.name, f.m FROM chain c JOIN following f
    ON f.namespace = c.namespace AND f.name = c.name AND f.n = c.n)
SELECT r.namespace, r.name, r.run_id, c.n IS NOT NULL AS allowed FROM runs r
LEFT JOIN chain c ON c.namespace = r.namespace AND c.name = r.name AND c.n = r.n) t""")
# Numbers as the platform spells them.
oracle("configuration_number_texts", "numbered_definition",
       """SELECT namespace, name, spec_json, md5(spec_json) AS checksum FROM (SELECT namespace, name,
  '{"backfillJobTemplateRef":{"name":"b"},"jobTemplateRef":{"name":"t"},"limit":' || CASE c_custkey % 14
    WHEN 0 THEN '1000' WHEN 1 THEN '1e+21' WHEN 2 THEN '1e-7' WHEN 3 THEN '12345678901234567000' WHEN 4 THEN '1'
    WHEN 5 THEN '-0.5' WHEN 6 THEN '0.000001' WHEN 7 THEN '1234567890123456789' WHEN 8 THEN '2.5e-10' WHEN 9 THEN '12345600'
    WHEN 10 THEN '100000000000000000000' WHEN 11 THEN '0' WHEN 12 THEN '"1e3"'
    ELSE CAST(c_custkey AS VARCHAR) || '.25' END || ',"note":"5e3, 2.50","suspended":true}' AS spec_json
  FROM numbered_definition) s""")
