"""Fleet tables derived from the TPC-H-like sample tables.

The sample data has no fleet tables, so each one is an SQL expression over it that Spark
and any ANSI engine read alike. ``NESTED`` adds the arrays and maps of the platform's
records; those are Spark only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

FLAT = {
    "stream_def": """
SELECT c_custkey,
  'ns-' || CAST(c_nationkey AS STRING) AS namespace,
  'stream-' || CAST(c_custkey AS STRING) AS name,
  'uid-' || CAST(c_custkey AS STRING) AS uid,
  lower(c_mktsegment) AS stream_class,
  'streams.example.org' AS api_group,
  CASE WHEN c_custkey % 10 = 0 THEN 'v1beta1' ELSE 'v1' END AS api_version,
  upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || 'ChangeStream' AS kind,
  c_custkey % 5 = 0 AS suspended,
  CASE WHEN c_custkey % 97 = 96 THEN 'Unheard' WHEN c_custkey % 7 = 0 THEN ''
    WHEN c_custkey % 7 = 1 THEN 'Pending' WHEN c_custkey % 7 = 2 THEN 'Running'
    WHEN c_custkey % 7 = 3 THEN 'Backfilling' WHEN c_custkey % 7 = 4 THEN 'Suspended'
    WHEN c_custkey % 7 = 5 THEN 'Failed' ELSE 'Scheduled' END AS phase,
  CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'v1' ELSE 'v2' END AS layout_version,
  CASE WHEN c_custkey % 3 = 0 THEN 'BatchJobBackend' WHEN c_custkey % 11 = 0 THEN ''
    WHEN c_custkey % 11 <= 3 THEN 'CronJob' ELSE 'BatchJobBackend' END AS backend,
  '{"destination":"dst-' || CAST(c_custkey % 10 AS STRING) || '","source":"src-'
    || CAST(c_nationkey AS STRING) || '"}' AS spec_json
FROM customer""",
    "backfill_request": """
SELECT o_orderkey AS request_id,
  'bf-' || CAST(o_orderkey AS STRING) AS request_name,
  'ns-' || CAST(c_nationkey AS STRING) AS namespace,
  lower(c_mktsegment) AS stream_class,
  'stream-' || CAST(o_custkey AS STRING) AS stream_id,
  (o_orderstatus <> 'P' OR o_orderkey % 4 <> 0) AS completed,
  o_orderdate AS created_at
FROM orders JOIN customer ON c_custkey = o_custkey""",
    "job": """
SELECT d.c_custkey, d.namespace, d.name, o.o_orderkey AS job_id,
  CASE o.o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Complete' ELSE 'Suspended' END AS condition_type,
  CASE WHEN o.o_orderkey % 10 = 0 THEN 'False' ELSE 'True' END AS condition_status,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL WHEN o.o_orderkey % 2 = 0 THEN md5(d.spec_json)
    ELSE 'old-hash' END AS configuration_hash,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'false' WHEN 2 THEN 'TRUE' END AS backfill_label
FROM (SELECT o_custkey AS latest_custkey, max(o_orderkey) AS latest_orderkey
      FROM orders WHERE o_custkey % 4 <> 0 GROUP BY o_custkey) l
JOIN orders o ON o.o_orderkey = l.latest_orderkey
JOIN stream_def d ON d.c_custkey = l.latest_custkey""",
    "cron_job": """
SELECT c_custkey, namespace, name,
  CASE WHEN c_custkey % 4 = 1 THEN 'old-hash' WHEN c_custkey % 4 = 3 THEN NULL
    ELSE md5(spec_json) END AS configuration_hash
FROM stream_def WHERE c_custkey % 6 = 1 OR c_custkey % 6 = 4""",
    "stream_class": """
SELECT lower(c_mktsegment) AS stream_class, 'streams.example.org' AS api_group_ref, 'v1' AS api_version,
  upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || 'ChangeStream' AS kind_ref,
  lower(c_mktsegment) || 'changestreams' AS plural_name,
  min(c_custkey) AS class_id
FROM customer GROUP BY c_mktsegment""",
    "class_state": """
SELECT s_suppkey AS class_id,
  'class-' || CAST(s_suppkey AS STRING) AS class_name,
  CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE 'NS-' || CAST(s_nationkey AS STRING) END AS namespace,
  'streams.example.org' AS api_group_ref,
  'v1' AS api_version,
  CASE s_suppkey % 4 WHEN 0 THEN 'SqlABCStream' WHEN 1 THEN 'ParquetFileStream' WHEN 2 THEN ''
    ELSE 'kind' || CAST(s_suppkey AS STRING) || 'Stream' END AS kind_ref,
  'plural' || CAST(s_suppkey AS STRING) AS plural_name,
  CASE s_suppkey % 7 WHEN 0 THEN '' ELSE 'StreamClass' END AS kind,
  CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Pending' WHEN 2 THEN 'Ready' WHEN 3 THEN 'Failed'
    ELSE 'Stopped' END AS phase,
  s_suppkey % 11 = 0 AS deleted,
  s_suppkey % 3 = 0 AS controller_running,
  s_suppkey % 8 = 1 AS start_fails,
  s_suppkey % 13 = 6 AS controller_exited
FROM supplier""",
    "job_template": """
SELECT 'tmpl-' || CAST(p_partkey AS STRING) AS template_name,
  'ns-' || CAST(p_partkey % 25 AS STRING) AS namespace,
  'registry.example.org/' || lower(p_type) || ':' || CAST(p_size AS STRING) AS image,
  CAST(p_size AS STRING) || 'Gi' AS memory_limit,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size % 4 AS STRING) END AS cpu_limit
FROM part WHERE p_partkey % 6 <> 5""",
    "phase_event": """
SELECT 'ns-' || CAST(event_id % 2 AS STRING) AS namespace, 'stream-' || CAST(user_id AS STRING) AS name, event_id AS seq, ts,
  CASE event_type WHEN 'signup' THEN 'Pending' WHEN 'view' THEN 'Backfilling' WHEN 'click' THEN 'Running'
    WHEN 'purchase' THEN 'Suspended' ELSE 'Failed' END AS phase
FROM events""",
    "raw_definition": """
SELECT c_custkey, namespace, name,
  CASE WHEN c_custkey % 101 = 100 THEN '{"kind":' ELSE
  '{"apiVersion":"streams.example.org/v1","kind":"' || kind || '","metadata":{"name":"' || name
  || '","namespace":"' || namespace || '"},"spec":' || CASE WHEN c_custkey % 23 = 22 THEN '"text"' ELSE spec END
  || CASE WHEN phase = '' THEN '' ELSE ',"status":{"configurationHash":"' || md5(name)
     || '","phase":"' || phase || '"}' END || '}' END AS doc
FROM (
SELECT *, '{' ||
  CASE WHEN layout = 0 THEN
    CASE WHEN c_custkey % 17 = 0 THEN '' ELSE '"backfillJobTemplateRef":' || backfill_ref || ',' END
    || '"destination":"dst-' || CAST(c_custkey % 10 AS STRING) || '",'
    || CASE WHEN c_custkey % 9 = 0 THEN '"execution":{"layoutVersion":""},' ELSE '' END
    || '"jobTemplateRef":' || CASE WHEN c_custkey % 2 = 0 THEN '{"name":"tmpl-' || CAST(c_custkey AS STRING) || '"}'
       ELSE stream_ref END
    || ',"secretRef":{"name":"sec-' || CAST(c_custkey % 10 AS STRING) || '"},"source":"src-'
    || CAST(c_nationkey AS STRING) || '"'
    || CASE WHEN c_custkey % 19 = 0 THEN '' ELSE ',"suspended":' || suspended END
  ELSE
    '"destination":"dst-' || CAST(c_custkey % 10 AS STRING) || '","execution":{'
    || CASE WHEN layout = 1 AND c_custkey % 17 <> 0 THEN '"backfillJobTemplateRef":' || backfill_ref || ',' ELSE '' END
    || '"layoutVersion":"' || CASE WHEN c_custkey % 13 = 0 THEN 'v9' ELSE 'v' || CAST(layout AS STRING) END
    || '","streamingBackend":{'
    || CASE WHEN c_custkey % 11 IN (1, 2, 3)
       THEN '"batch":{"jobTemplateRef":' || stream_ref || ',"schedule":"*/5 * * * *"}' ELSE '' END
    || CASE WHEN c_custkey % 11 = 3 THEN ',' ELSE '' END
    || CASE WHEN c_custkey % 11 > 2 THEN '"changeCapture":{'
       || CASE WHEN layout = 2 AND c_custkey % 17 <> 0 THEN '"backfillJobTemplateRef":' || backfill_ref || ',' ELSE '' END
       || '"jobTemplateRef":' || stream_ref || '}' ELSE '' END
    || '}' || CASE WHEN c_custkey % 19 = 0 THEN '' ELSE ',"suspended":' || suspended END
    || '},"secretRef":{"name":"sec-' || CAST(c_custkey % 10 AS STRING) || '"},"source":"src-'
    || CAST(c_nationkey AS STRING) || '"'
  END || '}' AS spec
FROM (
SELECT c.c_custkey, c.c_nationkey, d.namespace, d.name, d.kind, d.phase, c.c_custkey % 3 AS layout,
  CASE WHEN c.c_custkey % 43 = 42 THEN '"yes"' WHEN d.suspended THEN 'true' ELSE 'false' END AS suspended,
  CASE WHEN c.c_custkey % 29 = 28 THEN '{"name":5}' ELSE
  '{"name":"tmpl-' || CAST(c.c_custkey AS STRING) || '","namespace":"ns-' || CAST(c.c_custkey % 25 AS STRING) || '"}'
    END AS stream_ref,
  CASE WHEN c.c_custkey % 37 = 36 THEN '{"name":"tmpl","namespace":7}' ELSE
  '{"name":"tmpl-' || CAST(c.c_custkey + 1 AS STRING) || '","namespace":"ns-'
    || CAST((c.c_custkey + 1) % 25 AS STRING)
    || CASE WHEN c.c_custkey % 41 = 40 THEN '","other":5,"uid":null}' ELSE '"}' END END AS backfill_ref
FROM customer c JOIN stream_def d ON d.c_custkey = c.c_custkey) parts) docs""",
    "numbered_definition": """
SELECT c_custkey, 'ns-' || CAST(c_nationkey AS STRING) AS namespace, 'stream-' || CAST(c_custkey AS STRING) AS name,
  '{"spec":{"suspended":true,"limit":' || CASE c_custkey % 14 WHEN 0 THEN '1e3' WHEN 1 THEN '1e21' WHEN 2 THEN '1e-7'
    WHEN 3 THEN '12345678901234567890' WHEN 4 THEN '1.0' WHEN 5 THEN '-0.50' WHEN 6 THEN '0.000001'
    WHEN 7 THEN '1234567890123456789' WHEN 8 THEN '2.50E-10' WHEN 9 THEN '123.456e5' WHEN 10 THEN '1e20' WHEN 11 THEN '0.0'
    WHEN 12 THEN '"1e3"' ELSE CAST(c_custkey AS STRING) || '.25' END
  || ',"jobTemplateRef":{"name":"t"},"note":"5e3, 2.50","backfillJobTemplateRef":{"name":"b"}}}' AS doc
FROM customer""",
    "watch_event": """
SELECT event_id AS seq, ts, 'ns-' || CAST(c_nationkey AS STRING) AS namespace,
  'stream-' || CAST(user_id AS STRING) AS owner_name,
  CASE event_type WHEN 'signup' THEN 'ADDED' WHEN 'error' THEN 'DELETED' WHEN 'view' THEN 'GENERIC'
    ELSE 'MODIFIED' END AS verb,
  CASE event_id % 4 WHEN 0 THEN 'Job' WHEN 1 THEN 'CronJob' WHEN 2 THEN 'BackfillRequest'
    ELSE 'Stream' END AS kind,
  event_id % 5 <> 0 AS controller,
  event_id % 3 = 0 AS completed,
  event_id % 7 = 0 AS failed,
  lower(c_mktsegment) AS stream_class
FROM events JOIN customer ON c_custkey = user_id""",
    "class_feed": """
SELECT event_id AS seq, ts, 'Kind' || CAST(user_id % 5 AS STRING) || 'Stream' AS kind,
  CASE WHEN event_type = 'error' THEN 'REMOVE' ELSE 'ADD' END AS verb, event_type AS phase
FROM events""",
    "source_row": """
SELECT CASE WHEN event_id % 7 = 0 THEN 'ns-other' ELSE COALESCE('ns-' || CAST(c_nationkey AS STRING), 'ns-none') END
    AS namespace,
  'stream-' || CAST(user_id AS STRING) AS name, event_id, ts, event_type, value
FROM events LEFT JOIN customer ON c_custkey = user_id""",
    "planned_run": """
SELECT o_orderkey AS run_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'ns-hot' ELSE 'ns-' || CAST(o_custkey % 5 AS STRING) END AS namespace,
  CASE WHEN o_orderkey % 3 = 0 THEN 'stream-hot' ELSE 'stream-' || CAST(o_custkey % 40 AS STRING) END AS name,
  CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_orderdate END AS starts_at,
  CASE WHEN o_orderkey % 997 = 1 AND o_orderkey % 3 <> 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN o_orderdate
    ELSE o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 17 - 2 AS INT) END AS ends_at
FROM orders""",
    "remaining_stream": """
SELECT * FROM stream_def WHERE phase <> 'Unheard'""",
    "run_observation": """
SELECT 'run-' || CAST(user_id AS STRING) || '-' || CAST(event_id % 4 AS STRING) AS run_id,
  'ns-' || CAST(user_id % 3 + event_id % 2 AS STRING) AS namespace,
  'stream-' || CAST(user_id AS STRING) AS name, event_id AS seq, ts, event_id % 4 = 0 AS is_backfill,
  CASE WHEN event_id % 8 < 6 THEN 'Job' ELSE 'CronJob' END AS kind,
  CASE event_type WHEN 'purchase' THEN 'Complete' WHEN 'error' THEN 'Failed' ELSE 'Active' END AS state
FROM events""",
    "job_event": """
SELECT o_orderkey AS seq, 'ns-' || CAST(c_nationkey AS STRING) AS namespace,
  'stream-' || CAST(o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 100000000 ELSE 0 END AS STRING) AS owner_name,
  CASE WHEN o_orderkey % 9 = 1 THEN 'Other' ELSE
    upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || 'ChangeStream' END AS owner_kind,
  CASE WHEN o_orderkey % 11 = 1 THEN 'v1' ELSE 'streams.example.org/v1' END AS owner_api_version,
  o_orderkey % 3 <> 0 AS controller, o_orderkey % 2 = 0 AS has_second_owner,
  CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Complete' ELSE 'Suspended' END AS condition_type,
  CASE WHEN o_orderkey % 10 = 0 THEN 'False' ELSE 'True' END AS condition_status
FROM orders JOIN customer ON c_custkey = o_custkey""",
}

NESTED = {
    "job_run": """
SELECT namespace, name, job_id,
  array(named_struct('type', condition_type, 'status', condition_status)) AS conditions,
  CASE WHEN configuration_hash IS NULL THEN map('note', 'none')
    ELSE map('configuration-hash', configuration_hash) END AS annotations,
  CASE WHEN backfill_label IS NULL THEN map('team', 'a')
    ELSE map('team', 'a', 'fleet/backfilling', backfill_label) END AS labels
FROM job""",
    "cron_run": """
SELECT namespace, name,
  CASE WHEN configuration_hash IS NULL THEN map('note', 'none')
    ELSE map('configuration-hash', configuration_hash) END AS annotations
FROM cron_job""",
    "owned_event": """
SELECT seq, namespace, condition_type, condition_status,
  CASE WHEN has_second_owner THEN array(owner, named_struct('api_version', 'v1', 'kind', 'Other', 'name', 'other',
      'controller', false))
    ELSE array(owner) END AS owner_references
FROM (SELECT *, named_struct('api_version', owner_api_version, 'kind', owner_kind, 'name', owner_name,
    'controller', controller) AS owner FROM job_event) e""",
    "class_registry_state": """
SELECT *, CASE class_id % 3 WHEN 0 THEN CAST(array() AS ARRAY<STRING>) WHEN 1 THEN array('secretRef')
  ELSE array('secretRef', 'source') END AS secret_refs FROM stream_class""",
    "template_record": """
SELECT namespace, template_name AS name,
  array(
    named_struct('name', 'main', 'image', image, 'limits',
      CASE WHEN cpu_limit IS NULL THEN map('memory', memory_limit) ELSE map('memory', memory_limit, 'cpu', cpu_limit) END),
    named_struct('name', 'sidecar', 'image', 'registry.example.org/sidecar:1', 'limits', map('memory', '1Gi'))
  ) AS containers
FROM job_template""",
    "stream_run": """
SELECT *,
  array(
    named_struct('name', 'main', 'env', concat(
      array(named_struct('name', 'LOG_LEVEL', 'value', 'DEBUG', 'value_from', CAST(NULL AS STRING))),
      CASE WHEN c_custkey % 2 = 0
        THEN array(named_struct('name', 'STREAMCONTEXT__BACKFILL', 'value', 'false', 'value_from', CAST(NULL AS STRING)))
        ELSE array() END,
      CASE WHEN c_custkey % 10 = 0
        THEN array(named_struct('name', 'STREAMCONTEXT__BACKFILL', 'value', 'kept', 'value_from', CAST(NULL AS STRING)))
        ELSE array() END,
      CASE WHEN c_custkey % 31 = 0
        THEN array(named_struct('name', 'STREAMCONTEXT__STREAM_ID', 'value', 'preset', 'value_from', CAST(NULL AS STRING)))
        ELSE array() END)),
    named_struct('name', 'sidecar', 'env', CAST(array() AS ARRAY<STRUCT<name: STRING, value: STRING, value_from: STRING>>))
  ) AS containers,
  map('team', 'a') AS labels,
  CASE WHEN c_custkey % 2 = 0 THEN map('configuration-hash', 'stale', 'note', 'n') ELSE map('note', 'n') END AS annotations,
  CASE WHEN c_custkey % 4 = 0 THEN array(named_struct('api_version', 'v0', 'kind', 'Other', 'name', 'first', 'uid', 'u',
      'controller', false))
    ELSE CAST(array() AS ARRAY<STRUCT<api_version: STRING, kind: STRING, name: STRING, uid: STRING, controller: BOOLEAN>>)
    END AS owner_references
FROM stream_def""",
}


def _needs(name: str) -> list[str]:
    """Flat tables to define before ``name``, in order, and ``name`` itself."""
    found: list[str] = []
    for word in re.findall(r"(?:FROM|JOIN)\s+(\w+)", FLAT[name]):
        if word in FLAT:
            found += [n for n in _needs(word) if n not in found]
    return found + [name]


def with_clause(names: list[str]) -> str:
    """``name AS (...)`` entries for the named tables and all they build on."""
    order: list[str] = []
    for name in names:
        order += [n for n in _needs(name) if n not in order]
    return ",\n".join(f"{n} AS ({FLAT[n]}\n)" for n in order)


def _inlined(name: str, folder: str) -> str:
    """The table's SQL with every table it names written out as a subquery.

    Spark reuses an exchange between two uses of a subquery, but not of a WITH entry.
    """
    tables = FLAT | NESTED

    def subquery(found: re.Match) -> str:
        keyword, table, alias = found.groups()
        if table in BASE:
            text = f"SELECT * FROM parquet.`{folder}/{table}.parquet`"
        elif table in tables:
            text = _inlined(table, folder)
        else:
            return found.group(0)
        return f"{keyword} ({text}) {alias or table}"

    keywords = "ON|JOIN|WHERE|GROUP|LEFT|ORDER"
    return re.sub(rf"\b(FROM|JOIN)\s+(\w+)(?:\s+(?!(?:{keywords})\b)(\w+))?", subquery, tables[name])


def fleet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One fleet table over the sample tables in ``folder``."""
    if name in BASE:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    return spark.sql(_inlined(name, folder))
