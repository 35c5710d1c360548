"""Stream definitions: dynamic JSON documents brought to one schema.

A document is parsed once, into a variant, and read once, into the objects it may consist of, whose
other fields stay variants; so a missing field and a field of the wrong type stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.text import canonical_numbers, configuration_checksum, escaped
from fleetwright.vocabulary import BATCH_JOB, CRON_JOB, NO_BACKEND

KEY = ["namespace", "name"]

# Where the layouts keep their fields.
DOCUMENT_KIND = "$.kind"
PHASE = "$.status.phase"
APPLIED_HASH = "$.status.configurationHash"
SUSPENDED_OLD = "$.spec.suspended"
RUN_TEMPLATE_OLD = "$.spec.jobTemplateRef"
BACKFILL_TEMPLATE_OLD = "$.spec.backfillJobTemplateRef"
EXECUTION = "$.spec.execution"
LAYOUT = "$.spec.execution.layoutVersion"
SUSPENDED = "$.spec.execution.suspended"
BACKFILL_TEMPLATE_V1 = "$.spec.execution.backfillJobTemplateRef"
STREAMING = "$.spec.execution.streamingBackend"
CAPTURE = "$.spec.execution.streamingBackend.changeCapture"
CAPTURE_TEMPLATE = "$.spec.execution.streamingBackend.changeCapture.jobTemplateRef"
BACKFILL_TEMPLATE_V2 = "$.spec.execution.streamingBackend.changeCapture.backfillJobTemplateRef"
BATCH = "$.spec.execution.streamingBackend.batch"
BATCH_TEMPLATE = "$.spec.execution.streamingBackend.batch.jobTemplateRef"
SCHEDULE = "$.spec.execution.streamingBackend.batch.schedule"


# Fields whose JSON kind matters for validity: those that should be objects, and the rest.
OBJECT_KINDS = {
    "spec_is": "$.spec",
    "execution_is": EXECUTION,
    "status_is": "$.status",
    "run_old_is": RUN_TEMPLATE_OLD,
    "backfill_old_is": BACKFILL_TEMPLATE_OLD,
    "streaming_is": STREAMING,
    "capture_is": CAPTURE,
    "capture_template_is": CAPTURE_TEMPLATE,
    "batch_is": BATCH,
    "batch_template_is": BATCH_TEMPLATE,
    "backfill_v1_is": BACKFILL_TEMPLATE_V1,
    "backfill_v2_is": BACKFILL_TEMPLATE_V2,
}
VALUE_KINDS = {
    "layout_is": LAYOUT,
    "phase_is": PHASE,
    "hash_is": APPLIED_HASH,
    "suspended_old_is": SUSPENDED_OLD,
    "suspended_new_is": SUSPENDED,
    "schedule_is": SCHEDULE,
}

# Template references, and their fields; each field is text where it is there at all.
REFERENCES = {
    "run_old_wrong": RUN_TEMPLATE_OLD,
    "backfill_old_wrong": BACKFILL_TEMPLATE_OLD,
    "capture_template_wrong": CAPTURE_TEMPLATE,
    "batch_template_wrong": BATCH_TEMPLATE,
    "backfill_v1_wrong": BACKFILL_TEMPLATE_V1,
    "backfill_v2_wrong": BACKFILL_TEMPLATE_V2,
}
# The fields of an object reference.
REFERENCE_FIELDS = ["kind", "namespace", "name", "uid", "apiVersion", "resourceVersion", "fieldPath"]


# Why a document is rejected, in order; the first condition that holds wins. Names in braces are the kinds above and,
# without ``_is``, whether there is such an object. An absent field has a null kind, so that comparing it is never
# true; VOID is a JSON null.
REJECTIONS = [
    ("{doc} IS NULL", "document is not JSON"),
    (
        "{spec_is} NOT IN ('OBJECT', 'VOID') OR {execution_is} NOT IN ('OBJECT', 'VOID') OR {layout_is} <> 'STRING'",
        "layout is not readable",
    ),
    ("{layout} NOT IN ('', 'v1', 'v2')", "layout is unknown"),
    (
        "{layout} <> '' AND ({suspended_new_is} NOT IN ('BOOLEAN', 'VOID') OR {streaming_is} NOT IN ('OBJECT', 'VOID')"
        " OR {capture_is} NOT IN ('OBJECT', 'VOID') OR {capture_template_is} NOT IN ('OBJECT', 'VOID')"
        " OR {batch_is} NOT IN ('OBJECT', 'VOID') OR {batch_template_is} NOT IN ('OBJECT', 'VOID')"
        " OR {schedule_is} NOT IN ('STRING', 'VOID') OR {capture_template_wrong} OR {batch_template_wrong}"
        " OR {layout} = 'v1' AND {backfill_v1_wrong} OR {layout} = 'v2' AND {backfill_v2_wrong})",
        "execution is not readable",
    ),
    ("{status_is} NOT IN ('OBJECT', 'VOID') OR {phase_is} <> 'STRING'", "phase is not readable"),
    ("{layout} = '' AND {suspended_old_is} IS NULL", "suspended is missing"),
    ("{layout} = '' AND {suspended_old_is} <> 'BOOLEAN'", "suspended is not a boolean"),
    ("{hash_is} <> 'STRING'", "configuration hash is not readable"),
    ("{layout} = '' AND {run_old_is} IS NULL", "job template is missing"),
    ("{layout} = '' AND {run_old_is} <> 'OBJECT'", "job template is not an object"),
    ("{layout} = '' AND {run_old_wrong}", "job template is not readable"),
    ("{layout} = '' AND {backfill_old_is} IS NULL", "backfill template is missing"),
    ("{layout} = '' AND {backfill_old_is} <> 'OBJECT'", "backfill template is not an object"),
    ("{layout} = '' AND {backfill_old_wrong}", "backfill template is not readable"),
    ("{layout} = 'v1' AND {backfill_v1_is} NOT IN ('OBJECT', 'VOID')", "backfill template is not an object"),
    ("{layout} = 'v1' AND NOT {backfill_v1}", "backfill template is missing"),
    (
        "{layout} = 'v2' AND {capture} AND {backfill_v2_is} NOT IN ('OBJECT', 'VOID')",
        "backfill template is not an object",
    ),
    ("{layout} = 'v2' AND {capture} AND NOT {backfill_v2}", "backfill template is missing"),
]


def _shape() -> str:
    """Type of a document as far as it is read: its objects as structs, their other fields as variants."""
    paths = [DOCUMENT_KIND, *VALUE_KINDS.values()]
    paths += [f"{path}.{field}" for path in REFERENCES.values() for field in REFERENCE_FIELDS]
    shape: dict = {}
    for path in paths:
        node = shape
        for field in path.split(".")[1:]:
            node = node.setdefault(field, {})

    def typed(node: dict) -> str:
        return f"struct<{', '.join(f'{name}: {typed(below)}' for name, below in node.items())}>" if node else "variant"

    return typed(shape)


def _part(path: str) -> str:
    """What stands at a path: a struct or, at the ends of ``_shape``, a variant; null if there is none."""
    return "read.parts" + path[1:]


def _text_at(path: str) -> str:
    """Text at a path, empty if there is none."""
    return f"coalesce(try_variant_get({_part(path)}, '$', 'string'), '')"


def _text(path: str) -> Column:
    return F.expr(_text_at(path))


def _flag(path: str) -> Column:
    return F.expr(f"coalesce(try_variant_get({_part(path)}, '$', 'boolean'), false)")


def _is_object(path: str) -> str:
    return f"({_part(path)} IS NOT NULL)"


def _kind(value: str) -> str:
    """STRING, BOOLEAN, ...; VOID for a JSON null; null when the field is absent."""
    return f"schema_of_variant({value})"


def _object_kind(path: str) -> str:
    """As ``_kind``, or OBJECT; the document is asked again only for what is no object though its parent is one."""
    other = f"{_is_object(path.rpartition('.')[0])} THEN {_kind(f"try_variant_get(read.doc, '{path}', 'variant')")}"
    return f"(CASE WHEN {_is_object(path)} THEN 'OBJECT' WHEN {other} END)"


def _wrong_reference(path: str) -> str:
    """Whether an object reference has a field that is no text; fields it does not know do not matter."""
    fields = ", ".join(f"{_part(path)}.{field}" for field in REFERENCE_FIELDS)
    wrong = f"exists(array({fields}), field -> {_kind('field')} NOT IN ('STRING', 'VOID'))"
    return f"({_is_object(path)} AND coalesce({wrong}, false))"


def _reason() -> str:
    names = {"doc": "read.doc", "layout": "read.layout"}
    names |= {name.removesuffix("_is"): _is_object(path) for name, path in OBJECT_KINDS.items()}
    names |= {name: _object_kind(path) for name, path in OBJECT_KINDS.items()}
    names |= {name: _kind(_part(path)) for name, path in VALUE_KINDS.items()}
    names |= {name: _wrong_reference(path) for name, path in REFERENCES.items()}
    cases = " ".join(f"WHEN {condition.format(**names)} THEN '{reason}'" for condition, reason in REJECTIONS)
    return f"CASE {cases} END"


def parsed_definitions(documents: DataFrame, *others: str) -> DataFrame:
    """Documents (``namespace``, ``name``, ``doc``) with a ``reason`` to reject them, null if there is none.

    With ``"read"`` also what was read: the parsed ``doc``, its ``parts`` and its ``layout``. All parts come out of one
    cast, since each walk from the root compares names field by field. They and the reason are
    worked out within ``transform``: so each document is read once, a kind is looked up only where a
    condition gets that far, and no part is copied between steps, which would take its names along. As generated code
    the conditions are too long a method for the JVM to compile. To read a document costs far more than to
    send it, and documents may come from few files or out of a small join, so they are dealt out evenly first, into as
    many parts as the session shuffles to: by their bytes they would come to hardly more parts than cores, and
    one part more than cores takes twice the time.
    """
    dealt = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = f"array(named_struct('doc', _doc, 'parts', try_variant_get(_doc, '$', '{_shape()}')))"
    read = f"named_struct('doc', read.doc, 'parts', read.parts, 'layout', {_text_at(LAYOUT)})"
    wanted = ", ".join([*(f"'{name}', {name}" for name in others), f"'reason', {_reason()}"])
    judged = f"transform(transform({parts}, read -> {read}), read -> named_struct({wanted}))"
    return (
        documents.select(*KEY, "doc")
        .repartition(dealt)
        .select(*KEY, F.try_parse_json("doc").alias("_doc"))
        .select(*KEY, F.inline(F.expr(judged)))
    )


def definitions_quarantine(documents: DataFrame) -> DataFrame:
    """Documents that are no valid definition, with the reason."""
    return parsed_definitions(documents).filter("reason IS NOT NULL").select(*KEY, "reason")


def backend_resolved() -> Column:
    """Scheduled batch wins over change capture; the old layout knows batch jobs only."""
    return (
        F.when(F.col("read.layout") == "", BATCH_JOB)
        .when(F.expr(_is_object(BATCH)), CRON_JOB)
        .when(F.expr(_is_object(CAPTURE)), BATCH_JOB)
        .otherwise(NO_BACKEND)
    )


def definitions_normalized(documents: DataFrame) -> DataFrame:
    """Valid definitions of all layouts in one schema.

    ``has_capture`` and ``has_batch`` tell which template references exist at all;
    ``schedule`` is null unless the backend is scheduled.
    """
    layout = F.col("read.layout")
    old = layout == ""
    backend = backend_resolved()
    spec = escaped(canonical_numbers(F.to_json(F.try_variant_get("read.doc", "$.spec", "variant"))))

    def reference(template: str, paths: dict[str, str]) -> list[Column]:
        """Namespace and name of a template that each layout keeps elsewhere."""

        def of_layout(field: str) -> Column:
            values = [F.when(layout == version, _text(f"{path}.{field}")) for version, path in paths.items()]
            return F.coalesce(*values, F.lit(""))

        return [of_layout(field).alias(f"{template}_template_{field}") for field in ("namespace", "name")]

    return (
        parsed_definitions(documents, "read")
        .filter("reason IS NULL")
        .select(
            *KEY,
            layout.alias("layout_version"),
            _text(DOCUMENT_KIND).alias("kind"),
            _text(PHASE).alias("phase"),
            F.when(old, _flag(SUSPENDED_OLD)).otherwise(_flag(SUSPENDED)).alias("suspended"),
            backend.alias("backend"),
            F.when(backend == CRON_JOB, _text(SCHEDULE)).alias("schedule"),
            F.expr(f"read.layout <> '' AND {_is_object(CAPTURE)}").alias("has_capture"),
            F.expr(f"read.layout <> '' AND {_is_object(BATCH)}").alias("has_batch"),
            *reference("run", {"": RUN_TEMPLATE_OLD, "v1": CAPTURE_TEMPLATE, "v2": CAPTURE_TEMPLATE}),
            *reference("batch", {"v1": BATCH_TEMPLATE, "v2": BATCH_TEMPLATE}),
            *reference(
                "backfill", {"": BACKFILL_TEMPLATE_OLD, "v1": BACKFILL_TEMPLATE_V1, "v2": BACKFILL_TEMPLATE_V2}
            ),
            _text(APPLIED_HASH).alias("applied_hash"),
            spec.alias("spec_json"),
        )
        .withColumn("current_hash", configuration_checksum(F.col("spec_json")))
    )


def template_ref_resolved(definitions: DataFrame, request_open: str = "request_name") -> DataFrame:
    """Template of the next run, for definitions that carry their open request (or null).

    The old layout falls back to the stream's own namespace, and takes the namespace of the
    *run* template for backfills too. A reference that the layout does not have is an error row.
    """
    old = F.col("layout_version") == ""
    backfill = F.col(request_open).isNotNull()
    own = F.coalesce(F.nullif(F.col("run_template_namespace"), F.lit("")), F.col("namespace"))
    capture = F.col("has_capture")

    def pick(field: str) -> Column:
        return (
            F.when(backfill & ((F.col("layout_version") == "v1") | capture), F.col(f"backfill_template_{field}"))
            .when(backfill, F.lit(None))
            .when(capture, F.col(f"run_template_{field}"))
            .when(F.col("has_batch"), F.col(f"batch_template_{field}"))
        )

    name = F.when(old & backfill, F.col("backfill_template_name")).when(old, F.col("run_template_name"))
    resolved = definitions.select(
        *KEY,
        F.coalesce(F.when(old, own), pick("namespace")).alias("template_namespace"),
        F.coalesce(name, pick("name")).alias("template_name"),
    )
    return resolved.withColumn(
        "error", F.when(F.col("template_name").isNull(), F.lit("the definition has no such template"))
    )
