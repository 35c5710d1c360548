"""Documents of every layout, valid or not."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from fleetwright.functions.text import spelled_number
from fleetwright.operators.classes import secret_ref_fields
from fleetwright.operators.definitions import (
    definitions_normalized,
    definitions_quarantine,
    template_ref_resolved,
)

REF = {"name": "t", "namespace": "tns"}
OLD = {"suspended": True, "jobTemplateRef": REF, "backfillJobTemplateRef": {"name": "b"}}
V1 = {"execution": {"layoutVersion": "v1", "suspended": False, "backfillJobTemplateRef": {"name": "b"},
                    "streamingBackend": {"changeCapture": {"jobTemplateRef": REF}}}}
V2 = {"execution": {"layoutVersion": "v2", "streamingBackend": {
    "changeCapture": {"jobTemplateRef": REF, "backfillJobTemplateRef": {"name": "b", "namespace": "bns"}}}}}
CRON = {"execution": {"layoutVersion": "v2", "streamingBackend": {
    "batch": {"schedule": "* * * * *", "jobTemplateRef": {"name": "cron"}}}}}
BOTH = {"execution": {"layoutVersion": "v2", "streamingBackend": {
    **CRON["execution"]["streamingBackend"], **V2["execution"]["streamingBackend"]}}}


def changed(spec, path, value=None, drop=False):
    copy = json.loads(json.dumps(spec))
    *parents, last = path.split(".")
    node = copy
    for parent in parents:
        node = node[parent]
    if drop:
        del node[last]
    else:
        node[last] = value
    return copy


BAD = {
    "document is not JSON": ['{"spec":', ""],
    "layout is not readable": [
        {"spec": "text"}, {"spec": {"execution": 1}}, {"spec": {"execution": {"layoutVersion": 1}}},
        {"spec": {"execution": {"layoutVersion": None}}},
    ],
    "layout is unknown": [{"spec": {"execution": {"layoutVersion": "v3"}}}],
    "execution is not readable": [
        {"spec": changed(V1, "execution.suspended", "yes")},
        {"spec": changed(V2, "execution.streamingBackend", [])},
        {"spec": changed(CRON, "execution.streamingBackend.batch.schedule", 5)},
        {"spec": changed(CRON, "execution.streamingBackend.batch.jobTemplateRef", {"name": 5})},
        {"spec": changed(V1, "execution.streamingBackend.changeCapture.jobTemplateRef.namespace", 7)},
        {"spec": changed(V1, "execution.backfillJobTemplateRef.kind", True)},
        {"spec": changed(V2, "execution.streamingBackend.changeCapture.backfillJobTemplateRef.uid", [])},
    ],
    "phase is not readable": [{"spec": OLD, "status": {"phase": 3}}, {"spec": V1, "status": "Running"}],
    "suspended is missing": [{"spec": changed(OLD, "suspended", drop=True)}, {}, {"spec": {}}, {"spec": None}],
    "suspended is not a boolean": [{"spec": changed(OLD, "suspended", "true")}],
    "configuration hash is not readable": [{"spec": OLD, "status": {"configurationHash": {}}}],
    "job template is missing": [{"spec": changed(OLD, "jobTemplateRef", drop=True)}],
    "job template is not an object": [{"spec": changed(OLD, "jobTemplateRef", "t")}],
    "job template is not readable": [
        {"spec": changed(OLD, "jobTemplateRef.name", 5)}, {"spec": changed(OLD, "jobTemplateRef.namespace", 7)},
        {"spec": changed(OLD, "jobTemplateRef.apiVersion", {})},
    ],
    "backfill template is not readable": [
        {"spec": changed(OLD, "backfillJobTemplateRef.name", False)},
        {"spec": changed(OLD, "backfillJobTemplateRef.fieldPath", 1.5)},
    ],
    "backfill template is missing": [
        {"spec": changed(OLD, "backfillJobTemplateRef", drop=True)},
        {"spec": changed(V1, "execution.backfillJobTemplateRef", drop=True)},
        {"spec": changed(V1, "execution.backfillJobTemplateRef", None)},
        {"spec": changed(V2, "execution.streamingBackend.changeCapture.backfillJobTemplateRef", drop=True)},
    ],
    "backfill template is not an object": [
        {"spec": changed(OLD, "backfillJobTemplateRef", 1)},
        {"spec": changed(V1, "execution.backfillJobTemplateRef", "b")},
    ],
}


def documents(spark, docs):
    rows = [("ns", name, d if isinstance(d, str) else json.dumps(d)) for name, d in docs.items()]
    return spark.createDataFrame(rows, "namespace string, name string, doc string")


@pytest.fixture(scope="module")
def good(spark):
    docs = {
        "old": {"kind": "K", "spec": OLD, "status": {"phase": "Running", "configurationHash": "h"}},
        "old, empty version": {"spec": {**OLD, "execution": {"layoutVersion": ""}}},
        "v1": {"spec": V1}, "v2": {"spec": V2}, "cron": {"spec": CRON}, "both": {"spec": BOTH},
        "none": {"spec": {"execution": {"layoutVersion": "v2"}}},
        "null capture": {"spec": {"execution": {"layoutVersion": "v2", "streamingBackend": {"changeCapture": None}}}},
    }
    return documents(spark, docs)


def test_rejected_with_first_reason(spark):
    docs, expected = {}, {}
    for reason, bad in BAD.items():
        for i, doc in enumerate(bad):
            docs[f"{reason} {i}"] = doc
            expected[f"{reason} {i}"] = reason
    frame = documents(spark, docs)
    assert {r["name"]: r.reason for r in definitions_quarantine(frame).collect()} == expected
    assert definitions_normalized(frame).count() == 0


def test_null_parents_count_as_absent(spark):
    docs = {
        "status": {"spec": OLD, "status": None},
        "execution": {"spec": {**OLD, "execution": None}},
        "neither": {"spec": OLD},
    }
    frame = documents(spark, docs)
    assert definitions_quarantine(frame).count() == 0
    rows = {(r["layout_version"], r["phase"], r["suspended"]) for r in definitions_normalized(frame).collect()}
    assert rows == {("", "", True)}


def test_null_and_unknown_reference_fields_are_readable(spark):
    elsewhere = changed(V1, "execution.streamingBackend.changeCapture.backfillJobTemplateRef", {"name": 5})
    docs = {
        "null": {"spec": changed(OLD, "jobTemplateRef.namespace", None)},
        "unknown": {"spec": changed(OLD, "jobTemplateRef.weight", 5)},
        "no fields": {"spec": changed(OLD, "backfillJobTemplateRef", {})},
        "of another layout": {"spec": elsewhere},
    }
    frame = documents(spark, docs)
    assert definitions_quarantine(frame).count() == 0
    rows = {r["name"]: r for r in definitions_normalized(frame).collect()}
    assert (rows["null"].run_template_namespace, rows["null"].run_template_name) == ("", "t")
    assert rows["no fields"].backfill_template_name == ""


def test_layouts_come_to_one_schema(good):
    rows = {r["name"]: r for r in definitions_normalized(good).collect()}
    assert len(rows) == 8
    assert (rows["old"].phase, rows["old"].suspended, rows["old"].applied_hash) == ("Running", True, "h")
    assert rows["v1"].phase == "" and not rows["v2"].suspended
    backends = {n: r.backend for n, r in rows.items()}
    assert backends == {
        "old": "BatchJobBackend", "old, empty version": "BatchJobBackend", "v1": "BatchJobBackend",
        "v2": "BatchJobBackend", "cron": "CronJob", "both": "CronJob", "none": "", "null capture": "",
    }
    assert {n for n, r in rows.items() if r.schedule is not None} == {"cron", "both"}


@pytest.mark.parametrize("asked", [False, True])
def test_templates(good, asked):
    from pyspark.sql import functions as F

    frame = definitions_normalized(good).withColumn("request_name", F.lit("bf" if asked else None))
    rows = {r["name"]: (r.template_namespace, r.template_name) for r in template_ref_resolved(frame).collect()}
    if asked:
        expected = {"old": ("tns", "b"), "v1": ("", "b"), "v2": ("bns", "b"), "both": ("bns", "b"),
                    "cron": (None, None), "none": (None, None)}
    else:
        expected = {"old": ("tns", "t"), "v1": ("tns", "t"), "v2": ("tns", "t"), "both": ("tns", "t"),
                    "cron": ("", "cron"), "none": (None, None)}
    assert {n: rows[n] for n in expected} == expected


def test_old_layout_falls_back_to_own_namespace(spark):
    from pyspark.sql import functions as F

    frame = documents(spark, {"a": {"spec": changed(OLD, "jobTemplateRef", {"name": "t"})}})
    resolved = template_ref_resolved(definitions_normalized(frame).withColumn("request_name", F.lit(None))).first()
    assert (resolved.template_namespace, resolved.template_name) == ("ns", "t")


def test_checksum_is_of_sorted_escaped_json(spark):
    spec = {**OLD, "zeta": "<a & b>\u2028", "alpha": [1, 2.5, {"y": 1, "b": None}], "text": "\u00fc\"q\""}
    frame = documents(spark, {"a": {"spec": spec}})
    text = json.dumps(spec, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for raw in "<>&\u2028\u2029":
        text = text.replace(raw, f"\\u{ord(raw):04x}")
    row = definitions_normalized(frame).first()
    assert row.spec_json == text
    assert row.current_hash == hashlib.md5(text.encode()).hexdigest()


def test_checksum_changes_with_the_destination(spark):
    frame = documents(spark, {n: {"spec": {**OLD, "destination": n}} for n in ("a", "b")})
    assert definitions_normalized(frame).select("current_hash").distinct().count() == 2


# JSON numbers and how the platform spells them.
NUMBERS = {
    "1e3": "1000", "1E+2": "100", "1e21": "1e+21", "1.5e300": "1.5e+300", "1e20": "100000000000000000000", "1e-7": "1e-7",
    "2.50e-10": "2.5e-10", "3.0e-5": "0.00003", "0.000001": "0.000001", "12345678901234567890": "12345678901234567000",
    "9223372036854775807": "9223372036854775807", "9223372036854775808": "9223372036854776000", "-0.50": "-0.5",
    "1.0": "1", "0.0": "0", "0.1": "0.1", "123.456e5": "12345600", "-7": "-7", "1.7976931348623157e308": "1.7976931348623157e+308",
}


def test_numbers_are_spelled_as_by_the_platform(spark):
    frame = spark.createDataFrame([(k,) for k in NUMBERS], "text string")
    found = frame.select("text", spelled_number(F.col("text")).alias("spelled")).collect()
    assert {r["text"]: r["spelled"] for r in found} == NUMBERS


def test_checksum_of_a_spec_with_numbers(spark):
    strings = {"s": 'quoted \\" 1.50 \\\\', "1e3": "<1e3>"}
    for number, spelled in NUMBERS.items():
        spec = json.dumps({**OLD, **strings})[:-1] + f', "n": [{number}, {{"m": {number}}}]}}'
        frame = spark.createDataFrame([("n", "a", f'{{"spec": {spec}}}')], "namespace string, name string, doc string")
        row = definitions_normalized(frame).first()
        assert row["spec_json"].count(f'"n":[{spelled},{{"m":{spelled}}}]') == 1
        plain = json.dumps({**OLD, **strings}, sort_keys=True, separators=(",", ":")).replace("<", "\\u003c").replace(">", "\\u003e")
        assert row["spec_json"].replace(f'"n":[{spelled},{{"m":{spelled}}}],', "") == plain


@pytest.fixture(scope="module")
def one_part(spark):
    """Documents of 2 KB that hardly compress, all in one partition; every fourth one lacks its backfill template."""
    noise = "array_join(transform(sequence(1, 30), k -> sha2(concat(id, '-', k), 256)), '')"
    backfill = """if(id % 4 = 0, '', ',"backfillJobTemplateRef":{"name":"b"}')"""
    doc = f"""concat('{{"spec":{{"suspended":true,"jobTemplateRef":{{"name":"t"}}', {backfill}, ',"note":"', {noise}, '"}}}}')"""
    return spark.range(0, 4_000, 1, 1).selectExpr("'ns' AS namespace", "concat('s', id) AS name", f"{doc} AS doc")


def parts_and_rows(frame):
    parts = frame.groupBy(F.spark_partition_id()).count().collect()
    return len(parts), sum(r["count"] for r in parts)


def test_secrets_of_one_partition_are_read_by_many_tasks(spark, one_part):
    classes = spark.createDataFrame([("c", ["jobTemplateRef"])], "stream_class string, secret_refs array<string>")
    streams = definitions_normalized(one_part).select("namespace", "name", F.lit("c").alias("stream_class"), "spec_json")
    parts, found = parts_and_rows(secret_ref_fields(F.broadcast(classes), streams).filter("secret_name = 't'"))
    assert parts > 1 and found == 3_000


def test_valid_documents_of_one_partition_are_read_by_many_tasks(one_part):
    parts, found = parts_and_rows(definitions_normalized(one_part))
    assert parts > 1 and found == 3_000


def test_rejected_documents_of_one_partition_are_read_by_many_tasks(one_part):
    parts, found = parts_and_rows(definitions_quarantine(one_part))
    assert parts > 1 and found == 1_000


def walks_from_the_root(frame):
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"try_variant_get\(_doc#", plan))


def test_parts_of_valid_documents_come_out_of_one_walk(one_part):
    assert walks_from_the_root(definitions_normalized(one_part)) == 1


def test_parts_of_rejected_documents_come_out_of_one_walk(one_part):
    assert walks_from_the_root(definitions_quarantine(one_part)) == 1


def test_reason_of_rejected_documents_is_worked_out_once(one_part):
    plan = definitions_quarantine(one_part)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("document is not JSON") == 1


def test_documents_of_few_bytes_come_to_as_many_parts_as_the_session_shuffles_to(spark):
    docs = spark.range(0, 400, 1, 1).selectExpr("'ns' AS namespace", "concat('s', id) AS name", "'[]' AS doc")
    parts, found = parts_and_rows(definitions_quarantine(docs))
    assert parts == int(spark.conf.get("spark.sql.shuffle.partitions")) and found == 400


def test_kinds_of_parts_that_are_no_objects(spark):
    docs = {str(i): d for i, d in enumerate([[], [{"spec": OLD}], 5, "text", None])}
    docs |= {f"spec {json.dumps(d)}": {"spec": d} for d in ([], [OLD], 5, True)}
    docs |= {f"status {json.dumps(d)}": {"spec": OLD, "status": d} for d in ([], [{}], 5, "text")}
    frame = documents(spark, docs).unionByName(spark.createDataFrame([("ns", "no text", None)], "namespace string, name string, doc string"))
    expected = {str(i): "suspended is missing" for i in range(5)} | {"3": "document is not JSON", "no text": "document is not JSON"}
    expected |= {n: "layout is not readable" for n in docs if n.startswith("spec")}
    expected |= {n: "phase is not readable" for n in docs if n.startswith("status")}
    assert {r["name"]: r.reason for r in definitions_quarantine(frame).collect()} == expected
