"""Run parameters, step by step, on single rows."""

import pytest
from pyspark.sql import functions as F

from fleetwright.functions.text import configuration_checksum, snake_case
from fleetwright.operators import parameters as p

ENV = "array<struct<name:string,value:string,value_from:string>>"
SCHEMA = (
    f"namespace string, name string, kind string, api_version string, uid string, backend string, phase string, spec_json string, "
    f"containers array<struct<name:string,env:{ENV}>>, labels map<string,string>, annotations map<string,string>, "
    "owner_references array<struct<api_version:string,kind:string,name:string,uid:string,controller:boolean>>, "
    "request_name string, request_class string"
)


def run(spark, containers, name="s1", namespace="ns", kind="K", backend="BatchJobBackend", request=None, labels=None,
        annotations=None, owners=(), phase="Running"):
    env = [(c, [(v[0], v[1], None) for v in variables]) for c, variables in containers.items()]
    row = (namespace, name, kind, "g/v1", "u1", backend, phase, '{"a":1}', env, labels or {}, annotations or {},
           list(owners), request, "cls" if request else None)
    return spark.createDataFrame([row], SCHEMA)


def env(df, container="c"):
    containers = {c.name: [tuple(v) for v in c.env] for c in df.first().containers}
    return containers[container]


def test_metadata_goes_to_every_container(spark):
    df = run(spark, {"c": [("X", "1")], "d": []}, labels={"k": "v"})
    out = p.build(df, [p.stream_metadata()])
    added = [("STREAMCONTEXT__STREAM_ID", "s1", None), ("STREAMCONTEXT__STREAM_KIND", "K", None)]
    assert env(out) == [("X", "1", None), *added]
    assert env(out, "d") == added
    assert out.first().labels == {"k": "v", "fleet/stream-id": "s1", "fleet/stream-kind": "K"}


@pytest.mark.parametrize(
    "changes, error",
    [({"name": ""}, "stream id is empty"), ({"kind": ""}, "stream kind is empty")],
)
def test_metadata_needs_id_and_kind(spark, changes, error):
    assert p.build(run(spark, {"c": []}, **changes), [p.stream_metadata()]).first().error == error


@pytest.mark.parametrize("taken", ["STREAMCONTEXT__STREAM_ID", "STREAMCONTEXT__STREAM_KIND"])
def test_metadata_must_not_be_taken(spark, taken):
    out = p.build(run(spark, {"c": [], "d": [(taken, "x")]}), [p.stream_metadata()]).first()
    assert out.error == f"environment variable {taken} already present"
    assert [len(c.env) for c in out.containers] == [0, 1]


def test_no_containers_no_variables(spark):
    assert p.build(run(spark, {}), [p.stream_metadata()]).first().containers == []


def test_context_is_added_twice_without_check(spark):
    df = run(spark, {"c": []})
    out = p.build(df, [p.stream_context("spec", "spec_json"), p.stream_context("Spec", "spec_json")])
    assert env(out) == [("STREAMCONTEXT__SPEC", '{"a":1}', None)] * 2


def test_flag_overwrites_only_the_first_match(spark):
    name = "STREAMCONTEXT__BACKFILL"
    df = run(spark, {"c": [(name, "x"), ("Y", "2"), (name, "y")], "d": []})
    out = p.build(df, [p.backfill_flag(F.lit(True))])
    assert env(out) == [(name, "true", None), ("Y", "2", None), (name, "y", None)]
    assert env(out, "d") == [(name, "true", None)]
    assert out.first().labels == {"fleet/backfilling": "true"}


def test_dynamic_then_static_id_keeps_the_source(spark):
    df = run(spark, {"c": []})
    out = p.build(df, [p.dynamic_backfill_id(), p.static_backfill_id("request_name")])
    assert env(out) == [("STREAMCONTEXT__BACKFILL_ID", "", "metadata.labels['job-name']")]


def test_static_id_updates(spark):
    df = run(spark, {"c": [("STREAMCONTEXT__BACKFILL_ID", "old")]}, request="bf")
    assert env(p.build(df, [p.static_backfill_id("request_name")])) == [("STREAMCONTEXT__BACKFILL_ID", "bf", None)]


def test_checksum_overwrites_and_keeps_others(spark):
    df = run(spark, {}, annotations={"configuration-hash": "old", "k": "v"}).withColumn("checksum", F.lit("h"))
    step = [p.checksum_annotation()]
    assert p.build(df, step).first().annotations == {"configuration-hash": "h", "k": "v"}
    empty = p.build(df.withColumn("checksum", F.lit("")), step)
    assert empty.first().error == "configuration checksum is empty"


def test_owner_is_appended(spark):
    df = run(spark, {}, owners=[("v", "O", "o", "u0", False)])
    out = p.build(df, [p.owner_reference(), p.owner_reference()]).first().owner_references
    assert [(o.kind, o.name, o.controller) for o in out] == [("O", "o", False), ("K", "s1", True), ("K", "s1", True)]


@pytest.mark.parametrize(
    "changes, error", [({"name": ""}, "job name is empty"), ({"namespace": ""}, "namespace is empty")]
)
def test_first_error_stops_the_chain(spark, changes, error):
    out = p.run_parameters(run(spark, {"c": []}, **changes)).first()
    assert out.error == error
    assert out.containers[0].env == [] and out.owner_references == []


def names(df):
    return [(v[0].removeprefix("STREAMCONTEXT__"), v[1]) for v in env(df)]


def test_order_without_request(spark):
    out = p.run_parameters(run(spark, {"c": [("X", "1")]}))
    assert names(out) == [("X", "1"), ("STREAM_ID", "s1"), ("STREAM_KIND", "K"), ("SPEC", '{"a":1}'), ("BACKFILL", "false")]


def test_order_with_request(spark):
    out = p.run_parameters(run(spark, {"c": []}, request="bf-1"))
    assert names(out) == [
        ("STREAM_ID", "s1"), ("STREAM_KIND", "K"), ("SPEC", '{"a":1}'),
        ("OVERRIDE", '{"streamClass":"cls","streamId":"s1"}'), ("BACKFILL", "true"), ("BACKFILL_ID", "bf-1"),
    ]


def test_scheduled_run(spark):
    out = p.run_parameters(run(spark, {"c": []}, backend="CronJob", labels={"k": "v"}, request="bf-1"))
    assert names(out) == [
        ("STREAM_ID", "s1"), ("STREAM_KIND", "K"), ("SPEC", '{"a":1}'), ("BACKFILL", "true"), ("BACKFILL_ID", ""),
        ("OVERRIDE", '{"streamClass":"","streamId":""}'),
    ]
    row = out.first()
    assert row.containers[0].env[4].value_from == "metadata.labels['job-name']"
    assert row.labels == {}
    assert row.annotations == {"configuration-hash": out.select(F.md5("spec_json")).first()[0]}
    assert [o.name for o in row.owner_references] == ["s1"]


def test_combined_checksum(spark):
    row = spark.range(1).select(
        configuration_checksum(F.lit("a")).alias("own"), configuration_checksum(F.lit("a"), F.lit("b")).alias("both")
    ).first()
    own, asked = "0cc175b9c0f1b6a831c399e269772661", "92eb5ffee6ae2fec3ad71c777531578f"
    assert row.own == own
    assert row.both == f"{own.encode().hex()}:{asked.encode().hex()}"


@pytest.mark.parametrize(
    "name, expected",
    [("SqlABCStream", "sql_abcstream"), ("ABC", "abc"), ("aBcD", "a_bc_d"), ("My1Stream", "my1stream"), ("", "")],
)
def test_snake_case(spark, name, expected):
    assert spark.range(1).select(snake_case(F.lit(name))).first()[0] == expected


def test_override_wins_by_field(spark):
    df = spark.createDataFrame(
        [("ns", "a", '{"x":1,"y":{"z":2}}', '{"x":3,"w":"t"}'), ("ns", "b", '{"x":1}', None)],
        "namespace string, name string, spec_json string, override_json string",
    )
    rows = {(r["name"], r.field): r.value for r in p.request_override(df).collect()}
    assert rows == {("a", "x"): "3", ("a", "y"): '{"z":2}', ("a", "w"): "t", ("b", "x"): "1"}


STEPS = [
    ("flag on", lambda: p.backfill_flag(F.lit(True), only=F.col("name") != "a")),
    ("flag off", lambda: p.backfill_flag(F.lit(False), only=F.col("name") == "b")),
    ("source", lambda: p.dynamic_backfill_id(only=F.col("name") != "c")),
    ("id", lambda: p.static_backfill_id("request_name")),
    ("context", lambda: p.stream_context("spec", "spec_json", only=F.col("name") == "a")),
]


@pytest.mark.parametrize("seed", range(4))
def test_one_pass_equals_step_by_step(spark, seed):
    import random

    order = [step for _, step in random.Random(seed).sample(STEPS, len(STEPS))]
    preset = [("STREAMCONTEXT__BACKFILL_ID", "x"), ("Y", "1"), ("STREAMCONTEXT__BACKFILL_ID", "y")]
    df = run(spark, {"c": preset, "d": [("STREAMCONTEXT__BACKFILL", "z")], "e": []}, name="a", request="r")
    for name in "bc":
        df = df.unionByName(
            run(spark, {"c": preset, "d": [("STREAMCONTEXT__BACKFILL", "z")], "e": []}, name=name, request="r")
        )
    one_by_one = df
    for step in order:
        one_by_one = p.build(one_by_one.drop("error"), [step()])
    at_once = p.build(df, [step() for step in order])

    def result(frame):
        return {r["name"]: (r.containers, r.labels) for r in frame.collect()}

    assert result(at_once) == result(one_by_one)


def test_set_and_added_names_must_differ(spark):
    with pytest.raises(ValueError):
        p.build(run(spark, {"c": []}), [p.stream_context("backfill", "spec_json"), p.backfill_flag(F.lit(True))])


def test_pending_scheduled_stream_answers_its_request(spark):
    """It runs as a batch job with the real request; otherwise the scheduled run has the placeholder."""
    built = {}
    for phase in ("Pending", "Scheduled"):
        df = run(spark, {"c": []}, backend="CronJob", request="bf-1", labels={"k": "v"}, phase=phase)
        built[phase] = p.run_parameters(df)
    asked = {n: v for n, v, _ in env(built["Pending"])}
    assert asked["STREAMCONTEXT__BACKFILL_ID"] == "bf-1" and '"streamId":"s1"' in asked["STREAMCONTEXT__OVERRIDE"]
    assert built["Pending"].first().labels["k"] == "v"
    placeholder = {n: v for n, v, _ in env(built["Scheduled"])}
    assert '"streamId":""' in placeholder["STREAMCONTEXT__OVERRIDE"] and built["Scheduled"].first().labels == {}
    hashes = [b.first().annotations["configuration-hash"] for b in built.values()]
    assert hashes[0] != hashes[1]
