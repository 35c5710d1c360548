"""Classes, heartbeats and small operators on hand-made rows."""

import datetime as dt
from random import Random

import pytest
from pyspark.sql import functions as F

from fleetwright.operators import classes, feeds, listings, requests, runs
from fleetwright.plans.class_lifecycle import class_lifecycle_plan

STATE = ("class_name string, phase string, deleted boolean, controller_running boolean, start_fails boolean, "
         "controller_exited boolean")

# phase, deleted, running, start fails, exited -> next phase, controller, registry, event.
CASES = [
    ("", False, False, False, False, "Pending", "keep", None, "StreamClassCreated"),
    ("Pending", False, False, False, False, "Ready", "start", "ADD", "StreamClassReady"),
    ("Pending", False, True, False, False, "Ready", "keep", None, "StreamClassReady"),
    ("Pending", False, False, True, False, "Failed", "keep", None, "StreamClassReady"),
    ("Ready", False, True, False, False, "Ready", "keep", None, None),
    ("Ready", False, False, False, False, "Ready", "start", "ADD", None),
    ("Ready", False, False, True, False, "Failed", "keep", None, "StreamClassReconciled"),
    ("Failed", False, False, False, False, "Ready", "start", "ADD", "StreamClassRecovered"),
    ("Failed", False, True, False, False, "Ready", "keep", None, "StreamClassRecovered"),
    ("Failed", False, False, True, False, "Failed", "keep", None, None),
    ("Ready", False, True, False, True, "Failed", "keep", None, "StreamControllerError"),
    ("Ready", True, True, False, False, "Ready", "stop", "REMOVE", None),
    ("Pending", True, False, False, False, "Pending", "keep", None, None),
    ("Stopped", False, False, False, False, "Stopped", "keep", None, None),
]


@pytest.mark.parametrize("case", CASES)
def test_class_transition(spark, case):
    plan = class_lifecycle_plan(spark.createDataFrame([("c", *case[:5])], STATE)).first()
    assert (plan.next_phase, plan.controller, plan.registry, plan.event_reason) == case[5:]
    assert (plan.error is not None) == (case[0] == "Stopped")


def feed(spark, *rows):
    return spark.sql(
        "SELECT kind, CAST(ts AS TIMESTAMP_NTZ) AS ts, CAST(seq AS BIGINT) AS seq, verb, '' AS phase FROM VALUES "
        + ", ".join(f"('{k}', '2024-01-01 00:{t}', {i}, '{v}')" for i, (k, t, v) in enumerate(rows))
        + " AS t(kind, ts, seq, verb)"
    )


def test_registry_keeps_the_last_word(spark):
    rows = feed(spark, ("A", "00:01", "ADD"), ("A", "00:02", "REMOVE"), ("A", "00:02", "ADD"), ("B", "00:01", "ADD"),
                ("B", "00:03", "REMOVE"))
    assert [r.kind for r in classes.class_registry(rows).collect()] == ["A"]


def test_heartbeats_follow_the_registry(spark):
    rows = feed(spark, ("A", "00:10", "ADD"), ("A", "01:05", "REMOVE"), ("A", "01:36", "ADD"), ("B", "00:50", "ADD"),
                ("C", "00:10", "ADD"), ("C", "00:20", "REMOVE"))
    beats = classes.heartbeat_counts(rows, "2024-01-01 00:00:00", "2024-01-01 00:02:35")
    start = dt.datetime(2024, 1, 1)
    seen = {(r.kind, int((r.reported_at - start).total_seconds())) for r in beats.collect()}
    # Ticks at 35, 65, 95, 125, 155 s; a removal at the tick itself already counts.
    assert seen == {("A", 35), ("A", 125), ("A", 155), ("B", 65), ("B", 95), ("B", 125), ("B", 155)}


def brute_force_ticks(words, n, interval=30, delay=5):
    """Live ticks 1..n per class, by walking the words (kind, second, seq, verb)."""
    seen = {}
    for kind in {w[0] for w in words}:
        mine = sorted((w[1], w[2], w[3]) for w in words if w[0] == kind)
        for tick in range(1, n + 1):
            before = [w for w in mine if w[0] <= delay + tick * interval]
            if before and before[-1][2] == "ADD":
                seen.setdefault(kind, []).append(tick)
    return seen


@pytest.mark.parametrize("slice_ticks, block_ticks", [(1, 1), (7, 4), (5000, 1024)])
def test_intervals_of_a_hot_class_equal_a_walk(spark, slice_ticks, block_ticks):
    random, n = Random(slice_ticks), 400
    words = [("hot", random.randrange(0, 12_000), i, random.choice(["ADD", "REMOVE"])) for i in range(900)]
    words += [(f"k{i % 9}", random.randrange(0, 12_000), 900 + i, random.choice(["ADD", "REMOVE"])) for i in range(100)]
    words += [(None, 50, 2000, "ADD"), ("early", 0, 2001, "ADD"), ("gone", 10, 2002, "REMOVE"), ("late", 99_999, 2003, "ADD")]
    rows = spark.createDataFrame(words, "kind string, s int, seq long, verb string").selectExpr(
        "kind", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) AS ts", "seq", "verb"
    )
    ticks = classes.Ticks("2024-01-01 00:00:00", "2024-01-01 03:20:05")
    spans = classes.heartbeat_intervals(rows, ticks, slice_ticks)
    expected = brute_force_ticks(words, n)
    found = {}
    for r in sorted(spans.collect(), key=lambda r: r.first_tick):
        own = found.setdefault(r.kind, [])
        assert not own or own[-1] + 1 < r.first_tick, "neighbouring intervals are one"
        own.extend(range(r.first_tick, r.last_tick + 1))
    assert found == expected
    start = dt.datetime(2024, 1, 1, 0, 0, 5)
    beats = classes.heartbeats_between(spans, ticks, F.lit(100), F.lit(130), block_ticks).collect()
    assert sorted((str(r.kind), (r.reported_at - start).total_seconds() / 30) for r in beats) == sorted(
        (str(k), t) for k, live in expected.items() for t in live if 100 <= t <= 130
    )
    asked = rows.withColumn("_first_word", F.col("verb")).withColumn("a.b", F.lit(1))
    at = classes.heartbeats_at(spans, ticks, asked, block_ticks)
    assert at.columns == [*asked.columns, "reported_at"]
    got = {r.seq: r.reported_at for r in at.collect()}
    assert len(got) == len(words)
    for kind, second, seq, _ in words:
        tick = (second - 5) // 30
        live = tick in expected.get(kind, [])
        assert got[seq] == (start + dt.timedelta(seconds=30 * tick) if live else None)


def test_intervals_of_no_words(spark):
    rows = feed(spark, ("A", "00:10", "ADD")).filter("false")
    ticks = classes.Ticks("2024-01-01 00:00:00", "2024-01-01 01:00:00")
    assert classes.heartbeat_intervals(rows, ticks).count() == 0
    assert classes.heartbeat_counts(rows).count() == 0
    asked = feed(spark, ("A", "00:40", "ADD"))
    assert classes.heartbeats_at(classes.heartbeat_intervals(rows, ticks), ticks, asked).first().reported_at is None


@pytest.mark.parametrize(
    "kind, verb, completed, failed, passes",
    [
        ("Job", "ADDED", False, False, True), ("Job", "DELETED", False, False, True),
        ("Job", "MODIFIED", False, False, False), ("Job", "MODIFIED", True, False, True),
        ("Job", "MODIFIED", False, True, True), ("Job", "GENERIC", True, True, False),
        ("CronJob", "MODIFIED", False, False, True), ("CronJob", "GENERIC", False, False, False),
        ("Stream", "ADDED", True, True, False),
    ],
)
def test_run_event_predicate(spark, kind, verb, completed, failed, passes):
    rows = spark.createDataFrame([(kind, verb, completed, failed)], "kind string, verb string, completed boolean, failed boolean")
    assert (feeds.relevant_run_events(rows).count() == 1) == passes


OWNED = ("seq int, namespace string, "
         "owner_references array<struct<api_version:string,kind:string,name:string,controller:boolean>>")


def test_only_controlling_owners(spark):
    rows = spark.createDataFrame(
        [(1, "ns", [("g/v1", "K", "a", True), ("g/v1", "K", "b", False)]), (2, "ns", [("g/v1", "K", "a", False)]),
         (3, "ns", [])], OWNED,
    )
    assert [(r.seq, r["name"]) for r in feeds.controller_owner(rows).collect()] == [(1, "a")]


def test_owner_must_be_of_the_streams_kind(spark):
    streams = spark.createDataFrame(
        [("ns", "a", "g", "K", "c"), ("other", "a", "g", "K", "c")],
        "namespace string, name string, api_group string, kind string, stream_class string",
    )
    owners = [("g/v1", "K", "a"), ("g/v2", "K", "a"), ("h/v1", "K", "a"), ("v1", "K", "a"), ("g/v1", "L", "a"),
              ("g/v1", "K", "b")]
    rows = spark.createDataFrame([(i, "ns", [(*o, True)]) for i, o in enumerate(owners)], OWNED)
    assert sorted(r.seq for r in feeds.event_to_owner(rows, streams).collect()) == [0, 1]


def test_backfill_label_in_any_case(spark):
    rows = spark.createDataFrame([({"fleet/backfilling": v} if v else {"x": "y"},) for v in ("True", "true", "no", None)],
                                 "labels map<string,string>")
    assert [r[0] for r in rows.select(runs.is_backfill_run()).collect()] == [True, True, False, False]


def test_condition_must_be_true(spark):
    rows = spark.createDataFrame(
        [("BatchJobBackend", [("Complete", "False"), ("Failed", "True")]), ("BatchJobBackend", [("Complete", "True")]),
         ("BatchJobBackend", None), ("CronJob", [("Failed", "True")]), ("", None)],
        "backend string, conditions array<struct<type:string,status:string>>",
    )
    state = [(r.is_completed, r.is_failed) for r in runs.job_state(rows).collect()]
    assert state == [(False, True), (True, False), (False, False), (False, False), (True, False)]


def test_drift(spark):
    streams = spark.createDataFrame(
        [("n", name, "BatchJobBackend", "h") for name in ("new", "same", "old", "bare")] + [("n", "none", "", "h")],
        "namespace string, name string, backend string, current_hash string",
    )
    run = "namespace string, name string, annotations map<string,string>"
    jobs = spark.createDataFrame(
        [("n", "same", {"configuration-hash": "h"}), ("n", "old", {"configuration-hash": "x"}), ("n", "bare", {})], run)
    crons = spark.createDataFrame([("n", "new", {"configuration-hash": "h"})], run)
    drift = {r["name"]: r.drift for r in runs.configuration_drift(streams, jobs, crons).collect()}
    assert drift == {"new": "create", "same": "keep", "old": "recreate", "bare": "error"}


def test_one_request_per_stream_of_any_class(spark):
    streams = spark.createDataFrame([("n", "a"), ("m", "a"), ("n", "b")], "namespace string, name string")
    asked = spark.createDataFrame(
        [("n", "a", 1, "r1", "x", True), ("n", "a", 3, "r3", "x", False), ("n", "a", 2, "r2", "y", False)],
        "namespace string, stream_id string, request_id long, request_name string, stream_class string, completed boolean",
    )
    found = {(r.namespace, r["name"]): r.request_name for r in requests.stream_open_request(streams, asked).collect()}
    assert found == {("n", "a"): "r2", ("m", "a"): None, ("n", "b"): None}


def test_template_without_containers(spark):
    rows = spark.createDataFrame(
        [("n", "t", [])],
        "namespace string, name string, containers array<struct<name:string,image:string,limits:map<string,string>>>",
    )
    assert listings.template_listing(rows).first().image is None

