"""Sliced windows against plain Python, also with one key holding most rows."""

import datetime as dt
import random

import pytest

from fleetwright.functions.latest import first_per_key, latest_per_key
from fleetwright.functions.neighbours import time_slice, with_next, with_previous
from fleetwright.operators.status import phase_transitions, time_in_phase

START = dt.datetime(2024, 1, 1)


def events(count=3000, seed=1):
    random.seed(seed)
    rows = []
    for seq in range(count):
        name = "hot" if random.random() < 0.6 else f"s{random.randrange(40)}"
        # Whole minutes, so that many rows share a time and the sequence number decides.
        ts = START + dt.timedelta(minutes=random.randrange(-600, 3000))
        rows.append((name, ts, seq, random.choice("AAB")))
    return rows


@pytest.fixture(scope="module")
def feed(spark):
    return spark.createDataFrame(events(), "name string, ts timestamp_ntz, seq long, phase string").repartition(7)


def by_key():
    groups = {}
    for row in sorted(events(), key=lambda r: (r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("seconds", [60, 3600, 10**9])
def test_previous_and_next(spark, feed, seconds):
    before, after = {}, {}
    for rows in by_key().values():
        for a, b in zip([None, *rows], [*rows, None]):
            if b:
                before[b[2]] = a and a[2]
            if a:
                after[a[2]] = b and b[2]
    args = (["name"], ["ts", "seq"], time_slice("ts", seconds), ["seq"])
    assert {r.seq: r.previous and r.previous.seq for r in with_previous(feed, *args).collect()} == before
    assert {r.seq: r.next and r.next.seq for r in with_next(feed, *args).collect()} == after


def expected_changes():
    changes = []
    for name, rows in by_key().items():
        phase = ""
        for _, ts, seq, new in rows:
            if new != phase:
                changes.append((name, ts, seq, phase, new))
            phase = new
    return changes


@pytest.mark.parametrize("seconds", [60, 3600])
def test_transitions(feed, seconds):
    assert sorted(map(tuple, phase_transitions(feed, ["name"], seconds).collect())) == sorted(expected_changes())


def test_dwell(feed):
    changes = sorted(expected_changes(), key=lambda c: (c[0], c[1], c[2]))
    expected = {}
    for a, b in zip(changes, [*changes[1:], None]):
        same = b and a[0] == b[0]
        expected[a[2]] = int((b[1] - a[1]).total_seconds() * 1000) if same else None
    assert {r.seq: r.dwell_ms for r in time_in_phase(feed, ["name"]).collect()} == expected


def test_hot_key_is_spread(spark, feed):
    """The first window is partitioned by key and slice, so no task holds the whole hot key."""
    plan = phase_transitions(feed, ["name"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(name" in plan and "_slice" in plan


def test_latest_and_first(feed):
    latest = {r["name"]: r.seq for r in latest_per_key(feed, ["name"], ["ts", "seq"]).collect()}
    first = {r["name"]: r.seq for r in first_per_key(feed, ["name"], ["ts", "seq"]).collect()}
    assert latest == {n: rows[-1][2] for n, rows in by_key().items()}
    assert first == {n: rows[0][2] for n, rows in by_key().items()}


def test_latest_combines_before_the_shuffle(feed):
    plan = latest_per_key(feed, ["name"], ["ts", "seq"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan


def test_input_is_shuffled_once(spark, folder):
    """Both windows over the slices read the same exchange."""
    from checks.queries import QUERIES

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES["phase_transitions"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1
