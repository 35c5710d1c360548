"""Every registered query against its SQL counterpart, and the shape of its plan."""

import pytest

from checks.compare import connect, difference
from checks.oracles import ORACLES
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, folder, name):
    assert difference(spark, connection, folder, name) is None


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["lifecycle_plan", "run_parameters", "definitions_normalized", "time_in_phase", "orphan_runs",
             "heartbeat_counts", "backfill_handoff", "run_census"],
)
def test_plan_has_no_pair_joins_and_no_python(spark, folder, name):
    plan = plan_of(QUERIES[name](spark, folder))
    for word in ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas"):
        assert word not in plan


def test_open_request_filter_reaches_the_scan(spark, folder):
    plan = plan_of(QUERIES["stream_open_request"](spark, folder))
    assert "EqualTo(o_orderstatus,P)" in plan


def test_document_is_parsed_once(spark, folder):
    plan = plan_of(QUERIES["definitions_normalized"](spark, folder))
    assert plan.count("parseJson") == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
