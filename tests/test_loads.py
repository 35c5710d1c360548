"""Resumable backfills, runs that do not overlap, gap detection, seams per stream."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetwright.operators import backfills, gaps
from fleetwright.operators.loads import handoff_by_stream, latest_run, scheduled_batch
from fleetwright.operators.schedules import next_allowed, runs_allowed
from fleetwright.session import new_folder

DAY = datetime(2024, 1, 1)


def rows(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()))


@pytest.fixture(scope="module")
def source(spark):
    """One stream with a third of the rows, twenty others; a row without time, one that stands there twice."""
    draw = random.Random(5)
    made = [
        ("n", "hot" if k % 3 == 0 else f"s{k % 20:02d}", DAY + timedelta(minutes=draw.randrange(40_000)), k, k * 0.5)
        for k in range(3_000)
    ]
    made += [("n", "s00", None, 5_000, 1.0), ("m", "s00", DAY, 5_001, 2.0), ("m", "s00", DAY, 5_001, 2.0)]
    frame = spark.createDataFrame(made, "namespace string, name string, ts timestamp_ntz, event_id long, value double")
    place = new_folder(spark, "test-source")
    frame.repartition(5).write.parquet(place)
    return spark.read.schema(frame.schema).parquet(place)


def test_chunks_are_ranges_of_like_size(source):
    found = backfills.chunks(source, 200).orderBy("chunk").collect()
    assert [r["chunk"] for r in found] == list(range(len(found))) and 15 <= len(found) <= 16
    assert sum(r["rows"] for r in found) == source.count() and all(190 <= r["rows"] <= 212 for r in found[:-1])
    assert found[-1]["next"] is None
    for one, other in zip(found, found[1:], strict=False):
        assert tuple(one["next"]) == (other["namespace"], other["name"], other["slice"])
    # The stream with a third of the rows is cut into several chunks.
    assert sum(r["name"] == "hot" for r in found) >= 4


@pytest.mark.parametrize("stop", [0, 4])
def test_stopped_and_resumed_load_equals_a_full_one(spark, source, stop):
    place = new_folder(spark, "test")
    backfills.plan_backfill(spark, source, place, 500)
    total = backfills.open_chunks(spark, place).count()
    assert backfills.backfilled_rows(spark, place, source.schema).count() == 0
    load = backfills.resume_backfill(spark, source, place)
    first = [next(load) for _ in range(stop)]
    # The next chunk's load is cut off before its mark.
    source.write.parquet(f"{place}/rows/chunk={stop}/attempt=cut-off")
    assert backfills.open_chunks(spark, place).count() == total - stop
    rest = list(backfills.resume_backfill(spark, source, place))
    assert first + rest == list(range(total)) and total == 7
    columns = source.columns
    loaded = backfills.backfilled_rows(spark, place, source.schema)
    assert sorted(map(str, loaded.select(*columns).collect())) == sorted(map(str, source.collect()))
    assert list(backfills.resume_backfill(spark, source, place)) == []


def test_rows_that_come_after_planning_are_in_some_chunk(spark, source):
    place = new_folder(spark, "test")
    backfills.plan_backfill(spark, source, place, 1_000)
    late = source.limit(1).select(F.lit("a").alias("namespace"), F.lit("a").alias("name"), "ts", F.lit(9_001).cast("long").alias("event_id"), "value")
    more = source.unionByName(late).unionByName(late.withColumn("namespace", F.lit("z")))
    assert len(list(backfills.resume_backfill(spark, more, place))) == 4
    assert backfills.backfilled_rows(spark, place, source.schema).count() == more.count()


def test_backfill_of_an_empty_source(spark, source):
    place = new_folder(spark, "test")
    backfills.plan_backfill(spark, source.limit(0), place, 10)
    assert list(backfills.resume_backfill(spark, source.limit(0), place)) == []
    assert backfills.backfilled_rows(spark, place, source.schema).count() == 0


def test_chunk_bounds_reach_the_scan(spark, source):
    chunk = backfills.chunks(source, 500).orderBy("chunk").collect()[2]
    plan = backfills._rows_of(source, False, chunk, 3600)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(namespace,n)" in plan and "Exchange" not in plan


def plain_allowed(planned):
    """The same rule run by run."""
    allowed, free = set(), {}
    for namespace, name, run, start, end in sorted(planned, key=lambda r: (r[3] is None, r[3] or DAY, r[2])):
        key = (namespace, name)
        if start is None or key in free and (free[key] is None or start < free[key]):
            continue
        allowed.add(run)
        free[key] = None if end is None else max(start, end)
    return allowed


PLANNED = "namespace string, name string, run_id long, starts_at timestamp_ntz, ends_at timestamp_ntz"


@pytest.mark.parametrize("slice_seconds", [3600, 10 * 86_400])
def test_runs_that_do_not_overlap(spark, slice_seconds):
    draw = random.Random(slice_seconds)
    planned = []
    for k in range(900):
        start = None if k % 97 == 0 else DAY + timedelta(hours=draw.randrange(900))
        end = None if k == 401 or start is None else start + timedelta(hours=draw.choice([-3, 0, 0, 1, 2, 5, 40]))
        # A third of the runs are of one stream; ids do not follow the starts.
        planned.append(("n", "hot" if k % 3 == 0 else f"s{k % 10}", (k * 7919) % 1000, start, end))
    found = runs_allowed(spark.createDataFrame(planned, PLANNED).repartition(3), slice_seconds)
    assert found.columns == ["namespace", "name", "run_id", "starts_at", "ends_at", "allowed"]
    assert {r["run_id"] for r in found.collect() if r["allowed"]} == plain_allowed(planned)
    assert found.count() == sum(r[3] is not None for r in planned)


def test_runs_at_one_time_and_without_end(spark):
    planned = [("n", "a", k, DAY, DAY) for k in (3, 1, 2)] + [("n", "a", 4, DAY, None), ("n", "a", 5, DAY, DAY), ("n", "b", 9, None, DAY)]
    found = runs_allowed(spark.createDataFrame(planned, PLANNED))
    assert rows(found, "run_id", "allowed") == [(1, True), (2, True), (3, True), (4, True), (5, False)]
    assert runs_allowed(spark.createDataFrame([], PLANNED)).count() == 0


def test_no_task_holds_all_runs_of_a_stream(spark):
    planned = spark.range(2_000).selectExpr(
        "'n' AS namespace", "'hot' AS name", "id AS run_id", "timestamp_ntz '2024-01-01' + make_dt_interval(0, cast(id AS int)) AS starts_at"
    ).withColumn("ends_at", F.col("starts_at") + F.expr("INTERVAL '90' MINUTE"))
    assert runs_allowed(planned).filter("allowed").count() == 1_000


def test_next_run_is_found_in_one_pass(spark):
    planned = spark.createDataFrame([("n", "a", k, DAY + timedelta(hours=k), DAY + timedelta(hours=k + 3)) for k in range(40)], PLANNED)
    found = next_allowed(planned)
    assert rows(found, "run_id", "next_id") == sorted(((k, k + 3 if k < 37 else None) for k in range(40)), key=lambda r: r[0])
    # A frame that ends with its partition is read anew from every row.
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_planted_gaps_are_found(spark, source):
    held = source.filter("event_id % 400 <> 7").withColumn("value", F.when(F.col("event_id") == 100, -1.0).otherwise(F.col("value")))
    target = held.repartition(7).select(*reversed(source.columns))
    found = gaps.gap_ranges(source, target)
    gone = source.filter("event_id % 400 = 7 OR event_id = 100")
    start = (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600) * 3600).alias("range_start")
    assert rows(found, "namespace", "name", "range_start") == rows(gone.select("namespace", "name", start).distinct(), "namespace", "name", "range_start")
    missing = gaps.missing_rows(source, target, found)
    assert {(r["event_id"], r["reason"]) for r in missing.collect()} == {(k, "missing") for k in range(7, 3_000, 400)} | {(100, "different")}


def test_equal_sides_and_repeats_and_rows_without_time(spark, source):
    assert gaps.gap_ranges(source, source.repartition(3)).count() == 0
    twice = source.unionByName(source.filter("event_id = 5000"))
    found = gaps.gap_ranges(source, twice).collect()
    assert [(r["name"], r["range_start"], r["source_rows"], r["target_rows"]) for r in found] == [("s00", -1 << 62, 1, 2)]
    lost = source.filter("event_id <> 5000")
    assert rows(gaps.missing_rows(source, lost, gaps.gap_ranges(source, lost)), "event_id", "reason") == [(5000, "missing")]
    assert gaps.gap_ranges(source, source.limit(0)).agg(F.sum("source_rows")).first()[0] == source.count()


def test_equal_ranges_are_not_compared_row_by_row(spark, source):
    target = source.filter("event_id <> 1204")
    ranges = gaps.gap_ranges(source, target)
    assert ranges.count() == 1
    inside = gaps.within_ranges(source, ranges, gaps.LEVELS[-1])
    row, = source.filter("event_id = 1204").collect()
    assert {r["name"] for r in inside.collect()} == {row["name"]} and inside.count() < 30
    # What is read again is pruned by the time that the ranges span.
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan or "cast(ts" in plan


def test_streams_that_finish_on_different_days(spark, source):
    timed = source.dropDuplicates(["event_id"])
    day = F.when(F.col("name") == "hot", 3).otherwise(9)
    end = F.lit(DAY).cast("timestamp_ntz") + F.make_dt_interval(day + 2)
    begin = F.lit(DAY).cast("timestamp_ntz") + F.make_dt_interval(day)
    finished = timed.select("namespace", "name", end.alias("finished_at")).distinct()
    stream, backfill = timed.filter(F.col("ts") >= begin), timed.filter(F.col("ts").isNull() | (F.col("ts") < end))
    found = handoff_by_stream(backfill, stream, finished)
    assert rows(found, "event_id") == rows(timed, "event_id")
    # One seam for all would either compare far more rows or let some pass twice.
    assert backfill.count() + stream.count() > timed.count()


def test_a_repeated_run_leaves_its_readers_alone(spark, source):
    place = new_folder(spark, "test")
    some = source.limit(3)
    scheduled_batch(spark, some, place, "01")
    reader = latest_run(spark, place, source.schema)
    scheduled_batch(spark, source.limit(5), place, "01")
    assert reader.count() == 3 and latest_run(spark, place, source.schema).count() == 5


def test_no_finished_run(spark, source):
    place = new_folder(spark, "test")
    broken = source.withColumn("value", F.raise_error(F.lit("stop")).cast("double"))
    with pytest.raises(Exception, match="stop"):
        scheduled_batch(spark, broken, place, "01")
    found = latest_run(spark, place, source.schema)
    assert found.count() == 0 and found.columns == [*source.columns, "run_id"]
