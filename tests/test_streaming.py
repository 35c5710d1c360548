"""Streaming jobs: many batches, disorder, repeats, restarts."""

import random

import pytest
from pyspark.sql import functions as F

from fleetwright.operators.feeds import coalesced_keys, merged_feed
from fleetwright.operators.definitions import KEY
from fleetwright.operators.loads import (
    backfill_load,
    backfill_rows,
    gap_fill,
    handoff_rows,
    latest_run,
    live_rows,
    scheduled_batch,
)
from fleetwright.operators.status import latest_state, phase_transitions, with_status
from fleetwright.session import new_folder
from fleetwright.sources.files import source_stream, source_table
from fleetwright.sources.sample_fleet import fleet_table
from fleetwright.streaming import jobs
from fleetwright.streaming.changes import newest_rows, run_available, stored_rows

SCHEMA = "namespace string, name string, ts timestamp_ntz, seq long, phase string"


@pytest.fixture(scope="module")
def feed(spark, folder):
    return fleet_table(spark, folder, "phase_event").select(*KEY, "ts", "seq", "phase").cache()


def kept(spark, frames, sink=jobs.status_sink):
    """Newest rows, the place and the schema after each frame has been landed and taken over by a new start."""
    place, schema = new_folder(spark, "test"), frames[0].schema
    for frame in frames:
        frame.write.mode("append").parquet(f"{place}/feed")
        stream = source_stream(spark, "parquet", f"{place}/feed", schema)
        sink(stream, f"{place}/checkpoint", f"{place}/target")
    return newest_rows(spark, f"{place}/target", schema, KEY), place, schema


def parts(feed, count):
    """The feed cut into ``count`` pieces by time."""
    low, high = feed.agg(F.min("seq"), F.max("seq")).first()
    width = (high - low) // count + 1
    return [feed.filter((F.col("seq") >= low + i * width) & (F.col("seq") < low + (i + 1) * width)) for i in range(count)]


def rows(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()))


LOG = ("namespace", "name", "ts", "seq", "from_phase", "to_phase")


def tracked(spark, frames, slice_seconds=3600, repeat=()):
    """The log after each frame as a batch; those numbered in ``repeat`` twice."""
    place = new_folder(spark, "test")
    step = jobs.track_phases(spark, place, slice_seconds)
    for batch_id, frame in enumerate(frames):
        for _ in range(1 + (batch_id in repeat)):
            step(frame, batch_id)
    return jobs.phase_log(spark, place), place


def test_tracker_over_many_batches_equals_batch(spark, feed):
    log, place = tracked(spark, parts(feed, 3), repeat=(1,))
    assert rows(log, *LOG) == rows(phase_transitions(feed), *LOG)
    assert spark.read.schema(jobs.PHASE_LOG).parquet(f"{place}/log").filter("sign < 0").count() == 0


@pytest.mark.parametrize("seed, slice_seconds", [(1, 3600), (2, 10 * 86_400)])
def test_late_rows_correct_the_log(spark, feed, seed, slice_seconds):
    """Any order of arrival; the third batch also brings rows again that are known already."""
    draw = random.Random(seed)
    cut = F.pmod(F.hash("seq", F.lit(seed)), F.lit(4))
    order = draw.sample(range(4), 4)
    frames = [feed.filter(cut == k) for k in order]
    frames[2] = frames[2].unionByName(frames[0])
    log, place = tracked(spark, frames, slice_seconds, repeat=(2,))
    assert rows(log, *LOG) == rows(phase_transitions(feed), *LOG)
    # Something had to be taken back.
    assert spark.read.schema(jobs.PHASE_LOG).parquet(f"{place}/log").filter("sign < 0").count() > 0


def test_a_late_row_between_two_of_one_phase(spark):
    frames = [status(spark, (1, "Running"), (9, "Running")), status(spark, (5, "Failed")), status(spark, (5, "Failed"), (7, "Failed"))]
    log, place = tracked(spark, frames)
    assert rows(log, "seq", "from_phase", "to_phase") == [(1, "", "Running"), (5, "Running", "Failed"), (9, "Failed", "Running")]
    written = spark.read.schema(jobs.PHASE_LOG).parquet(f"{place}/log")
    assert rows(written, "batch_id", "seq", "from_phase", "sign") == [(0, 1, "", 1), (1, 5, "Running", 1), (1, 9, "Failed", 1)]


def test_a_late_first_row_takes_back_the_first_transition(spark):
    log, place = tracked(spark, [status(spark, (5, "Failed")), status(spark, (1, "Failed"))])
    assert rows(log, "seq", "from_phase", "to_phase") == [(1, "", "Failed")]
    written = spark.read.schema(jobs.PHASE_LOG).parquet(f"{place}/log").filter("batch_id = 1")
    assert rows(written, "seq", "from_phase", "sign") == [(1, "", 1), (5, "", -1)]


def test_status_sink_raises_events_for_changes_only(spark):
    def batch(*items):
        return spark.sql(
            "SELECT 'n' AS namespace, name, CAST(ts AS TIMESTAMP_NTZ) AS ts, CAST(seq AS BIGINT) AS seq, phase FROM VALUES "
            + ", ".join(f"('{n}', '2024-01-0{d}', {d}, '{p}')" for n, d, p in items) + " AS t(name, ts, seq, phase)"
        )

    first = batch(("a", 1, "Running"), ("a", 2, "Failed"), ("b", 1, "Running"))
    newest, place, schema = kept(spark, [first, batch(("a", 3, "Failed"), ("b", 3, "Suspended"), ("c", 3, "Pending"))])
    events = jobs.status_events(spark, f"{place}/target", schema)
    assert rows(events, "batch_id", "name", "phase") == [(0, "a", "Failed"), (0, "b", "Running"), (1, "b", "Suspended"), (1, "c", "Pending")]
    assert rows(newest, "name", "phase") == [("a", "Failed"), ("b", "Suspended"), ("c", "Pending")]


def status(spark, *items):
    return spark.sql(
        "SELECT 'n' AS namespace, 'a' AS name, CAST(ts AS TIMESTAMP_NTZ) AS ts, CAST(seq AS BIGINT) AS seq, phase FROM VALUES "
        + ", ".join(f"('2024-01-{d:02d}', {d}, '{p}')" for d, p in items) + " AS t(ts, seq, phase)"
    )


def test_unchanged_status_still_moves_on(spark):
    """Running on day 1 and 10; a failure of day 5 that comes afterwards is old news."""
    frames = [status(spark, (day, phase)) for day, phase in [(1, "Running"), (10, "Running"), (5, "Failed")]]
    newest, place, schema = kept(spark, frames)
    assert rows(newest, "seq", "phase") == [(10, "Running")]
    assert rows(jobs.status_events(spark, f"{place}/target", schema), "batch_id", "phase") == [(0, "Running")]


def test_all_columns_of_a_status_are_written_together(spark):
    frames = [
        status(spark, (d, p)).selectExpr("*", f"'{spec}' AS spec_json", f"CAST({name} AS STRING) AS request_name", "'k' AS request_class")
        for d, p, spec, name in [(2, "Backfilling", "{}", "'bf-1'"), (1, "Failed", "{1}", "NULL"), (3, "Running", "{2}", "NULL")]
    ]
    written = lambda s, c, t: jobs.status_sink(with_status(s), c, t)
    for n, wanted in ((2, ("Ready", "StreamBackfilling")), (3, ("Ready", "StreamRunning"))):
        _, place, _ = kept(spark, frames[:n], written)
        schema = with_status(frames[0]).schema
        found = newest_rows(spark, f"{place}/target", schema, KEY).collect()
        assert [(r["type"], r["reason"]) for r in found] == [wanted]
        expected = with_status(frames[0 if n == 2 else 2]).collect()
        assert found == expected and (n == 3 or "bf-1" in found[0]["message"])


def test_null_delete_mark_is_no_delete(spark):
    _, place, schema = kept(spark, [status(spark, (1, "Running"))])
    assert jobs.live(spark, f"{place}/target", schema, F.lit(None).cast("boolean")).count() == 1
    assert live_rows(status(spark, (1, "x")).withColumnRenamed("seq", "event_id"), KEY, F.lit(None).cast("boolean")).count() == 1


def test_newest_rows_in_any_order_of_arrival(spark, feed):
    pieces = parts(feed, 4)
    random.Random(3).shuffle(pieces)
    newest, place, schema = kept(spark, pieces)
    assert rows(newest, *KEY, "seq", "phase") == rows(latest_state(feed), *KEY, "seq", "phase")
    # A batch stores its own keys only, one row each.
    for batch_id, piece in enumerate(pieces):
        stored = stored_rows(spark, f"{place}/target", schema).filter(F.col("batch_id") == batch_id)
        assert rows(stored, *KEY) == rows(piece.select(*KEY).distinct(), *KEY)


def test_a_hot_key_is_combined_before_the_shuffle(spark):
    """All rows of one key: each task sends one row on, so the state's task reads as many rows as there were tasks."""
    hot = spark.range(0, 20_000, 1, 8).selectExpr(
        "'n' AS namespace", "'hot' AS name", "timestamp_seconds(id) AS ts", "id AS event_id", "'x' AS event_type"
    )
    newest, _, _ = kept(spark, [hot], jobs.change_capture)
    assert rows(newest, "event_id") == [(19_999,)]


def test_streams_defined_while_the_query_runs(spark):
    place = new_folder(spark, "test")
    events = spark.createDataFrame(
        [(k, "Job", "ADDED", "n", f"s{k % 2}", True, False, False, "c") for k in range(4)],
        "seq long, kind string, verb string, namespace string, owner_name string, controller boolean, completed boolean, "
        "failed boolean, stream_class string",
    )
    streams = spark.createDataFrame([("n", "s0", "Running")], "namespace string, name string, phase string")
    streams.write.parquet(f"{place}/streams")
    classes = spark.createDataFrame([("c",)], "stream_class string")
    step = jobs.route_events(lambda: spark.read.schema(streams.schema).parquet(f"{place}/streams"), lambda: classes, f"{place}/out")
    for half in (events.filter("seq < 2"), events.filter("seq >= 2")):
        half.write.mode("append").parquet(f"{place}/feed")
        run_available(source_stream(spark, "parquet", f"{place}/feed", events.schema), f"{place}/checkpoint", step)
        streams.withColumn("name", F.lit("s1")).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{place}/added")
        spark.read.schema(streams.schema).parquet(f"{place}/added").write.mode("append").parquet(f"{place}/streams")
    assert rows(spark.read.parquet(f"{place}/out"), "seq", "name") == [(0, "s0"), (2, "s0"), (3, "s1")]


def test_restart_keeps_or_leaves_the_checkpoint(spark, feed):
    place = new_folder(spark, "test")
    feed.write.parquet(f"{place}/feed")
    seen = []

    def run(checksum):
        stream = source_stream(spark, "parquet", f"{place}/feed", feed.schema)
        count = lambda batch, i: seen.append((checksum, batch.count()))
        return jobs.restart_on_change(f"{place}/runs", checksum, lambda checkpoint, target: run_available(stream, checkpoint, count))

    total = feed.count()
    assert run("one") == run("one") != run("two")
    assert seen == [("one", total), ("two", total)]


@pytest.mark.parametrize("file_format", ["parquet", "json"])
def test_sources_as_table_and_stream(spark, feed, file_format):
    place = new_folder(spark, "test")
    feed.write.format(file_format).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").save(f"{place}/in")
    assert rows(source_table(spark, file_format, f"{place}/in", feed.schema), *feed.columns) == rows(feed, *feed.columns)
    stream = source_stream(spark, file_format, f"{place}/in", feed.schema, 1_000_000)
    jobs.append_available(stream, f"{place}/checkpoint", f"{place}/out")
    assert rows(spark.read.parquet(f"{place}/out"), *feed.columns) == rows(feed, *feed.columns)


def test_unknown_source_format(spark):
    with pytest.raises(ValueError):
        source_table(spark, "csv", "/nowhere", "a int")


def test_merged_feed_keeps_duplicates_and_kinds(spark):
    a, b = spark.range(2).withColumn("x", F.lit(1)), spark.range(2)
    merged = merged_feed({"A": a, "B": b})
    assert set(map(tuple, merged.select("kind", "id", "x").collect())) == {
        ("A", 0, 1), ("A", 1, 1), ("B", 0, None), ("B", 1, None)
    }
    assert merged_feed({"A": a, "B": a}).count() == 4


def test_coalesced_keys(spark):
    events = spark.createDataFrame([("n", "a", 1), ("n", "a", 2), ("n", "b", 3)], "namespace string, name string, seq long")
    assert rows(coalesced_keys(events), "name") == [("a",), ("b",)]


def source(spark, *days):
    return spark.sql(
        "SELECT 'n' AS namespace, 's' AS name, CAST(id AS BIGINT) AS event_id, CAST(concat('2024-01-', lpad(id, 2, '0')) AS TIMESTAMP_NTZ) AS ts "
        f"FROM VALUES {', '.join(f'({d})' for d in days)} AS t(id)"
    )


def test_handoff_has_no_loss_and_no_duplicate(spark):
    backfill, stream = source(spark, *range(1, 15)), source(spark, *range(10, 20))
    seam = [F.lit(d).cast("timestamp_ntz") for d in ("2024-01-10", "2024-01-15")]
    assert rows(handoff_rows(backfill, stream, *seam), "event_id") == [(d,) for d in range(1, 20)]


def test_gap_fill(spark):
    full, target = source(spark, *range(1, 20)), source(spark, 1, 2, 5, 9, 18)
    assert rows(gap_fill(full, target), "event_id") == [(d,) for d in range(1, 20) if d not in (1, 2, 5, 9, 18)]
    assert rows(gap_fill(full, target, "2024-01-03", "2024-01-07"), "event_id") == [(3,), (4,), (6,)]


def test_latest_scheduled_run_wins(spark):
    place = new_folder(spark, "test")
    target, schema = f"{place}/target", source(spark, 1).schema
    scheduled_batch(spark, source(spark, 1, 2), target, "01")
    scheduled_batch(spark, source(spark, 2, 3), target, "02")
    scheduled_batch(spark, source(spark, 2, 3, 4), target, "02")
    assert rows(latest_run(spark, target, schema), "event_id", "run_id") == [(2, "02"), (3, "02"), (4, "02")]
    assert all("run_id=02" in f for f in latest_run(spark, target, schema).inputFiles())
    scheduled_batch(spark, source(spark, 1).filter("false"), target, "03")
    assert latest_run(spark, target, schema).count() == 0
    # Rows without a mark are of a run that did not finish.
    source(spark, 9).write.parquet(f"{target}/rows/run_id=04")
    assert latest_run(spark, target, schema).count() == 0


def test_request_opened_during_a_load_stays_open(spark):
    place = new_folder(spark, "test")
    asked = f"{place}/asked"
    spark.createDataFrame([("n", "s", "bf-1")], "namespace string, name string, request_name string").write.parquet(asked)
    spark.read.parquet(asked).createOrReplaceTempView("asked_now")
    loaded, completed = backfill_load(spark, source(spark, 1, 2), spark.read.parquet(asked), f"{place}/load", "1")
    spark.createDataFrame([("n", "t", "bf-2")], "namespace string, name string, request_name string").write.mode("append").parquet(asked)
    spark.catalog.refreshByPath(asked)
    assert rows(completed, "request_name") == [("bf-1",)] and loaded.count() == 2


def test_backfill_keeps_namespaces_apart(spark):
    other = source(spark, 3).withColumn("namespace", F.lit("m"))
    asked = spark.createDataFrame([("n", "s", "bf-n"), ("m", "s", "bf-m")], "namespace string, name string, request_name string")
    found = backfill_rows(source(spark, 1, 2).unionByName(other), asked)
    assert rows(found, "event_id", "backfill_id") == [(1, "bf-n"), (2, "bf-n"), (3, "bf-m")]
