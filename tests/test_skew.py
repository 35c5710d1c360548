"""One stream with most rows: joins are split, loads are spread, results stay whole."""

import glob

import pytest
from pyspark.sql import functions as F

from fleetwright.operators.feeds import event_to_owner
from fleetwright.operators.loads import backfill_load, backfill_rows
from fleetwright.session import new_folder

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}
ROWS = 60_000


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def source(spark):
    """Two thirds of the rows belong to one stream."""
    hot = F.when(F.col("id") % 3 != 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 50).cast("string")))
    return spark.range(0, ROWS, 1, 8).select(
        F.lit("ns").alias("namespace"), hot.alias("name"), F.col("id").alias("event_id")
    )


@pytest.fixture
def asked(spark):
    names = spark.range(50).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("name"))
    return names.union(spark.range(1).select(F.lit("hot"))).select(
        F.lit("ns").alias("namespace"), "name", F.concat(F.lit("bf-"), F.col("name")).alias("request_name")
    )


def final_plan(frame):
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_hot_join_is_split(small_partitions, source, asked):
    rows = backfill_rows(source, asked)
    assert "skew=true" in final_plan(rows)
    assert rows.count() == ROWS
    assert rows.filter("backfill_id = 'bf-hot'").count() == ROWS * 2 // 3


def test_hot_owner_is_split(spark, small_partitions, source, asked):
    events = source.select(
        "event_id", "namespace",
        F.array(
            F.struct(F.lit("g/v1").alias("api_version"), F.lit("K").alias("kind"), "name", F.lit(True).alias("controller"))
        ).alias("owner_references"),
    )
    streams = asked.select(
        "namespace", "name", F.lit("g").alias("api_group"), F.lit("K").alias("kind"), F.lit("c").alias("stream_class")
    )
    routed = event_to_owner(events, streams)
    assert "skew=true" in final_plan(routed)
    assert routed.count() == ROWS


def test_hot_backfill_is_written_by_many_tasks(spark, small_partitions, source, asked):
    target = new_folder(spark, "skew")
    loaded, _ = backfill_load(spark, source, asked, target, "1")
    assert loaded.count() == ROWS
    files = loaded.filter("backfill_id = 'bf-hot'").select(F.input_file_name()).distinct().count()
    assert files > 1
    assert len(glob.glob(f"{target}/rows/load_id=1/*.parquet")) < 60


def test_repeated_load_gives_the_same_rows(spark, source, asked):
    target = new_folder(spark, "repeat")
    for _ in range(2):
        loaded, completed = backfill_load(spark, source, asked, target, "1")
    assert loaded.count() == ROWS and loaded.select("event_id").distinct().count() == ROWS
    assert completed.count() == 51
