"""Stream classes: membership, secrets, metric tags, registry and heartbeats."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.neighbours import with_next, with_previous
from fleetwright.functions.text import snake_case
from fleetwright.operators.definitions import KEY
from fleetwright.vocabulary import TAG_PREFIX


def class_streams(classes: DataFrame, streams: DataFrame) -> DataFrame:
    """Streams of each class by API group, version and kind."""
    target = classes.select(
        F.col("stream_class").alias("class_name"),
        F.col("api_group_ref").alias("api_group"),
        "api_version",
        F.col("kind_ref").alias("kind"),
    )
    return streams.select(*KEY, "api_group", "api_version", "kind").join(
        target, ["api_group", "api_version", "kind"], "inner"
    )


def secret_ref_fields(classes: DataFrame, streams: DataFrame) -> DataFrame:
    """Secret names a run needs, one row per class field, in the class's order.

    ``streams`` carries ``stream_class`` and ``spec_json``. Names only, never values.
    """
    fields = classes.select(
        "stream_class", F.posexplode("secret_refs").alias("position", "field")
    )
    secret = F.expr("get_json_object(spec_json, concat('$.', field, '.name'))")
    return streams.select(*KEY, "stream_class", "spec_json").join(fields, "stream_class").select(
        *KEY, "position", "field", secret.alias("secret_name")
    )


def metric_tags(prefix: str = TAG_PREFIX) -> Column:
    """Tag map of a class; empty fields become ``unknown``, except the phase."""

    def known(value: Column) -> Column:
        return F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown"))

    return F.create_map(
        F.lit(f"{prefix}/namespace"), known(F.lower("namespace")),
        F.lit(f"{prefix}/kind_ref"), known(snake_case(F.col("kind_ref"))),
        F.lit(f"{prefix}/kind"), known(snake_case(F.col("kind"))),
        F.lit(f"{prefix}/phase"), F.lower("phase"),
    )


def class_metric_tags(classes: DataFrame, prefix: str = TAG_PREFIX) -> DataFrame:
    """One row per class and tag."""
    return classes.select("class_name", F.explode(metric_tags(prefix)).alias("tag", "value"))


def metric_export_rows(classes: DataFrame, prefix: str = TAG_PREFIX) -> DataFrame:
    """Count samples of 1 with their tags as sorted ``key:value`` texts."""
    pairs = F.transform(
        F.map_entries(metric_tags(prefix)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])
    )
    return classes.select(
        "class_name",
        F.lit("stream_class").alias("metric"),
        F.lit(1).alias("value"),
        F.sort_array(pairs).alias("tags"),
    )


def class_registry(feed: DataFrame) -> DataFrame:
    """Classes live at the end of an ADD / REMOVE feed; the last word per kind counts."""
    last = feed.groupBy("kind").agg(
        F.max_by(F.struct("verb", "phase", "seq"), F.struct("ts", "seq")).alias("last")
    )
    return last.filter("last.verb = 'ADD'").select(
        "kind", F.col("last.phase").alias("phase"), F.col("last.seq").alias("seq")
    )


def feed_range(feed: DataFrame) -> tuple[str, str]:
    """First and last full second of a feed: two values, whatever its size."""
    ends = feed.agg(F.min("ts"), F.max("ts"))
    ends = ends.select(*(F.date_format(F.date_trunc("second", c), "yyyy-MM-dd HH:mm:ss") for c in ends.columns))
    return tuple(ends.first())


class Ticks(NamedTuple):
    """Report ticks in (start, until]: start + delay + n * interval, n >= 1."""

    start: str
    until: str
    interval_seconds: int = 30
    delay_seconds: int = 5

    def since(self, moment: Column, kind: str) -> Column:
        """Seconds from the zeroth tick, as ``long`` or ``double``."""
        origin = F.lit(self.start).cast("timestamp").cast("long") + self.delay_seconds
        return moment.cast("timestamp").cast(kind) - origin

    def last(self) -> Column:
        return F.floor(self.since(F.lit(self.until), "long") / self.interval_seconds)

    def at(self, tick: Column) -> Column:
        origin = F.lit(self.start).cast("timestamp").cast("long") + self.delay_seconds
        return F.timestamp_seconds(origin + tick * self.interval_seconds).cast("timestamp_ntz")


def heartbeat_intervals(feed: DataFrame, ticks: Ticks, slice_ticks: int = 2880) -> DataFrame:
    """(kind, first_tick, last_tick): the stretches of ticks at which a class is live.

    Only the last word per class before each tick matters, so the feed is first reduced (map-side) to that, then
    to the words that change something. Both looks at a neighbouring word are cut into slices of ticks, so a class
    with many words is no single task. Classes without a name are one class; no words give no intervals.
    """
    tick = F.greatest(F.ceil(ticks.since(F.col("ts"), "double") / ticks.interval_seconds), F.lit(1))
    words = (
        feed.select("kind", tick.alias("tick"), (F.col("verb") == "ADD").alias("live"), "ts", "seq")
        .groupBy("kind", "tick")
        .agg(F.max_by("live", F.struct("ts", "seq")).alias("live"))
        .filter(F.col("tick") <= ticks.last())
    )
    of_ticks = F.floor(F.col("tick") / slice_ticks)
    before = with_previous(words, ["kind"], ["tick"], of_ticks, ["live"])
    turns = before.filter(F.col("live") != F.coalesce("previous.live", F.lit(False))).select("kind", "tick", "live")
    spans = with_next(turns, ["kind"], ["tick"], of_ticks, ["tick"]).filter("live")
    return spans.select(
        "kind", F.col("tick").alias("first_tick"), F.coalesce(F.col("next.tick") - 1, ticks.last()).alias("last_tick")
    )


def heartbeats_between(intervals: DataFrame, ticks: Ticks, first: Column, last: Column, block_ticks: int = 1024) -> DataFrame:
    """One count of 1 per live class and tick in [first, last].

    Intervals are cut into blocks, and these dealt out, before they become rows: a class that is live for long is
    no single task.
    """
    low, high = F.greatest("first_tick", first), F.least("last_tick", last)
    inside = intervals.select("kind", low.alias("low"), high.alias("high")).filter("low <= high")
    blocks = inside.select(
        "*", F.explode(F.sequence(F.floor(F.col("low") / block_ticks), F.floor(F.col("high") / block_ticks))).alias("block")
    ).repartition("kind", "block", "low")
    ends = F.greatest("low", F.col("block") * block_ticks), F.least("high", (F.col("block") + 1) * block_ticks - 1)
    return blocks.select("kind", F.explode(F.sequence(*ends)).alias("tick")).select(
        "kind", ticks.at(F.col("tick")).alias("reported_at"), F.lit(1).alias("value")
    )


def heartbeats_at(intervals: DataFrame, ticks: Ticks, asked: DataFrame, block_ticks: int = 128) -> DataFrame:
    """``asked`` (kind, ts, others) with ``reported_at``: the tick at or before ``ts`` if its class is live there, else null.

    Both sides are joined by class and block of ticks. A block holds at most half as many intervals as ticks, so a
    class that comes and goes, or is asked for often, makes no pairs beyond that.
    """
    tick = F.floor(ticks.since(F.col("ts"), "double") / ticks.interval_seconds)
    points = asked.withColumn("_tick", tick).withColumn("_block", F.floor(F.col("_tick") / block_ticks))
    pieces = intervals.select(
        F.col("kind").alias("_kind"),
        F.explode(F.sequence(F.floor(F.col("first_tick") / block_ticks), F.floor(F.col("last_tick") / block_ticks))).alias("_of"),
        F.col("first_tick").alias("_first"),
        F.col("last_tick").alias("_last"),
    )
    same = points["kind"].eqNullSafe(pieces["_kind"]) & (points["_block"] == pieces["_of"])
    held = points.join(pieces, same & F.col("_tick").between(F.col("_first"), F.col("_last")), "left")
    reported = F.when(F.col("_first").isNotNull(), ticks.at(F.col("_tick")))
    return held.select(*(F.col(f"`{c}`") for c in asked.columns), reported.alias("reported_at"))


def heartbeat_counts(
    feed: DataFrame, start: str | None = None, until: str | None = None, interval_seconds: int = 30, delay_seconds: int = 5
) -> DataFrame:
    """One count of 1 per live class and report tick in (start, until], by default the feed's own range."""
    if start is None or until is None:
        first, last = feed_range(feed)
        start, until = start or first, until or last
    ticks = Ticks(start, until, interval_seconds, delay_seconds)
    return heartbeats_between(heartbeat_intervals(feed, ticks), ticks, F.lit(1), ticks.last())


def heartbeat_windows(
    events: DataFrame, interval: str = "30 seconds", delay: str = "5 seconds"
) -> DataFrame:
    """Feed rows per class and tumbling report interval; the same for batch and streaming."""
    report = F.window("ts", interval, interval, delay)
    return (
        events.groupBy(report.alias("w"), "kind")
        .agg(F.count(F.lit(1)).alias("beats"))
        .select("kind", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "beats")
    )
