"""Status of streams: conditions, transitions, dwell times, latest state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.latest import latest_per_key
from fleetwright.functions.neighbours import time_slice, with_next, with_previous
from fleetwright.functions.text import configuration_checksum, request_json
from fleetwright.operators.definitions import KEY
from fleetwright.vocabulary import BACKFILLING, CONDITIONS, NEW


def condition() -> Column:
    """The condition a row's phase stands for, null for new streams."""
    chain = F.lit(None)
    for phase, (kind, reason, message) in CONDITIONS.items():
        text = F.lit(message)
        if phase == BACKFILLING:
            text = F.concat(text, F.coalesce("request_name", F.lit("")))
        of_phase = F.struct(
            F.lit(kind).alias("type"),
            F.lit("True").alias("status"),
            F.lit(reason).alias("reason"),
            text.alias("message"),
        )
        chain = F.when(F.col("phase") == phase, of_phase).otherwise(chain)
    return chain


def status_conditions(streams: DataFrame) -> DataFrame:
    """The condition each phase stands for; new streams have none.

    ``streams`` carries ``request_name``, which a backfilling stream's message ends with.
    """
    return (
        streams.filter(F.col("phase").isin(*CONDITIONS))
        .withColumn("_c", condition())
        .select(*KEY, "phase", "_c.*")
    )


def with_status(rows: DataFrame) -> DataFrame:
    """``rows`` with the checksum of configuration and open request, and the condition of their phase.

    They need ``name``, ``phase``, ``spec_json``, ``request_name`` and ``request_class``.
    """
    request = F.when(
        F.col("request_name").isNotNull(), request_json(F.col("request_class"), F.col("name"), F.lit(False))
    )
    found = condition()
    return rows.withColumn("configuration_hash", configuration_checksum(F.col("spec_json"), request)).withColumns(
        {field: found[field] for field in ("type", "reason", "message")}
    )


def status_rows(streams: DataFrame, transitions: DataFrame) -> DataFrame:
    """What is written as a stream's status: phase, checksum of configuration and open request, and condition.

    The condition holds since the newest of the key's ``transitions``, if it led to this phase.
    """
    newest = latest_per_key(transitions.select(*KEY, "ts", "seq", "to_phase"), KEY, ["ts", "seq"])
    since = newest.select(*KEY, F.col("to_phase").alias("phase"), F.col("ts").alias("condition_since"))
    return with_status(streams).join(since, [*KEY, "phase"], "left").select(
        *KEY, "phase", "configuration_hash", "type", "reason", "message", "condition_since"
    )


def phase_transitions(
    events: DataFrame, keys: Sequence[str] = tuple(KEY), slice_seconds: int = 3600, start: str | None = None
) -> DataFrame:
    """Changes of phase per key; repeats of the same phase are suppressed.

    The phase before a key's first event is column ``start``, or New.
    """
    keys = list(keys)
    before = F.coalesce("previous.phase", F.lit(NEW) if start is None else F.col(start))
    return (
        with_previous(events, keys, ["ts", "seq"], time_slice("ts", slice_seconds), ["phase"])
        .withColumn("from_phase", before)
        .filter("from_phase <> phase")
        .select(*keys, "ts", "seq", "from_phase", F.col("phase").alias("to_phase"))
    )


def time_in_phase(
    events: DataFrame, keys: Sequence[str] = tuple(KEY), slice_seconds: int = 3600
) -> DataFrame:
    """Milliseconds from each change of phase to the next; null while a phase lasts."""
    keys = list(keys)
    changes = phase_transitions(events, keys, slice_seconds)
    following = with_next(changes, keys, ["ts", "seq"], time_slice("ts", slice_seconds), ["ts"])
    dwell = F.expr("timestampdiff(MILLISECOND, ts, next.ts)")
    return following.select(
        *keys, "ts", "seq", F.col("to_phase").alias("phase"), dwell.alias("dwell_ms")
    )


def latest_state(events: DataFrame, keys: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Newest phase per key."""
    return latest_per_key(events.select(*keys, "ts", "seq", "phase"), list(keys), ["ts", "seq"])

