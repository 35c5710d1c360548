"""One life-cycle decision per stream class.

Whether a class's controller runs, fails to start or has exited is input: columns
``deleted``, ``controller_running``, ``start_fails`` and ``controller_exited``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwright.vocabulary import FAILED, NEW, PENDING, READY

# Event type, reason and message per step.
EVENTS = {
    "created": ("Normal", "StreamClassCreated", "New StreamClass has been created and is pending processing"),
    "ready": ("Normal", "StreamClassReady", "StreamClass is ready and stream controller has been started"),
    "recovered": (
        "Warning", "StreamClassRecovered", "StreamClass was found in Failed state and recovery was attempted"
    ),
    "reconciled": ("Normal", "StreamClassReconciled", "StreamClass is reconciled and stream controller is running"),
    "exited": (
        "Warning", "StreamControllerError",
        "Stream controller exited with error, StreamClass moved to Failed state",
    ),
}
# The error text, around the class and its phase.
STEP_FAILED = ("failed to reconcile StreamClass FSM for ", ". Current state: ")
STEP_OF_PHASE = {NEW: "created", PENDING: "ready", FAILED: "recovered", READY: "reconciled"}


def _lookup(key: str, values: dict[str, str]) -> Column:
    chain = None
    for name, value in values.items():
        hit = F.col(key) == name
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def class_lifecycle_plan(classes: DataFrame) -> DataFrame:
    """Next phase, event and registry change of every class.

    An event is shown only when the phase changes. A controller that fails to start moves
    the class to Failed, yet with the event of the step that was tried. An exited controller
    stays registered, so the next step finds it running.
    """
    live = ~F.col("deleted")
    exited = live & F.col("controller_exited")
    starts = live & ~exited & F.col("phase").isin(PENDING, FAILED, READY)
    fresh = starts & ~F.col("controller_running")
    step = (
        F.when(F.col("deleted"), "deleted")
        .when(exited, "exited")
        .otherwise(F.coalesce(_lookup("phase", STEP_OF_PHASE), F.lit("error")))
    )
    next_phase = (
        F.when(F.col("step") == "exited", FAILED)
        .when(F.col("step") == "created", PENDING)
        .when(fresh & F.col("start_fails"), FAILED)
        .when(starts, READY)
        .otherwise(F.col("phase"))
    )
    controller = (
        F.when(F.col("deleted") & F.col("controller_running"), "stop")
        .when(fresh & ~F.col("start_fails"), "start")
        .otherwise("keep")
    )
    registry = F.when(F.col("controller") == "stop", "REMOVE").when(F.col("controller") == "start", "ADD")
    changes = F.col("next_phase") != F.col("phase")
    event = {
        field: F.when(changes, _lookup("step", {s: e[i] for s, e in EVENTS.items()}))
        for i, field in enumerate(("event_type", "event_reason", "event_message"))
    }
    error = F.when(
        F.col("step") == "error",
        F.concat(F.lit(STEP_FAILED[0]), F.col("class_name"), F.lit(STEP_FAILED[1]), F.col("phase")),
    )
    return (
        classes.withColumn("step", step)
        .withColumn("next_phase", next_phase)
        .withColumn("controller", controller)
        .withColumns({"registry": registry, "error": error} | event)
        .select("class_name", "phase", "step", "next_phase", "controller", "registry",
                "event_type", "event_reason", "event_message", "error")
    )
