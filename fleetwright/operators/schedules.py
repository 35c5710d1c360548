"""Which planned runs start where a stream's runs must not overlap.

Of a stream's planned runs in order of (starts_at, run_id), the first one starts; after it the first one that
starts no earlier than it ends, and so on. Row by row this is one long chain per stream. Here each run
gets a pointer to the run that would start next after it, by a search that is cut into time slices, and
the chains are followed by doubling: after k rounds all runs within 2^k steps of a chain's start are
marked. Pointers are joined by run, so a stream that holds most runs is no hot key, and the number
of rounds grows with the logarithm of the longest chain. A run that is not marked and that no pointer leads to
is on no chain; each round drops the pointers of such runs, so that later rounds shrink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetwright.functions.latest import first_per_key
from fleetwright.functions.neighbours import time_slice
from fleetwright.operators.definitions import KEY
from fleetwright.session import written


def next_allowed(planned: DataFrame, slice_seconds: int = 86_400) -> DataFrame:
    """(run_id, next_id): the first run of the stream that starts once a run has ended, or null.

    ``run_id`` is unique; a null ``ends_at`` is a run that never ends, an end before the start counts as
    the start.
    """
    ended = F.when(F.col("ends_at").isNotNull(), F.greatest("starts_at", "ends_at"))
    runs = planned.select(*KEY, "run_id", "starts_at", ended.alias("ends_at"))
    # In one order by place: a start, and what asks for the first start behind a place. A run that takes no
    # time asks behind itself, others ask before all that start at their end.
    began = F.struct(F.col("starts_at").alias("at"), F.lit(1).alias("kind"), "run_id").alias("place")
    starts = runs.select(*KEY, began, F.lit(None).cast("long").alias("asks"))
    at_once = F.col("ends_at") == F.col("starts_at")
    asked = F.struct(
        F.col("ends_at").alias("at"), F.when(at_once, 1).otherwise(0).alias("kind"), F.when(at_once, F.col("run_id")).alias("run_id")
    )
    asking = runs.filter("ends_at IS NOT NULL").select(*KEY, asked.alias("place"), F.col("run_id").alias("asks"))
    both = starts.unionByName(asking).withColumn("slice", time_slice("place.at", slice_seconds))
    start_here = F.when(F.col("asks").isNull(), F.col("place.run_id"))
    # Read backwards, so that one pass carries the start that was seen last; a frame that ends with the slice would
    # be read anew from every row. At one place the start comes first, so that a run does not find itself.
    order = W.partitionBy(*KEY, "slice").orderBy(F.desc("place"), F.col("asks").desc_nulls_last())
    found = F.last(start_here, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    within = both.select(*KEY, "slice", "asks", found.alias("next_id")).filter("asks IS NOT NULL")
    firsts = both.groupBy(*KEY, "slice").agg(F.min(F.when(F.col("asks").isNull(), F.col("place"))).alias("first"))
    later = W.partitionBy(*KEY).orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, -1)
    later = firsts.select(*KEY, "slice", F.last("first.run_id", ignorenulls=True).over(later).alias("later_id"))
    # Only what finds no start in its own slice looks at the later slices.
    inside = within.filter("next_id IS NOT NULL").select("asks", "next_id")
    beyond = within.filter("next_id IS NULL").join(later, [*KEY, "slice"]).select("asks", F.col("later_id").alias("next_id"))
    return inside.unionByName(beyond).withColumnRenamed("asks", "run_id")


def runs_allowed(planned: DataFrame, slice_seconds: int = 86_400) -> DataFrame:
    """``planned`` (namespace, name, run_id, starts_at, ends_at, others) with ``allowed``; runs without a start are not planned."""
    runs = planned.filter("starts_at IS NOT NULL")
    pointers = written(next_allowed(runs, slice_seconds).filter("next_id IS NOT NULL"), "run-pointers")
    marked = written(first_per_key(runs.select(*KEY, "starts_at", "run_id"), KEY, ["starts_at", "run_id"]).select("run_id"), "runs-marked")
    while not pointers.isEmpty():
        ahead = pointers.select(F.col("next_id").alias("run_id"))
        pointers = pointers.join(ahead.unionByName(marked).distinct(), "run_id", "left_semi")
        reached = marked.join(pointers, "run_id").select(F.col("next_id").alias("run_id"))
        marked = written(marked.unionByName(reached).distinct(), "runs-marked")
        onward = pointers.select(F.col("run_id").alias("next_id"), F.col("next_id").alias("_onward"))
        pointers = written(pointers.join(onward, "next_id").select("run_id", F.col("_onward").alias("next_id")), "run-pointers")
    return runs.join(marked.withColumn("_marked", F.lit(True)), "run_id", "left").select(
        *planned.columns, _known("_marked").alias("allowed")
    )


def _known(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))
