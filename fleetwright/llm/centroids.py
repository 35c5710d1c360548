"""Centroids by Lloyd's rounds in column expressions, with integer vectors and exact sums.

A component x counts as floor(64 x). The first centroids are the vectors whose ``seed:id`` has the
smallest SHA-256. The centroids stand in the plan as literal arrays: ``zip_with`` and ``aggregate``
give a vector's distance to each, ``array_min`` of (distance, number) chooses. A round is one pass:
sums of each component by cluster combine before the shuffle, so a cluster or a repeated vector that
holds most rows sends one row per task, and what reaches the driver is one row per cluster. The
integer vectors are written once and read by each round.

Cases: a null or other vector than one of ``size`` finite components is left out; components beyond
2^27 in size count as 2^27, since a squared distance has to fit a long; with fewer vectors than
``k`` each is a centroid, without any there are no rows; vectors with a null id are clustered but are
first centroids only after all others, repeated rows count as often as they stand there, rows that
share an id are told apart by their components; ties go to the smaller number; an empty cluster
keeps its centroid; a sum of distances that does not fit a long is null; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwright.llm.shared import settled

SIZE = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
LARGEST = float(1 << 27)

Centroids = list[list[int]]


def integer_vectors(embeddings: DataFrame, column: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): the usable vectors as integers."""
    given = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("given")
    )
    usable = (F.size("given") == size) & F.forall(
        "given", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )

    def whole(x: Column) -> Column:
        return F.floor(F.greatest(F.least(x * scale, F.lit(LARGEST)), F.lit(-LARGEST))).cast("int")

    return given.filter(usable).select("vec_id", F.transform("given", whole).alias("vector"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> Centroids:
    """The ``k`` vectors with the smallest hash of their id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["vector"]) for r in vectors.orderBy(key.asc_nulls_last(), "vector").limit(k).select("vector").collect()]


def nearest(vector: str, centroids: Centroids) -> Column:
    """(distance, cluster) of the nearest centroid."""

    def distance(centroid: list[int]) -> Column:
        to = F.expr("array(" + ", ".join(f"{x}L" for x in centroid) + ")")
        squares = F.zip_with(vector, to, lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0).cast("long"), lambda total, x: total + x)

    return F.array_min(
        F.array(*(F.struct(distance(c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids)))
    )


def updated(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """Centroids as the floor of the mean of their vectors."""
    size = len(centroids[0])
    sums = (
        vectors.select("vector", nearest("vector", centroids)["cluster"].alias("cluster"))
        .groupBy("cluster")
        .agg(F.count("*").alias("n"), *(F.sum(F.get("vector", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(size)))
    )
    moved = [list(c) for c in centroids]
    for row in sums.collect():
        moved[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(size)]
    return moved


def clustered(
    embeddings: DataFrame, column: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED
) -> tuple[DataFrame, Centroids]:
    """(vec_id, cluster, distance) after ``rounds`` rounds, and the centroids."""
    vectors = settled(integer_vectors(embeddings, column), "integer-vectors")
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return vectors.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), []
    for _ in range(rounds):
        centroids = updated(vectors, centroids)
    best = vectors.select("vec_id", nearest("vector", centroids).alias("best"))
    return settled(best.select("vec_id", "best.cluster", "best.distance"), "clusters"), centroids


def with_inertia(assigned: DataFrame, centroids: Centroids) -> DataFrame:
    """The assignment with its clusters' and the total inertia, and the digest of each centroid."""
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()
    by_cluster = {r["cluster"]: int(r["inertia"]) for r in sums}

    def long(value: int) -> Column:
        return F.lit(value if value < 1 << 63 else None).cast("long")

    def of_cluster(values: list[Column], kind: str) -> Column:
        return F.get(F.array(*values), F.col("cluster")) if values else F.lit(None).cast(kind)

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster([long(by_cluster.get(c, 0)) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        long(sum(by_cluster.values())).alias("inertia"),
        of_cluster([F.lit(x) for x in digests], "string").alias("centroid_sha256"),
    )
