"""Toxicity by a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A document has a feature if one of its n-grams of lower-cased characters, white space as one
blank each, falls into the feature's bucket. Each bucket is scaled by the log ratio of its
smoothed share among toxic and among other documents; a logistic regression on the scaled
features gives the weights (Wang and Manning, 2012).

Fitting uses a bounded sample: the ``per_class`` labelled documents of each class whose id has
the smallest hash. Buckets are counted and the ``FEATURES`` most telling ones chosen in tasks;
the driver receives those and the sample's rows of them. Scoring reads every whole text once,
without a shuffle; the weights sent along have a fixed size.

Cases: null or empty text has no feature, so its score is the prior's; unknown labels (null, or
ids not in the table) are not learned from, several labels of one id count as their maximum;
with no labelled row of either class every score is the share of toxic rows, or 0 without any;
repeated rows are scored alike; null doc_id counts as not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fleetwright.llm.shared import settled
from fleetwright.llm.texts import mixed, text_slices

GRAMS = (3, 4, 5)
BUCKETS = 1 << 20
FEATURES = 1 << 12
PER_CLASS = 5_000
ROUNDS = 100


class Model(NamedTuple):
    """Weight of every bucket, and the constant."""

    weights: np.ndarray
    constant: float


def characters(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a slice, lower-cased in Latin-1, white space as blanks; and the rows' bounds in them."""
    first = (data & 0xC0) != 0x80
    edges = np.concatenate([[0], np.cumsum(first)])[bounds]
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
    upper = (points >= 65) & (points <= 90) | (points >= 0xC0) & (points <= 0xDE) & (points != 0xD7)
    points[upper] += 32
    points[(points >= 9) & (points <= 13)] = 32
    return points, edges


def buckets(points: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that begins at each character, by n."""
    found, total = [], np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        total = total[: max(len(points) - n + 1, 0)]
        total = (total + points[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
        if n in GRAMS:
            found.append((mixed(total) % np.uint64(BUCKETS)).astype(np.int32))
    return found


class Distinct:
    """Picks one place for each bucket that a row has, without sorting."""

    def __init__(self):
        self.last = np.full(BUCKETS, -1, np.int64)
        self.base = 0

    def __call__(self, values: np.ndarray) -> np.ndarray:
        places = np.arange(self.base, self.base + len(values))
        self.base += len(values)
        self.last[values] = places
        return values[self.last[values] == places]


def row_buckets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct buckets) of every text."""
    distinct = Distinct()
    for piece in text_slices(texts):
        points, edges = characters(piece.data, piece.bounds)
        grams = buckets(points)
        for row, (start, end) in enumerate(zip(edges.tolist(), edges.tolist()[1:], strict=False)):
            own = [g[start : end - n + 1] for n, g in zip(GRAMS, grams, strict=True) if end - start >= n]
            yield piece.first + row, distinct(np.concatenate(own)) if own else np.zeros(0, np.int32)


def sampled_labels(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, label): at most ``per_class`` of each class, by the smallest hash of the id."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    one, other = (known.filter(test).orderBy(*order).limit(per_class) for test in ("label > 0", "label <= 0"))
    return one.unionByName(other).filter("doc_id IS NOT NULL")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Learn from those documents of ``docs`` that the sample of ``labels`` names."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("label"))
    shares = known.agg(
        F.count(F.when(F.col("label") > 0, 1)).alias("toxic"), F.count(F.when(F.col("label") <= 0, 1)).alias("other")
    ).first()
    if not shares["toxic"] or not shares["other"]:
        constant = 40.0 if shares["toxic"] else -40.0
        return Model(np.zeros(BUCKETS, np.float32), constant)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(sampled_labels(labels, label, per_class)), "doc_id"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            kinds = (batch.column(1).to_numpy() > 0).astype(int)
            for row, own in row_buckets(batch.column(0)):
                counts[kinds[row], own] += 1
                rows[kinds[row]] += 1
        seen = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(seen, -1).astype(np.int32)),
                pa.array(np.append(counts[1, seen], rows[1])),
                pa.array(np.append(counts[0, seen], rows[0])),
            ],
            names=["bucket", "toxic", "other"],
        )

    counted = sample.select("text", F.col("label").cast("int").alias("label")).mapInArrow(
        count, "bucket int, toxic long, other long"
    )
    sums = settled(
        counted.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "toxicity-counts"
    )
    size = sums.filter("bucket < 0").first()
    # Chi-squared of each bucket against the sample's shares.
    part = size["toxic"] / max(size["toxic"] + size["other"], 1)
    surplus = F.expr("toxic") - F.expr("toxic + other") * part
    top = sums.filter("bucket >= 0").orderBy((surplus * surplus / F.expr("toxic + other")).desc(), "bucket")
    top = top.limit(FEATURES).toPandas().sort_values("bucket")
    features = top.bucket.to_numpy(np.int64)
    ratio = np.log((top.toxic.to_numpy() + 1) / (size["toxic"] + 2)) - np.log(
        (top.other.to_numpy() + 1) / (size["other"] + 2)
    )
    index = np.full(BUCKETS, -1, np.int32)
    index[features] = np.arange(len(features))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(1).to_numpy() > 0
            for row, own in row_buckets(batch.column(0)):
                held = index[own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(kinds[row])], pa.int32()), pa.array([held[held >= 0].astype("<u2").tobytes()])],
                    names=["label", "features"],
                )

    rows = sample.select("text", F.col("label").cast("int").alias("label")).mapInArrow(
        present, "label int, features binary"
    ).toArrow()
    held = [np.frombuffer(x, "<u2") for x in rows.column("features").to_pylist()]
    weights, constant = logistic(held, rows.column("label").to_numpy(), ratio)
    # The sample's shares give way to those of all labelled rows.
    constant += np.log(shares["toxic"] / shares["other"]) - np.log(max(size["toxic"], 1) / max(size["other"], 1))
    dense = np.zeros(BUCKETS, np.float32)
    dense[features] = weights * ratio
    return Model(dense, float(constant))


def logistic(held: list[np.ndarray], kinds: np.ndarray, scale: np.ndarray, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights of scaled 0/1 features and a constant: least regularised log loss, by L-BFGS."""
    rows = np.repeat(np.arange(len(held)), [len(x) for x in held])
    columns = np.concatenate(held).astype(np.int64) if held else np.zeros(0, np.int64)
    scaled = scale[columns]

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        margin = np.bincount(rows, scaled * x[columns], len(held)) + x[-1]
        error = 0.5 * (1 + np.tanh(margin / 2)) - kinds
        value = (np.logaddexp(0, margin) - kinds * margin).mean() + decay / 2 * np.dot(x[:-1], x[:-1])
        slope = np.bincount(columns, scaled * error[rows], len(scale)) / len(held) + decay * x[:-1]
        return value, np.append(slope, error.mean())

    x = np.zeros(len(scale) + 1)
    value, slope = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        way, kept = -slope, []
        for move, change in reversed(past):
            kept.append(np.dot(move, way) / np.dot(move, change))
            way = way - kept[-1] * change
        if past:
            way = way * (np.dot(*past[-1]) / np.dot(past[-1][1], past[-1][1]))
        for (move, change), share in zip(past, reversed(kept), strict=True):
            way = way + move * (share - np.dot(change, way) / np.dot(move, change))
        length = 1.0 if past else 1 / max(1.0, float(np.abs(slope).sum()))
        while length > 1e-12:
            new_value, new_slope = loss(x + length * way)
            if new_value <= value + 1e-4 * length * np.dot(slope, way):
                break
            length /= 2
        else:
            break
        move, change = length * way, new_slope - slope
        if np.dot(move, change) > 1e-12:
            past = [*past[-9:], (move, change)]
        x, value, slope = x + move, new_value, new_slope
        if np.abs(slope).max() < 1e-6:
            break
    return x[:-1], float(x[-1])


def scored(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """``docs`` with a column from 0 to 1 added; a column of that name is replaced."""
    weights, constant = model
    docs = docs.drop(score)
    at = docs.columns.index("text")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros(batch.num_rows)
            for row, own in row_buckets(batch.column(at)):
                sums[row] = weights[own].sum(dtype=np.float64)
            rates = 1 / (1 + np.exp(-np.clip(sums + constant, -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rates)], names=[*batch.schema.names, score]
            )

    return docs.mapInArrow(rate, StructType([*docs.schema.fields, StructField(score, DoubleType())]))

