"""Quality by a small network on pooled random-indexing word vectors.

Words are runs of letters, of digits or of one sign. A word belongs to one of ``BUCKETS`` by its hash,
and each bucket has a fixed sparse index vector of ``SPARSE`` entries +1 or -1 (Kanerva and others,
2000). A bucket's context vector is the sum of the index vectors of all words that stand within
``REACH`` places of one of its words, over the whole corpus, less what the corpus' mean word gives,
at length one; its word vector adds its own index vector.

A document is pooled from its word vectors: their mean, and the mean size of the step from each to the
next and to the next but one, which is small where words repeat. A network of two layers gives a
margin from the pools; the margin over a temperature, fitted on labelled rows that the network has
not seen, gives the probability.

Contexts are counted over all documents in one pass; a task sends one row per bucket it has seen, the
sums combine in Spark, and the driver receives a table of fixed size. The network is fitted on a bounded
sample: the ``per_class`` labelled ids of each class with the smallest hash, one row of each. Scoring
reads every whole text once, without a shuffle. A text is pooled in slices of about 256 KB, a longer one as
a slice of its own, which needs about 1 KB of memory for each word.

Cases: null or empty text, and text without words, has pools of zero, so all such texts have the same
score; unknown labels (null, or ids not in the table) are not learned from, several labels of one id
count as their maximum, of several rows with one id one is learned from; with no labelled row of
either class every score is the share of good rows, or 0 without any; repeated rows are scored alike;
null doc_id counts as not held out; other columns are ignored.
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
from fleetwright.llm.texts import SPACE, row_starts, span_hashes, text_slices
from fleetwright.llm.toxicity import sampled_labels

BUCKETS = 1 << 14
DIMENSIONS = 32
SPARSE = 4
REACH = 2
STEPS = (1, 2)
POOLS = DIMENSIONS * (1 + len(STEPS))
SLICE = 1 << 18
PER_CLASS = 5_000
HIDDEN = 32
EPOCHS = 60
#: One in so many sampled rows is kept from the network, for the temperature.
CALIBRATED = 5

#: Kind of each byte: blank, letter, digit, sign.
KIND = np.full(256, 3, np.uint8)
KIND[SPACE] = 0
KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = 1
KIND[ord("0") : ord("9") + 1] = 2


class Model(NamedTuple):
    """Word vectors by bucket, the pools' usual place and spread, two layers, a temperature, a shift."""

    vectors: np.ndarray
    middle: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float
    shift: float


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's entries."""
    rng = np.random.default_rng(12)
    places = np.argsort(rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :SPARSE]
    return places, rng.choice(np.array([-1.0, 1.0]), (BUCKETS, SPARSE))


def bucketed_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word of a slice, and the rows' bounds in them. A run of one sign is one word."""
    kind = KIND[data]
    begin = np.ones(len(data), bool)
    begin[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == 3) & (data[1:] != data[:-1]))
    begin[row_starts(bounds)] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(data))
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    return (span_hashes(data, starts, ends) % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(starts, bounds)


def contexts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words of each bucket, and the sums of their neighbours' index vectors, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = (np.ascontiguousarray(x.T) for x in index_vectors())
        sums = np.zeros(BUCKETS * DIMENSIONS)
        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for piece in text_slices(batch.column(0)):
                words, rows = bucketed_words(piece.data, piece.bounds)
                seen += np.bincount(words, minlength=BUCKETS)
                row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
                pairs = []
                for step in range(1, REACH + 1):
                    near = row[step:] == row[:-step]
                    one, other = words[:-step][near], words[step:][near]
                    pairs += [(one, other), (other, one)]
                target, giver = (np.concatenate(x) for x in zip(*pairs, strict=True))
                target *= DIMENSIONS
                at = np.concatenate([target + places[k][giver] for k in range(SPARSE)])
                sums += np.bincount(at, np.concatenate([signs[k][giver] for k in range(SPARSE)]), BUCKETS * DIMENSIONS)
        held = np.flatnonzero(seen)
        table = sums.reshape(BUCKETS, DIMENSIONS)[held].astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(seen[held]), *(pa.array(table[:, k]) for k in range(DIMENSIONS))],
            names=["bucket", "n", *columns],
        )

    columns = [f"c{k}" for k in range(DIMENSIONS)]
    counted = docs.select("text").mapInArrow(count, "bucket int, n long, " + ", ".join(f"{c} long" for c in columns))
    total = counted.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ["n", *columns])).toArrow()
    seen, sums = np.zeros(BUCKETS, np.int64), np.zeros((BUCKETS, DIMENSIONS))
    at = total.column("bucket").to_numpy()
    seen[at] = total.column("n").to_numpy()
    for k, c in enumerate(columns):
        sums[at, k] = total.column(c).to_numpy()
    return seen, sums


def word_vectors(seen: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Context and index vector of each bucket together, at length one."""
    places, signs = index_vectors()
    own = np.zeros((BUCKETS, DIMENSIONS))
    own[np.arange(BUCKETS)[:, None], places] = signs / np.sqrt(SPARSE)
    usual = sums.sum(axis=0) / max(seen.sum(), 1)
    context = sums - seen[:, None] * usual
    length = np.linalg.norm(context, axis=1, keepdims=True)
    both = own + np.divide(context, length, out=np.zeros_like(context), where=length > 0)
    return (both / np.maximum(np.linalg.norm(both, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def row_pools(texts: pa.Array, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, pools of some rows) of a text column."""
    for piece in text_slices(texts, SLICE):
        words, rows = bucketed_words(piece.data, piece.bounds)
        pools = np.zeros((len(rows) - 1, 1 + len(STEPS), DIMENSIONS), np.float32)
        places = vectors[words]
        moves = [np.abs(places[step:] - places[:-step]) for step in STEPS]
        for row, (start, end) in enumerate(zip(rows.tolist(), rows.tolist()[1:], strict=False)):
            if start < end:
                pools[row, 0] = _mean(places[start:end])
            for k, step in enumerate(STEPS, 1):
                if start + step < end:
                    pools[row, k] = _mean(moves[k - 1][start : end - step])
        yield piece.first, pools.reshape(len(pools), POOLS)


def _mean(values: np.ndarray) -> np.ndarray:
    return np.full(len(values), 1 / len(values), np.float32) @ values


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, pools) of every document."""

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, pools in row_pools(batch.column(1), vectors):
                lists = pa.FixedSizeListArray.from_arrays(pa.array(pools.ravel()), POOLS).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(pools)), lists], names=["doc_id", "pools"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        pool, "doc_id long, pools array<float>"
    )


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Word vectors from all of ``docs``; the network from those that the sample of ``labels`` names."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("label"))
    shares = known.agg(
        F.count(F.when(F.col("label") > 0, 1)).alias("good"), F.count(F.when(F.col("label") <= 0, 1)).alias("bad")
    ).first()
    vectors = word_vectors(*contexts(docs))
    sample = F.broadcast(sampled_labels(labels, label, per_class))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample.select("doc_id")), "doc_id")
    drawn = pooled(keyed, vectors).groupBy("doc_id").agg(F.min("pools").alias("pools"))
    rows = settled(drawn.join(sample, "doc_id").orderBy("doc_id"), "quality-sample").toArrow().sort_by("doc_id")
    kinds = (rows.column("label").to_numpy() > 0).astype(float)
    if not kinds.sum() or kinds.all():
        margin = 40.0 if shares["good"] and not shares["bad"] else -40.0
        if shares["good"] and shares["bad"]:
            margin = float(np.log(shares["good"] / shares["bad"]))
        empty = np.zeros((POOLS, 1)), np.zeros(1), np.zeros(1), 0.0
        return Model(vectors, np.zeros(POOLS), np.ones(POOLS), empty, 1.0, margin)
    pools = rows.column("pools").combine_chunks().values.to_numpy().reshape(-1, POOLS).astype(np.float64)
    middle, spread = pools.mean(axis=0), pools.std(axis=0) + 1e-6
    inputs = (pools - middle) / spread
    apart = np.arange(len(kinds)) % CALIBRATED == 0
    # The sample's shares give way to those of all labelled rows.
    shift = float(np.log(shares["good"] / shares["bad"]) - np.log(kinds.sum() / (1 - kinds).sum()))
    layers = trained(inputs[~apart], kinds[~apart])
    temperature = best_temperature(margins(inputs[apart], layers), kinds[apart])
    return Model(vectors, middle, spread, layers, temperature, shift)


def margins(inputs: np.ndarray, layers: tuple) -> np.ndarray:
    one, bias, two, constant = layers
    return np.tanh(inputs @ one + bias) @ two + constant


def trained(inputs: np.ndarray, kinds: np.ndarray, decay: float = 1e-3, rate: float = 3e-3, batch: int = 64) -> tuple:
    """Two layers that lessen the regularised log loss, by Adam; always the same for the same rows."""
    rng = np.random.default_rng(7)
    size = inputs.shape[1]
    values = [
        rng.normal(0, 1 / np.sqrt(size), (size, HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1),
    ]
    first, second = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]
    steps = EPOCHS * -(-len(kinds) // batch)
    done = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(kinds))
        for start in range(0, len(order), batch):
            own = order[start : start + batch]
            hidden = np.tanh(inputs[own] @ values[0] + values[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ values[2] + values[3], -40, 40))) - kinds[own]) / len(own)
            back = np.outer(error, values[2]) * (1 - hidden**2)
            slopes = [inputs[own].T @ back + decay * values[0], back.sum(axis=0), hidden.T @ error + decay * values[2], error.sum()]
            done += 1
            pace = rate * (1 - done / (steps + 1))
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                move = (first[k] / (1 - 0.9**done)) / (np.sqrt(second[k] / (1 - 0.999**done)) + 1e-8)
                values[k] = values[k] - pace * move
    return values[0], values[1], values[2], float(values[3][0])


def best_temperature(found: np.ndarray, kinds: np.ndarray) -> float:
    """The divisor of the margins with the least log loss; 1 without rows of both kinds."""
    if not len(kinds) or not kinds.sum() or kinds.all():
        return 1.0
    options = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
    losses = [(np.logaddexp(0, found / t) - kinds * found / t).mean() for t in options]
    return float(options[int(np.argmin(losses))])


def scored(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """``docs`` with a column from 0 to 1 added; a column of that name is replaced."""
    docs = docs.drop(score)
    at = docs.columns.index("text")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates = np.zeros(batch.num_rows)
            for first, pools in row_pools(batch.column(at), model.vectors):
                margin = margins((pools - model.middle) / model.spread, model.layers) / model.temperature + model.shift
                rates[first : first + len(pools)] = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates)], names=[*batch.schema.names, score])

    return docs.mapInArrow(rate, StructType([*docs.schema.fields, StructField(score, DoubleType())]))
