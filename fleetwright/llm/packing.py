"""Packing documents into training sequences along a Hilbert curve.

A document's ids are counted into hashed buckets and projected to a few dimensions by a fixed
random matrix; both steps are linear, so a task sums one small vector per id. Each dimension is
spread evenly by the normal distribution of the whole corpus and cut into 2**BITS steps; the
place on the Hilbert curve through these cells is the sort key, so that documents with like
words stand side by side. In that order all ids form one line, which is cut every ``length``
ids; the remainder at its end is cut into powers of two, so nothing is padded.

Only keys and lengths are range-sorted. Every task's rows carry running sums, and the sums
over tasks are added from one row per task. Documents without ids, equal keys and equal rows
are ordered by doc_id and a row number fixed when the ids are written, so no key is too hot
to split. Null text counts as empty (the end id only), null doc_id stays null, an empty table
gives no pieces, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.llm.shared import bases, settled, task_number
from fleetwright.llm.texts import gather, mixed, text_slices
from fleetwright.llm.tokens import byte_bpe_path, piece_tokenizer

LENGTH = 2048
DIMENSIONS = 4
BUCKETS = 4096
BITS = 15

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def projection(size: int) -> np.ndarray:
    """For every id, its bucket's signed row of the random matrix."""
    matrix = np.random.default_rng(11).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)
    hashes = mixed(np.arange(size, dtype=np.uint64) + np.uint64(1))
    sign = np.where(hashes >> np.uint64(63), 1, -1).astype(np.float32)
    return matrix[(hashes % np.uint64(BUCKETS)).astype(np.int64)] * sign[:, None]


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows), after Skilling (2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    keys = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            keys = keys << 1 | (x[i] >> bit & 1)
    return keys


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, n, v0.., ids): ids as 16-bit or 32-bit little-endian numbers with the end id, v their mean projection."""
    names = [f"v{k}" for k in range(DIMENSIONS)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = piece_tokenizer(path)
        table = projection(tokenizer.size)
        for batch in batches:
            for piece in text_slices(batch.column(1)):
                ids, counts = tokenizer.encode(piece.data, piece.bounds)
                sums = np.zeros((len(counts), DIMENSIONS), np.float32)
                full = np.flatnonzero(counts)
                if len(full):
                    starts = (np.cumsum(counts) - counts)[full]
                    for k in range(DIMENSIONS):
                        sums[full, k] = np.add.reduceat(table[ids, k], starts)
                vectors = sums / np.maximum(counts, 1).astype(np.float32)[:, None]
                line = np.insert(ids, np.cumsum(counts), end_id)
                ends = np.concatenate([[0], np.cumsum(counts + 1)]) * line.itemsize
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(piece.first, piece.last - piece.first),
                        pa.array(counts + 1),
                        *(pa.array(vectors[:, k]) for k in range(DIMENSIONS)),
                        pa.Array.from_buffers(
                            pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(line)]
                        ),
                    ],
                    names=["doc_id", "n", *names, "ids"],
                )

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return columns.mapInArrow(encode, "doc_id long, n long, " + "".join(f"{v} float, " for v in names) + "ids binary")


def placed(rows: DataFrame) -> DataFrame:
    """(row, n, part, first): the rows in curve order, with each task's number and the ids before the row in it."""
    names = [f"v{k}" for k in range(DIMENSIONS)]
    measures = [f(v).alias(f"{v}_{g}") for v in names for g, f in (("mean", F.avg), ("spread", F.stddev_pop))]
    found = rows.agg(*measures).first().asDict()
    centre = [found[f"{v}_mean"] or 0.0 for v in names]
    spread = [found[f"{v}_spread"] or 1.0 for v in names]

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        z = [(c.to_numpy(np.float64) - m) / s for c, m, s in zip(columns, centre, spread, strict=True)]
        even = 1 / (1 + np.exp(-1.702 * np.clip(np.stack(z, axis=1), -12, 12)))
        return pd.Series(hilbert_keys(np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)))

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = task_number(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n)],
                names=["row", "n", "part", "first"],
            )
            before = int(ends[-1]) if len(n) else before

    keys = rows.select("row", "n", "doc_id", curve(*names).alias("place"))
    ordered = keys.repartitionByRange("place", "doc_id", "row").sortWithinPartitions("place", "doc_id", "row")
    return ordered.select("row", "n").mapInArrow(running, "row long, n long, part int, first long")


def packed(docs: DataFrame, path: str | None = None, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """All pieces of all documents, with their ids (16-bit little-endian where the vocabulary fits)."""
    path = path or byte_bpe_path()
    rows = settled(
        encoded(docs, path, end_id).withColumn("row", F.monotonically_increasing_id()), "packing-ids"
    )
    places = settled(placed(rows), "packing-places")
    total = places.agg(F.sum("n")).first()[0] or 0
    whole = total - total % length
    cuts, at = [], whole
    for k in range(length.bit_length() - 1, -1, -1):
        if (total - whole) & 1 << k:
            at += 1 << k
            cuts.append(at)
    tail = np.array([whole, *cuts], np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, sizes = (batch.column(k).to_numpy().tolist() for k in (1, 2))
            out: list[list] = [[] for _ in PIECES.split(",")]
            for doc_id, first, size, ids in zip(
                batch.column(0).to_pylist(), firsts, sizes, batch.column(3), strict=True
            ):
                ids, last = ids.as_buffer(), first + size
                width = len(ids) // size
                inner = [*range(first - first % length + length, min(last, whole + 1), length)]
                inner += [int(x) for x in tail[1:] if first < x < last] if last > whole else []
                edges = [first, *(x for x in dict.fromkeys(inner) if x < last), last]
                for start, end in zip(edges, edges[1:], strict=False):
                    own = ids[(start - first) * width : (end - first) * width]
                    if start < whole:
                        number, begin = start // length, start - start % length
                    else:
                        k = int(np.searchsorted(tail, start, "right")) - 1
                        number, begin = whole // length + k, int(tail[k])
                    wide = np.frombuffer(own, f"<u{width}").astype("<u4")
                    row = (doc_id, start - first, end - start, zlib.crc32(wide), size, number, start - begin, own)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in out[:-1]), pa.array(map(bytes, out[-1]), pa.binary())],
                names=[x.split()[0] for x in PIECES.split(",")],
            )

    line = places.join(bases(places, "part", "n"), "part").select("row", (F.col("first") + F.col("base")).alias("first"))
    joined = rows.select("doc_id", "row", "n", "ids").join(line.hint("shuffle_hash"), "row")
    return joined.select("doc_id", "first", "n", "ids").mapInArrow(cut, PIECES)
