"""Token ids on disk as wavelet matrices, one file per shard.

A shard holds the ids of consecutive documents as bit planes, highest bit first; after each
plane the ids are parted stably by that bit. A plane is cut into blocks of ``BLOCK`` bits,
stored as zstandard frames where that is smaller, with a directory of frame offsets and of
the ones before each block. With it, ``rank`` reads one block and ``select`` one block after a
search of the directory, so a token, a count or an occurrence costs one or two blocks per plane.

Layout, little-endian: magic ``FWWM0001``; uint64 ids, documents, planes; documents' int64
doc_id, uint8 null mark, uint64 end; per plane uint64 zeros, per block uint64 frame end (from
the start of the frames) and uint64 ones before; then the frames. A frame of exactly the
block's packed size is stored as it is.

Cases: null and empty texts have the end id only; a null doc_id comes first and stays null;
rows with equal doc_id keep an order fixed by their text's hash; an empty table gives no file
and no row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwright.llm.shared import bases, open_file, task_number, uri_of, write_file
from fleetwright.llm.texts import text_slices
from fleetwright.llm.tokens import byte_bpe_path, piece_tokenizer

MAGIC = b"FWWM0001"
BLOCK = 1 << 16
SHARD_IDS = 1_000_000

MANIFEST = "part int, shard int, name string, documents long, ids long"


def _packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


def encode_shard(ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, ends: np.ndarray, planes: int) -> bytes:
    """File content for a shard; ``ends`` are the documents' ends in ``ids``."""
    squeeze = zstandard.ZstdCompressor(level=1, write_content_size=True)
    head = [
        MAGIC,
        np.array([len(ids), len(doc_ids), planes], "<u8").tobytes(),
        doc_ids.astype("<i8").tobytes(),
        nulls.astype(np.uint8).tobytes(),
        ends.astype("<u8").tobytes(),
    ]
    frames: list[bytes] = []
    end = 0
    rest = ids
    for level in range(planes - 1, -1, -1):
        bits = ((rest >> level) & 1).astype(bool)
        ones = np.add.reduceat(bits, np.arange(0, len(bits), BLOCK), dtype=np.int64) if len(bits) else np.zeros(0, int)
        frame_ends = []
        for k in range(0, len(bits), BLOCK):
            plain = _packed(bits[k : k + BLOCK])
            small = squeeze.compress(plain)
            frames.append(small if len(small) < len(plain) else plain)
            end += len(frames[-1])
            frame_ends.append(end)
        head.append(np.array([len(bits) - int(ones.sum())], "<u8").tobytes())
        head.append(np.array(frame_ends, "<u8").tobytes())
        head.append((np.cumsum(ones) - ones).astype("<u8").tobytes())
        rest = np.concatenate([rest[~bits], rest[bits]])
    return b"".join(head + frames)


class WaveletShard:
    """Reads one shard from a seekable file."""

    def __init__(self, file):
        self.file = file
        if self._read(0, 8) != MAGIC:
            raise ValueError("not a wavelet shard")
        self.length, documents, self.planes = np.frombuffer(self._read(8, 24), "<u8").astype(int).tolist()
        at = 32
        self.doc_ids = np.frombuffer(self._read(at, 8 * documents), "<i8")
        at += 8 * documents
        self.nulls = np.frombuffer(self._read(at, documents), np.uint8).astype(bool)
        at += documents
        self.ends = np.frombuffer(self._read(at, 8 * documents), "<u8").astype(np.int64)
        at += 8 * documents
        self.blocks = -(-self.length // BLOCK)
        self.zeros, self.frame_ends, self.ones_before = [], [], []
        for _ in range(self.planes):
            table = np.frombuffer(self._read(at, 8 + 16 * self.blocks), "<u8").astype(np.int64)
            at += 8 + 16 * self.blocks
            self.zeros.append(int(table[0]))
            self.frame_ends.append(table[1 : 1 + self.blocks])
            self.ones_before.append(table[1 + self.blocks :])
        self.frames_at = at
        self.block = lru_cache(maxsize=4 * self.planes)(self._block)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _frame_start(self, plane: int, block: int) -> int:
        if block:
            return int(self.frame_ends[plane][block - 1])
        return int(self.frame_ends[plane - 1][-1]) if plane else 0

    def _bits(self, frame: bytes, block: int) -> np.ndarray:
        size = min(BLOCK, self.length - block * BLOCK)
        if len(frame) != -(-size // 8):
            frame = zstandard.ZstdDecompressor().decompress(frame)
        return np.unpackbits(np.frombuffer(frame, np.uint8), count=size, bitorder="little")

    def _block(self, plane: int, block: int) -> np.ndarray:
        start = self._frame_start(plane, block)
        return self._bits(self._read(self.frames_at + start, int(self.frame_ends[plane][block]) - start), block)

    def _plane(self, plane: int) -> np.ndarray:
        """All bits of a plane, read at once."""
        start = self._frame_start(plane, 0)
        raw = self._read(self.frames_at + start, int(self.frame_ends[plane][-1]) - start)
        edges = np.concatenate([[start], self.frame_ends[plane]]) - start
        return np.concatenate([self._bits(raw[edges[k] : edges[k + 1]], k) for k in range(self.blocks)]).astype(bool)

    def rank(self, plane: int, bit: int, end: int) -> int:
        """Bits equal to ``bit`` among the first ``end`` of a plane."""
        block, inner = divmod(end, BLOCK)
        if block == self.blocks:
            ones = self.length - self.zeros[plane]
        else:
            ones = int(self.ones_before[plane][block])
            if inner:
                ones += int(np.count_nonzero(self.block(plane, block)[:inner]))
        return ones if bit else end - ones

    def select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit equal to ``bit`` in a plane."""
        before = self.ones_before[plane]
        if not bit:
            before = np.arange(self.blocks) * BLOCK - before
        block = int(np.searchsorted(before, k, "right")) - 1
        return block * BLOCK + int(np.flatnonzero(self.block(plane, block) == bit)[k - before[block]])

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.length:
            raise IndexError(at)
        value = 0
        for plane in range(self.planes):
            bit = int(self.block(plane, at // BLOCK)[at % BLOCK])
            value = value << 1 | bit
            at = self.rank(plane, bit, at) + bit * self.zeros[plane]
        return value

    def _descend(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where occurrences of the id in [start, end) stand below the last plane."""
        for plane in range(self.planes):
            bit = token >> (self.planes - 1 - plane) & 1
            start, end = (self.rank(plane, bit, x) + bit * self.zeros[plane] for x in (start, end))
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in [start, end)."""
        if token >> self.planes:
            return 0
        first, last = self._descend(token, start, self.length if end is None else end)
        return last - first

    def locate(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._descend(token, 0, 0)[0] + k
        for plane in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - plane) & 1
            at = self.select(plane, bit, at - bit * self.zeros[plane])
        return at

    def ids(self) -> np.ndarray:
        """All ids in order, by undoing the partings from the last plane up."""
        values = np.zeros(self.length, np.uint16 if self.planes <= 16 else np.uint32)
        if not self.length:
            return values
        for plane in range(self.planes - 1, -1, -1):
            bits = self._plane(plane)
            upper = np.empty_like(values)
            upper[~bits] = values[: self.zeros[plane]]
            upper[bits] = values[self.zeros[plane] :] | values.dtype.type(1 << (self.planes - 1 - plane))
            values = upper
        return values


def write_corpus(
    docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, shard_ids: int = SHARD_IDS
) -> DataFrame:
    """Encode ``text`` of all documents in ascending ``doc_id`` order into shard files below ``folder``.

    Returns the manifest: a row per shard with its part (tasks in order of doc_id), its number
    in the part, file name and sizes. Tasks stream their rows; at most one shard is in memory.
    """
    path, folder = path or byte_bpe_path(), uri_of(folder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = piece_tokenizer(path)
        planes = max(tokenizer.size - 1, end_id).bit_length()
        part, shard = task_number(), 0
        ids, lengths, doc_ids, nulls, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, held
            name = f"{part:06d}-{shard:06d}.wm"
            counts = np.concatenate(lengths)
            content = encode_shard(
                np.concatenate(ids), np.concatenate(doc_ids), np.concatenate(nulls), np.cumsum(counts), planes
            )
            write_file(folder, name, content)
            row = {"part": [part], "shard": [shard], "name": [name], "documents": [len(counts)], "ids": [held]}
            for kept in (ids, lengths, doc_ids, nulls):
                kept.clear()
            shard, held = shard + 1, 0
            return pa.RecordBatch.from_pydict(row, schema=MANIFEST_SCHEMA)

        for batch in batches:
            keys = batch.column(0)
            missing = np.array(keys.is_null())
            values = keys.fill_null(0).to_numpy(zero_copy_only=False)
            for piece in text_slices(batch.column(1)):
                own, counts = tokenizer.encode(piece.data, piece.bounds)
                ends = np.cumsum(counts)
                ids.append(np.insert(own, ends, end_id))
                lengths.append(counts + 1)
                doc_ids.append(values[piece.first : piece.last])
                nulls.append(missing[piece.first : piece.last])
                held += int(ends[-1]) + len(counts)
                if held >= shard_ids:
                    yield flush()
        if held:
            yield flush()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    return ordered.mapInArrow(encode, MANIFEST)


MANIFEST_SCHEMA = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("name", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]
)
DOCUMENT_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
)


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """From the files: every document's start among all ids, its number of ids and their crc32.

    ``manifest`` must be settled. Starts add the ids of all earlier shards, found in two steps:
    within a part, and over the parts' totals.
    """
    folder = uri_of(folder)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_file(folder, name) as file:
                    shard = WaveletShard(file)
                    ids = shard.ids().astype("<u4")
                starts = np.concatenate([[0], shard.ends[:-1]])
                sums = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), shard.ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, mask=shard.nulls),
                        pa.array(starts + base),
                        pa.array(shard.ends - starts),
                        pa.array(sums, pa.int64()),
                    ],
                    schema=DOCUMENT_SCHEMA,
                )

    in_part = "sum(ids) OVER (PARTITION BY part ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    shards = (
        manifest.withColumn("inner", F.coalesce(F.expr(in_part), F.lit(0)))
        .join(bases(manifest, "part", "ids"), "part")
        .select("name", (F.col("base") + F.col("inner")).alias("base"))
    )
    return shards.repartition(_tasks(spark), "name").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
