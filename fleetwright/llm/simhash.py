"""SimHash near duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits over the XXH64 hashes (seed 42) of 4-word shingles of the text with A-Z
lower-cased, repeats included; a bit is set if it is in more than half of the hashes. Two
fingerprints within ``distance`` bits link their documents.

Search (after Qin et al., 2018): the bits are cut into groups, correlated bits together, and
group i gets a threshold t_i with sum(t_i + 1) = distance + 1; then every pair in reach
differs in at most t_i bits of some group i. Bit frequencies and correlations come from all
fingerprints; a dynamic program picks the thresholds with the least estimated rows and
candidates, for two to ``distance + 1`` groups. A fingerprint is probed under its bits of a
group with every choice of t_i of them blanked, so equal keys meet in a bucket.

A bucket is not expanded into pairs. It is cut into blocks of about ``BLOCK`` fingerprints by
their hash; each pair of blocks is compared in one task, which gives only as many links as
join what it found connected. Equal fingerprints count once from the start.

Cases: null or empty text has fingerprint zero, which links like any other; fewer than four
words make one shingle; equal rows share a class; rows with null doc_id belong to the class of
their fingerprint but never name it (a class of only such rows has a null name); rows that share
a doc_id but not their text are different documents; an empty
table gives no rows; other columns are ignored or, by ``deduplicated``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwright.llm.components import components
from fleetwright.llm.shared import settled
from fleetwright.llm.texts import LOWER, SPACE, text_slices, words_of

BITS = 64
DISTANCE = 4
SHINGLE = 4
SEED = 42
BLOCK = 1024
#: Relative costs that the choice of groups weighs: a probed row and a compared pair.
ROW_COST, PAIR_COST = 300.0, 1.0


def slice_fingerprints(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprint of each row of a slice."""
    words = words_of(data, bounds)
    space = SPACE[data]
    kept = ~space
    kept[1:] |= ~space[:-1]
    plain = LOWER[data]
    plain[space] = 0x20
    place = np.concatenate([[0], np.cumsum(kept)])
    content = plain[kept].tobytes()
    starts = place[words.starts]
    ends = starts + (words.ends - words.starts)
    counts = np.diff(words.rows)
    shingles = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    total = int(shingles.sum())
    prints = np.zeros(len(counts), np.uint64)
    if not total:
        return prints
    first = np.repeat(words.rows[:-1] - (np.cumsum(shingles) - shingles), shingles) + np.arange(total)
    last = first + np.repeat(np.minimum(counts, SHINGLE), shingles) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(content[s:e], SEED) for s, e in zip(starts[first].tolist(), ends[last].tolist(), strict=True)),
        np.uint64,
        total,
    )
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(total, 8), axis=1, bitorder="little")
    full = np.flatnonzero(shingles)
    sums = np.add.reduceat(bits, (np.cumsum(shingles) - shingles)[full], axis=0, dtype=np.int32)
    most = 2 * sums > shingles[full][:, None]
    prints[full] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
    return prints


def fingerprints(docs: DataFrame, *others: Column) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; and ``others``, which are longs."""

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [slice_fingerprints(x.data, x.bounds) for x in text_slices(batch.column(1))]
            prints = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]],
                names=["doc_id", "fp", *batch.schema.names[2:]],
            )

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *others)
    return columns.mapInArrow(
        fingerprint, ", ".join(["doc_id long", "fp long", *(f"{c} long" for c in columns.columns[2:])])
    )


class Group(NamedTuple):
    """Bits and the number of them that may differ."""

    bits: tuple[int, ...]
    threshold: int

    def masks(self) -> list[int]:
        """The bits to compare, with every choice of ``threshold`` of them blanked."""
        whole = sum(1 << b for b in self.bits)
        return [whole ^ sum(1 << b for b in out) for out in combinations(self.bits, self.threshold)]


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j set: at most 64 x 64 sums per task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            for k in range(0, len(values), 1 << 16):
                bits = np.unpackbits(values[k : k + (1 << 16)], axis=1, bitorder="little").astype(np.float32)
                sums += np.rint(bits.T @ bits).astype(np.int64)
        at = np.arange(BITS * BITS)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel())], names=["at", "n"])

    sums = prints.select("fp").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    both = np.zeros(BITS * BITS)
    for row in sums.collect():
        both[row["at"]] = row["n"]
    return prints.count(), both.reshape(BITS, BITS)


def correlated_groups(correlation: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Cut the bits into ``parts`` groups of like size; each takes the bits most correlated with those it has."""
    free, groups = set(range(BITS)), []
    for part in range(parts):
        size = len(free) // (parts - part)
        seed = max(free, key=lambda b: (sum(correlation[b, x] for x in free), -b))
        group = [seed]
        free.remove(seed)
        while len(group) < size:
            group.append(max(free, key=lambda b: (sum(correlation[b, x] for x in group), -b)))
            free.remove(group[-1])
        groups.append(tuple(sorted(group)))
    return groups


def chosen_groups(total: int, both: np.ndarray, distance: int = DISTANCE) -> list[Group]:
    """The cut and the thresholds with the least estimated cost."""
    share = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    correlation = np.abs((both / max(total, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(correlation, 1.0)
    differ = 2 * share * (1 - share)
    plans = []
    for parts in range(2, distance + 2):
        cut = correlated_groups(correlation, parts)
        costs = [_costs(total, differ, correlation, bits, distance) for bits in cut]
        # least[s]: cost and thresholds of the groups so far, with sum(t + 1) = s.
        least: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for own in costs:
            following: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (cost, chosen) in least.items():
                for threshold, extra in own.items():
                    s, option = used + threshold + 1, (cost + extra, (*chosen, threshold))
                    if s <= distance + 1 and (s not in following or option < following[s]):
                        following[s] = option
            least = following
        if distance + 1 in least:
            cost, chosen = least[distance + 1]
            plans.append((cost, [Group(b, t) for b, t in zip(cut, chosen, strict=True) if t >= 0]))
    return min(plans, key=lambda x: (x[0], len(x[1])))[1]


def _costs(total: int, differ: np.ndarray, correlation: np.ndarray, bits: tuple[int, ...], distance: int) -> dict[int, float]:
    """Estimated cost of a group by threshold; -1 leaves it out."""
    within = np.zeros(distance + 1)
    within[0] = 1.0
    for b in bits:
        within[1:] = within[1:] * (1 - differ[b]) + within[:-1] * differ[b]
        within[0] *= 1 - differ[b]
    # Correlated bits tell less: as many as the spectrum of their correlations is wide.
    spectrum = np.linalg.eigvalsh(correlation[np.ix_(bits, bits)])
    telling = spectrum.sum() ** 2 / (spectrum**2).sum() / len(bits)
    pairs = total * (total - 1) / 2
    costs = {-1: 0.0}
    for threshold in range(min(distance, 2) + 1):
        rows = total * comb(len(bits), threshold)
        meet = min(float(within[: threshold + 1].sum()), 1.0) ** telling
        costs[threshold] = ROW_COST * rows + PAIR_COST * pairs * meet
    return costs


def links(prints: DataFrame, groups: list[Group], distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of distinct fingerprints ``fp`` that join all that are connected within ``distance``."""
    masks = [m for g in groups for m in g.masks()]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("mask", "key")
    probes = prints.select("fp", keys)
    sizes = probes.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = (
        probes.join(sizes, ["mask", "key"])
        .select("fp", "mask", "key", blocks.alias("blocks"))
        .select("fp", "mask", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .groupBy("mask", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
        .agg(F.collect_list("fp").alias("fps"))
        .select("fps")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            edges, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            pairs = [joined(values[s:e], distance) for s, e in zip(edges.tolist(), edges.tolist()[1:], strict=False)]
            pairs = [x for x in pairs if len(x)]
            found = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return met.mapInArrow(compare, "a long, b long")


def joined(prints: np.ndarray, distance: int) -> np.ndarray:
    """Of fingerprints compared pair by pair: for each connected set, its members paired with one of them."""
    values = np.unique(prints).view(np.uint64)
    near = np.zeros((len(values), len(values)), bool)
    for k in range(0, len(values), 256):
        near[k : k + 256] = np.bitwise_count(values[k : k + 256, None] ^ values[None, :]) <= distance
    left = near.sum(axis=1) > 1
    out = []
    while left.any():
        root = int(np.argmax(left))
        left[root] = False
        edge = np.array([root])
        while len(edge):
            edge = np.flatnonzero(near[edge].any(axis=0) & left)
            left[edge] = False
            out.append(np.stack([np.full(len(edge), root), edge], axis=1))
    places = np.concatenate(out) if out else np.zeros((0, 2), int)
    return values.view(np.int64)[places]


def rooted(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``rows`` (doc_id, fp, others) with the ``root`` of their class, a fingerprint, and the class's smallest doc_id."""
    prints = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-prints")
    groups = chosen_groups(*bit_counts(prints), distance)
    roots = components(links(prints.select("fp"), groups, distance))
    named = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = named.select("fp", "root").join(names, "root").select("fp", "root", "component_id")
    return rows.join(by_print, "fp")


def classes(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    rows = settled(fingerprints(docs), "simhash-rows")
    return rooted(rows, distance).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest doc_id, a row without one only if there is no other.

    Rows are told apart by doc_id and the text's hash, so rows that share an id but not their text
    are different documents. Of rows that share both, the one that is smallest as JSON stays.
    """
    key = [F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash")]
    rows = settled(fingerprints(docs, F.xxhash64("text").alias("hash")), "simhash-rows")
    found = rooted(rows, distance).groupBy("root", "doc_id", "hash").agg(F.count("*").alias("n"))
    found = settled(found.withColumn("order", F.struct(F.col("doc_id").isNull(), "doc_id", "hash")), "simhash-classes")
    first = found.groupBy("root").agg(F.min("order").alias("first"))
    gone = found.join(first, "root").filter("order <> first").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"))

    def same(left: DataFrame, right: DataFrame):
        return left["_id"].eqNullSafe(right["_id"]) & (left["_hash"] == right["_hash"])

    keyed = docs.select("*", *key)
    kept = keyed.join(gone, same(keyed, gone), "left_anti")
    again = found.filter("n > 1").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"))
    if again.isEmpty():
        return kept.select(*docs.columns)
    # Only rows that stand in the table several times need another pass.
    whole = F.struct(*docs.columns)
    repeated = kept.join(again, same(kept, again), "left_semi").groupBy("_id", "_hash")
    repeated = repeated.agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return kept.join(again, same(kept, again), "left_anti").select(*docs.columns).unionByName(repeated)
