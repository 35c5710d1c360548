"""Benchmark passages in training documents: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of characters other than white space and ASCII punctuation, A-Z lower-cased.
All documents are counted for the n-grams of the test items. Of an item's n-grams that occur at
all, those in more than ``RARE`` times as many documents as the median one are common phrases;
the rest are its seeds. So every item that occurs keeps at least half of them, however often it
was copied, and exact copies do not drown the n-grams that edited ones still have. Documents
give up the words around two seeds that stand near each other, or around one of an item of
fewer than ``FEW`` words. These passages are joined to items by seed; a pair is aligned if two
seeds lie on diagonals at most ``DRIFT`` apart (one for items of fewer than ``FEW`` words). The
alignment is local and by word: a match scores 2, a mismatch or gap costs 1. A pair counts if
the best alignment scores at least ``MIN_SCORE`` of a perfect copy of the item, and no less than
``MIN_WORDS`` words in a row would, or the whole item if it has fewer: three words that an item of
five shares with a text are no copy.

Equal passages and equal items are aligned once. Which n-grams matter is told to the tasks by
Bloom filters sized by the items' n-grams and never larger than ``MOST_BITS``; hits by chance
fall out of the join. There is one filter for each power of four of the items' lengths, so a
long item widens its own passages only. Documents are read twice without a shuffle, and only
passages with seeds are moved.

Cases: null or empty texts match nothing; items with fewer words than ``SEED`` have no seed and
match nothing; a null doc_id or item_id stays null; equal rows give equal results, one per row
of either table; a very long text is one slice of a task, with about forty bytes of memory for
each of its bytes; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwright.llm.shared import settled
from fleetwright.llm.texts import LOWER, SPACE, Slice, gram_hashes, span_hashes, text_slices, words_of

SEED = 3
RARE = 4
#: Items of fewer words need one seed, others two.
FEW = 12
DRIFT = 8
MIN_SCORE = 0.5
MIN_WORDS = 5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of a filter for each n-gram, and the least and most of a filter (powers of two).
GRAM_BITS, FEWEST_BITS, MOST_BITS = 64, 1 << 20, 1 << 27
#: What an n-gram's hash is shifted by for each of its bits in a filter.
PROBES = (0, 18, 37)
WORD_BITS = 63
LONGS = pa.list_(pa.int64())

SEPARATOR = SPACE.copy()
SEPARATOR[list(b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\'')] = True


def _slice_words(piece: Slice):
    data = LOWER[piece.data]
    words = words_of(data, piece.bounds, SEPARATOR)
    return words, span_hashes(data, words.starts, words.ends)


def _digest(words: np.ndarray, margin: int = 0) -> str:
    return xxhash.xxh3_128_hexdigest(words.tobytes(), margin)


def item_grams(items: DataFrame, n: int = SEED) -> DataFrame:
    """(item, item_id, words, grams, places): ``item`` is the digest of the words, a gram's place that of its first word,
    where it first occurs; a row per row with ``n`` words or more."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch.column(1)):
                words, hashes = _slice_words(piece)
                for k in range(piece.last - piece.first):
                    own = hashes[words.rows[k] : words.rows[k + 1]]
                    found, places = np.unique(gram_hashes(own, np.array([0, len(own)]), n)[0], return_index=True)
                    if len(found):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([_digest(own)]),
                                batch.column(0).slice(piece.first + k, 1),
                                pa.array([own.view(np.int64)], LONGS),
                                pa.array([found.view(np.int64)], LONGS),
                                pa.array([places], LONGS),
                            ],
                            names=["item", "item_id", "words", "grams", "places"],
                        )

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(
        grams, "item string, item_id long, words array<long>, grams array<long>, places array<long>"
    )


class Filter(NamedTuple):
    """A Bloom filter of ``bits`` bits, packed into bytes."""

    bits: int
    packed: np.ndarray


def bloom_filter(grams: DataFrame) -> Filter:
    """The filter of ``gram`` values; at most ``MOST_BITS / 63`` rows come in."""
    wanted = GRAM_BITS * grams.select("gram").distinct().count()
    bits = min(max(1 << wanted.bit_length(), FEWEST_BITS), MOST_BITS)
    slots = F.explode(F.array(*(F.shiftrightunsigned("gram", s).bitwiseAND(F.lit(bits - 1)) for s in PROBES)))
    marks = grams.select(slots.alias("slot")).groupBy(F.expr(f"slot DIV {WORD_BITS}").alias("block"))
    blocks = marks.agg(F.expr(f"bit_or(shiftleft(1L, cast(slot % {WORD_BITS} AS int)))").alias("bits")).toPandas()
    marked = np.zeros(-(-bits // WORD_BITS) * WORD_BITS, bool)
    if len(blocks):
        spread = blocks.bits.to_numpy(np.int64)[:, None] >> np.arange(WORD_BITS) & 1
        at, bit = np.nonzero(spread)
        marked[blocks.block.to_numpy(np.int64)[at] * WORD_BITS + bit] = True
    return Filter(bits, np.packbits(marked))


def _marked(grams: np.ndarray, known: Filter) -> np.ndarray:
    """Indexes of the n-grams that the filter lets pass."""
    at = np.arange(len(grams))
    for shift in PROBES:
        slots = ((grams[at] >> np.uint64(shift)) & np.uint64(known.bits - 1)).view(np.int64)
        at = at[known.packed[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1 == 1]
    return at


def document_counts(docs: DataFrame, known: Filter, n: int = SEED) -> DataFrame:
    """(gram, n_docs) of n-grams that the filter lets pass, summed per task before they are moved."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch.column(0)):
                words, hashes = _slice_words(piece)
                grams, at = gram_hashes(hashes, words.rows, n)
                hit = _marked(grams, known)
                owner = np.searchsorted(words.rows, at[hit], "right") - 1
                pairs = np.unique(np.stack([grams[hit].view(np.int64), owner]), axis=1)
                found, counts = np.unique(pairs[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], names=["gram", "n"])

    counted = docs.select("text").mapInArrow(count, "gram long, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n_docs"))


def passages(docs: DataFrame, filters: list[tuple[int, Filter, Filter]], n: int = SEED) -> DataFrame:
    """(passage, margin, doc, doc_id, start, words, grams, places): stretches of words around seeds.

    ``filters`` holds for each margin the filter of all seeds and that of seeds that count alone; others need a second
    one at most a margin away. ``doc`` numbers the rows, ``passage`` is a digest, places count from ``start``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch.column(2)):
                words, hashes = _slice_words(piece)
                grams, at = gram_hashes(hashes, words.rows, n)
                for margin, seeds, alone in filters:
                    hit = _marked(grams, seeds)
                    owner = np.searchsorted(words.rows, at[hit], "right") - 1
                    near = (np.diff(owner) == 0) & (np.diff(at[hit]) <= margin)
                    kept = np.append(False, near) | np.append(near, False) if len(hit) else np.zeros(0, bool)
                    kept[_marked(grams[hit], alone)] = True
                    hit, owner = hit[kept], owner[kept]
                    new = np.ones(len(hit), bool)
                    new[1:] = (np.diff(owner) > 0) | (np.diff(at[hit]) > 2 * margin)
                    firsts = np.flatnonzero(new)
                    lasts = np.append(firsts[1:], len(hit))[: len(firsts)]
                    rows = owner[firsts]
                    starts = np.maximum(at[hit[firsts]] - margin, words.rows[rows])
                    ends = np.minimum(at[hit[lasts - 1]] + n + margin, words.rows[rows + 1])
                    cuts = [hashes[a:b] for a, b in zip(starts, ends, strict=True)]
                    own = [hit[a:b] for a, b in zip(firsts, lasts, strict=True)]
                    taken = pa.array(piece.first + rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([_digest(x, margin) for x in cuts], pa.string()),
                            pa.array(np.full(len(cuts), margin)),
                            batch.column(0).take(taken),
                            batch.column(1).take(taken),
                            pa.array(starts - words.rows[rows]),
                            pa.array([x.view(np.int64) for x in cuts], LONGS),
                            pa.array([grams[x].view(np.int64) for x in own], LONGS),
                            pa.array([at[x] - a for x, a in zip(own, starts, strict=True)], LONGS),
                        ],
                        names=["passage", "margin", "doc", "doc_id", "start", "words", "grams", "places"],
                    )

    numbered = docs.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").cast("long"), "text")
    return numbered.mapInArrow(
        cut,
        "passage string, margin long, doc long, doc_id long, start long, "
        "words array<long>, grams array<long>, places array<long>",
    )


def _margin(words: Column) -> Column:
    """The least power of four, from 64, that is no smaller than the number of words."""
    return F.pow(F.lit(4), F.greatest(F.ceil(F.log2(F.size(words)) / 2), F.lit(3))).cast("long")


def _candidates(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """(passage, item) of passages with enough of an item's seeds near one diagonal."""
    hits = found.select("passage", "margin", F.explode(F.arrays_zip("grams", "places")).alias("hit"))
    hits = hits.select("passage", "margin", F.col("hit.grams").alias("gram"), F.col("hit.places").alias("at"))
    met = hits.join(seeds, ["margin", "gram"]).withColumn("diagonal", F.col("at") - F.col("place"))
    # Diagonals at most DRIFT apart share a bin of either of two rows of bins, half a bin apart.
    bins = F.array(*(F.struct(F.lit(k).alias("row"), F.floor((F.col("diagonal") + k * DRIFT) / (2 * DRIFT))) for k in (0, 1)))
    near = met.select("passage", "item", "alone", "at", F.explode(bins).alias("bin")).groupBy("passage", "item", "bin")
    enough = near.agg((F.max("alone") | (F.min("at") < F.max("at"))).alias("enough")).filter("enough")
    return enough.select("passage", "item").distinct()


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, first and last (exclusive) word in the passage."""
    score, end = _best_end(passage, item)
    if score <= 0:
        return 0, 0, 0
    return score, end - _best_end(passage[:end][::-1], item[::-1])[1], end


def _best_end(passage: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Score of the best alignment and where the shortest such prefix of the passage ends."""
    slope = -GAP * np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        step = np.zeros_like(row)
        step[1:] = np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP)
        # A gap in the item only lowers a score, so zeros need no care inside the running maximum.
        row = np.maximum(np.maximum.accumulate(np.maximum(step, 0) + slope) - slope, 0)
        top = int(row.argmax())
        if row[top] > best or row[top] == best and top < end:
            best, end = int(row[top]), top
    return best, end


def contaminated(docs: DataFrame, items: DataFrame, n: int = SEED, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): the best alignment of each document row with each item it holds.

    ``score`` is the share of a perfect copy's score, the words are counted as split here.
    """
    rows = settled(item_grams(items, n), "decontamination-items")
    distinct = rows.groupBy("item").agg(*(F.first(c).alias(c) for c in ("words", "grams", "places")))
    known = settled(distinct, "decontamination-known")
    grams = known.select(
        "item",
        _margin(F.col("words")).alias("margin"),
        (F.size("words") < FEW).alias("alone"),
        F.explode(F.arrays_zip("grams", "places")).alias("hit"),
    ).select("item", "margin", "alone", F.col("hit.grams").alias("gram"), F.col("hit.places").alias("place"))
    counts = settled(document_counts(docs, bloom_filter(grams), n), "decontamination-counts")
    occurring = settled(grams.join(counts, "gram"), "decontamination-grams")
    usual = occurring.groupBy("item").agg(F.percentile_approx("n_docs", 0.5).alias("usual"))
    rare = occurring.join(usual, "item").filter(F.col("n_docs") <= RARE * F.col("usual"))
    seeds = settled(rare.select("item", "margin", "alone", "gram", "place"), "decontamination-seeds")
    margins = sorted(r["margin"] for r in seeds.select("margin").distinct().collect())
    of = [seeds.filter(F.col("margin") == m) for m in margins]
    filters = [(m, bloom_filter(x), bloom_filter(x.filter("alone"))) for m, x in zip(margins, of, strict=True)]
    found = settled(passages(docs, filters, n), "decontamination-passages")
    texts = found.groupBy("passage").agg(*(F.first(c).alias(c) for c in ("margin", "words", "grams", "places")))
    texts = settled(texts, "decontamination-texts")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, (passage, item) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                item = item.values.to_numpy()
                score, first, last = align(passage.values.to_numpy(), item)
                if score >= MATCH * max(min_score * len(item), min(MIN_WORDS, len(item))):
                    out.append((k, score / (MATCH * len(item)), first, last))
            at, scores, firsts, lasts = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [], [])
            pairs = [batch.column(k).take(pa.array(at, pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*pairs, pa.array(scores, pa.float64()), pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64())],
                names=["passage", "item", "score", "first", "last"],
            )

    scored = (
        _candidates(texts, seeds)
        .join(texts.select("passage", F.col("words").alias("passage_words")), "passage")
        .join(known.select("item", F.col("words").alias("item_words")), "item")
        .select("passage", "item", "passage_words", "item_words")
        .mapInArrow(aligned, "passage string, item string, score double, first long, last long")
    )
    best = scored.join(found.select("passage", "doc", "doc_id", "start"), "passage").groupBy("doc", "item").agg(
        F.max(
            F.struct(
                "score",
                (-F.col("start") - F.col("first")).alias("before"),
                (F.col("start") + F.col("last")).alias("end_word"),
                "doc_id",
            )
        ).alias("best")
    )
    return best.join(rows.select("item", "item_id"), "item").select(
        "best.doc_id",
        "item_id",
        "best.score",
        (-F.col("best.before")).alias("start_word"),
        "best.end_word",
    )


def decontaminated(docs: DataFrame, items: DataFrame, n: int = SEED, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without those that hold a test item; rows without an id stay."""
    held = contaminated(docs, items, n, min_score).select(F.col("doc_id").alias("_key")).distinct()
    keyed = docs.withColumn("_key", F.col("doc_id").cast("long"))
    return keyed.join(held, "_key", "left_anti").select(*docs.columns)
