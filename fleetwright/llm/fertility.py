"""Quality rules from what public tokenizers make of a text.

Base counts: words, characters in words, symbols, repeated lines, and words in 3-word windows
that occur twice or more. The method measures, for texts with enough words: characters per
token in each of two vocabularies (a piece vocabulary with byte fallback and a byte-level
one), the share of byte-fallback tokens, and the entropy of the text's token distribution.
Each measure has a band per language, or per script where the language is unknown: its median
over all such texts that pass the base rules, plus or minus ``WIDTH`` times the distance
between the quartiles. Of a language with fewer than ``FEWEST`` such texts those of its script
count, or else all. Entropy grows with length, so its bands are also per half power of two of the
token count; a length with fewer than ``FEWEST`` texts takes in the nearest lengths, their entropies
moved along the kind's slope. So every text has a bound for every measure. A text outside a band is rejected. Too few tokens of an unusual kind matter, not
unusual luck: byte share has only an upper band, entropy only a lower one.

A text's script is the one that most of its letters have, by code-point ranges. Words are encoded once per
worker and remembered, up to a fixed number. Bands take one small row per (language, length); they are written and
joined with the measures, not with the texts, and Spark sends them along only where their size allows.

Cases: null and empty texts have zero words, fail the base rules and have null measures; a
null language falls back to the script; in a table with fewer than ``FEWEST`` good texts these
few make the bands; equal rows get equal verdicts; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetwright.llm.shared import settled
from fleetwright.llm.texts import SPACE, Slice, gather, gram_hashes, mixed, span_hashes, text_slices, words_of
from fleetwright.llm.tokens import LONGEST, REMEMBERED, Memory, byte_bpe_path, piece_tokenizer

FEWEST_WORDS = 50
WIDTH = 3.0
FEWEST = 30
#: Least half width of a band, relative to the median; measures of like texts can all but coincide.
NARROWEST = 0.05

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

# Where the letters of a script begin, by code point; what follows a script up to the next entry is its own.
SCRIPT_STARTS = [
    (0x0000, ""), (0x0041, "latin"), (0x005B, ""), (0x0061, "latin"), (0x007B, ""), (0x00C0, "latin"), (0x02B0, ""),
    (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, ""), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, ""), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, ""), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3130, "hangul"), (0x3190, ""), (0x3400, "han"), (0x4DC0, ""),
    (0x4E00, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, ""), (0xFB50, "arabic"),
    (0xFE00, ""), (0xFE70, "arabic"), (0xFF00, ""), (0x20000, "han"), (0x32000, ""),
]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_STARTS = np.array([start for start, _ in SCRIPT_STARTS])
_SCRIPT_OF = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["piece_chars", "byte_chars", "fallback_share", "entropy"]


def piece_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


class WordTokenizer:
    """Pieces of words by the sentencepiece library, each distinct word encoded once."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.fallback = np.array([self.library.is_byte(k) for k in range(self.library.vocab_size())])
        self.memory, self.remembered = Memory(np.uint16 if len(self.fallback) <= 1 << 16 else np.uint32), remembered

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray):
        """All pieces of the words, and how many each word has."""
        codes, distinct = pd.factorize(hashes)
        example = np.empty(len(distinct), np.int64)
        example[codes[::-1]] = np.arange(len(codes))[::-1]
        known, at, lengths = self.memory.find(distinct)
        ids = self.memory.ids
        new = np.flatnonzero(~known)
        if len(new):
            spans = zip(starts[example[new]].tolist(), ends[example[new]].tolist(), strict=True)
            found = self.library.encode([data[s:e].tobytes().decode() for s, e in spans], num_threads=1)
            counts = np.array([len(x) for x in found], np.int64)
            fresh = np.array([k for x in found for k in x], self.memory.dtype)
            at[new] = len(ids) + np.cumsum(counts) - counts
            lengths[new] = counts
            ids = np.concatenate([ids, fresh])
            kept = np.flatnonzero((ends - starts)[example[new]] <= LONGEST)
            if len(self.memory) + len(kept) > self.remembered:
                self.memory.clear()
            self.memory.add(distinct[new[kept]], gather(fresh, at[new[kept]] - at[new[0]], counts[kept]), counts[kept])
        return gather(ids, at[codes], lengths[codes]), lengths[codes]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of ``values[edges[i]:edges[i + 1]]``."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[edges])


def _owners(edges: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(edges) - 1), np.diff(edges))


def base_counts(piece: Slice, words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    data, bounds = piece.data, piece.bounds
    rows = len(bounds) - 1
    inside = ~SPACE[data]
    # Lines: cut at the row's start and after every line feed.
    begin = np.zeros(len(data), bool)
    begin[1:] = data[:-1] == 0x0A
    begin[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(data))
    ends = ends - (data[ends - 1] == 0x0A)
    filled = np.concatenate([[0], np.cumsum(inside)])
    worded = filled[ends] > filled[starts]
    starts, ends = starts[worded], ends[worded]
    lines = _owners(np.searchsorted(starts, bounds))
    line_keys = mixed(span_hashes(data, starts, ends) + lines.astype(np.uint64))
    _, first = np.unique(line_keys, return_index=True)
    # Windows of three words.
    grams, at = gram_hashes(hashes, words.rows, 3)
    owner = _owners(words.rows)
    keys = mixed(grams + owner[at].astype(np.uint64))
    codes, _ = pd.factorize(keys)
    again = at[np.bincount(codes)[codes] > 1] if len(codes) else at
    covered = np.zeros(len(owner), bool)
    for k in range(3):
        covered[again + k] = True
    return {
        "n_words": np.diff(words.rows),
        "word_chars": _sums(inside & ((data & 0xC0) != 0x80), bounds),
        "n_symbols": _sums(SYMBOLS[data], bounds),
        "n_dup_lines": np.bincount(lines, minlength=rows) - np.bincount(lines[first], minlength=rows),
        "n_repeat_words": _sums(covered, words.rows),
    }


def entropies(tokens: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bits of the token distribution of each ``tokens[edges[i]:edges[i + 1]]``."""
    keys = np.sort(_owners(edges) << 32 | tokens.astype(np.int64))
    totals = np.diff(edges)
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    counts = np.diff(np.append(starts, len(keys)))
    owner = keys[starts] >> 32
    share = counts / totals[owner]
    return np.bincount(owner, -share * np.log2(share), minlength=len(totals))


def measured(docs: DataFrame, pieces: str | None = None, byte_level: str | None = None) -> DataFrame:
    """(doc_id, lang, script, counts, n_tokens, measures) of every row."""
    pieces, byte_level = pieces or piece_path(), byte_level or byte_bpe_path()
    floats = {m: pa.float64() for m in MEASURES}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_tokenizer, bytes_tokenizer = word_tokenizer(pieces), piece_tokenizer(byte_level)
        for batch in batches:
            for piece in text_slices(batch.column(2)):
                words = words_of(piece.data, piece.bounds)
                hashes = span_hashes(piece.data, words.starts, words.ends)
                found = base_counts(piece, words, hashes)
                tokens, counts = words_tokenizer.encode(piece.data, words.starts, words.ends, hashes)
                edges = np.concatenate([[0], np.cumsum(counts)])[words.rows]
                n_tokens = np.diff(edges)
                _, n_bytes = bytes_tokenizer.encode(piece.data, piece.bounds)
                none = n_tokens == 0
                some = np.maximum(n_tokens, 1)
                found |= {
                    "n_tokens": n_tokens,
                    "piece_chars": found["word_chars"] / some,
                    "byte_chars": found["word_chars"] / np.maximum(n_bytes, 1),
                    "fallback_share": _sums(words_tokenizer.fallback[tokens], edges) / some,
                    "entropy": entropies(tokens, edges),
                }
                size = piece.last - piece.first
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(piece.first, size),
                        batch.column(1).slice(piece.first, size),
                        pa.array(_scripts(piece), pa.string()),
                        *(pa.array(found[c].astype(np.int64)) for c in [*COUNTS, "n_tokens"]),
                        *(pa.array(found[m].astype(np.float64), floats[m], mask=none) for m in MEASURES),
                    ],
                    names=["doc_id", "lang", "script", *COUNTS, "n_tokens", *MEASURES],
                )

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    schema = "doc_id long, lang string, script string, "
    schema += ", ".join([f"{c} long" for c in [*COUNTS, "n_tokens"]] + [f"{m} double" for m in MEASURES])
    return columns.mapInArrow(measure, schema)


def _scripts(piece: Slice) -> list[str]:
    """The script that most letters of each text have, by code points; empty without a letter."""
    data, bounds = piece.data, piece.bounds
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    following = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32) & 0x3F
    points = lead.copy()
    two, three, four = (lead >= 0xC0) & (lead < 0xE0), (lead >= 0xE0) & (lead < 0xF0), lead >= 0xF0
    a, b, c = (following[at + k] for k in (1, 2, 3))
    points[two] = (lead[two] & 0x1F) << 6 | a[two]
    points[three] = (lead[three] & 0x0F) << 12 | a[three] << 6 | b[three]
    points[four] = (lead[four] & 0x07) << 18 | a[four] << 12 | b[four] << 6 | c[four]
    script = _SCRIPT_OF[np.searchsorted(_STARTS, points, "right") - 1]
    owner = _owners(np.searchsorted(at, bounds))
    rows, none = len(bounds) - 1, SCRIPTS.index("")
    counts = np.bincount(owner * len(SCRIPTS) + script, minlength=rows * len(SCRIPTS)).reshape(rows, len(SCRIPTS))
    counts[:, none] = 0
    return [SCRIPTS[k] for k in np.where(counts.any(axis=1), counts.argmax(axis=1), none)]


def judged(rows: DataFrame, width: float = WIDTH) -> DataFrame:
    """``measured`` rows with base_failed and kept. The rows must be settled: they are read several times."""
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kinds = F.array_compact(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("script:"), "script"), F.lit("all")))
    rows = rows.withColumn("base_failed", failed).withColumn("kinds", kinds)
    rows = rows.withColumn("length", F.floor(2 * F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int"))
    good = rows.filter(~F.col("base_failed"))
    each = good.select(F.explode("kinds").alias("kind"), "length", *MEASURES)

    def band(measure: str, value=None) -> list:
        q = F.percentile_approx(measure if value is None else value, [0.25, 0.5, 0.75], 10_000)
        half = F.greatest(width * (q[2] - q[0]), NARROWEST * q[1])
        return [(q[1] - half).alias(f"{measure}_low"), (q[1] + half).alias(f"{measure}_high")]

    by_kind = each.groupBy("kind").agg(
        F.count("*").alias("n_kind"), *(b for m in ("piece_chars", "byte_chars", "fallback_share") for b in band(m))
    )
    by_kind = settled(by_kind.filter((F.col("n_kind") >= FEWEST) | (F.col("kind") == "all")), "fertility-bands")
    # The first of a text's kinds that has enough texts, by the few combinations that occur.
    chosen = good.select("kinds").distinct().select("kinds", F.posexplode("kinds").alias("level", "kind"))
    chosen = chosen.join(by_kind.select("kind"), "kind").groupBy("kinds").agg(F.min_by("kind", "level").alias("kind"))
    chosen = settled(chosen, "fertility-kinds")
    # Written, so that Spark sees their sizes: as many rows as there are kinds, however many values ``lang`` has.
    pools = settled(_pools(each.join(chosen.select("kind").distinct(), "kind", "left_semi")), "fertility-pools")
    adjusted = F.col("entropy") + F.col("slope") * (F.col("target") - F.col("length"))
    by_length = (
        each.join(pools, ["kind", "length"])
        .groupBy("kind", F.col("target").alias("length"))
        .agg(*band("entropy", adjusted))
    )
    by_length = settled(by_length, "fertility-lengths-bands")

    def within(measure: str, low: bool = True, high: bool = True):
        test = F.lit(True)
        if low:
            test &= F.col(measure) >= F.col(f"{measure}_low")
        if high:
            test &= F.col(measure) <= F.col(f"{measure}_high")
        return test

    inside = (
        within("piece_chars") & within("byte_chars") & within("fallback_share", low=False) & within("entropy", high=False)
    )
    joined = (
        rows.join(chosen, "kinds", "left")
        .join(by_kind, "kind", "left")
        .join(by_length, ["kind", "length"], "left")
    )
    return joined.select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"), *MEASURES
    )


def _pools(each: DataFrame) -> DataFrame:
    """(kind, length, target, slope): the lengths whose texts make up the entropy band of length ``target``.

    A length with enough texts stands for itself; another takes in its neighbours, the nearest first, until there
    are enough or the kind has no more. ``slope`` is by how much entropy grows from one length to the next: a
    line through the medians of the kind's lengths that have enough texts, or else through all its texts.
    """
    n_texts = F.count("*").alias("n")
    median = F.percentile_approx("entropy", 0.5, 10_000).alias("median")
    bins = settled(each.groupBy("kind", "length").agg(n_texts, median), "fertility-lengths")
    filled = bins.filter(F.col("n") >= FEWEST).groupBy("kind").agg(F.regr_slope("median", "length").alias("of_medians"))
    slopes = each.groupBy("kind").agg(F.regr_slope("entropy", "length").alias("of_texts")).join(filled, "kind", "left")
    # More tokens do not lower the entropy of a text of the same kind.
    slope = F.greatest(F.coalesce("of_medians", "of_texts", F.lit(0.0)), F.lit(0.0))
    near = bins.select("kind", F.col("length").alias("target")).join(bins, "kind")
    near = near.withColumn("away", F.abs(F.col("length") - F.col("target")))
    # A kind has at most some sixty lengths.
    so_far = F.coalesce(
        F.sum("n").over(Window.partitionBy("kind", "target").orderBy("away").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    pools = near.withColumn("so_far", so_far).filter(F.col("so_far") < FEWEST)
    return pools.join(slopes, "kind").select("kind", "length", "target", slope.alias("slope"))


def rules(docs: DataFrame, pieces: str | None = None, byte_level: str | None = None, width: float = WIDTH) -> DataFrame:
    """Base counts, measures and verdict of every row of ``docs``."""
    return judged(settled(measured(docs, pieces, byte_level), "fertility"), width)
