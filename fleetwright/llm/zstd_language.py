"""Language by compression: the language whose dictionary makes a text smallest.

Each learned language has a zstandard raw-content dictionary: the words that are most frequent
in a bounded sample of its documents, the most frequent last, where references to them are
shortest. A text is lower-cased and encoded whole, in pieces of about ``PIECE`` characters so
that the dictionary and not the text's own past decides, once per language. The score is the
share by which the best size undercuts the second; below ``MARGIN`` the choice is marked as
rejected (``accepted`` is false), but still given.

A value of ``lang`` is learned from a share of ``LEAST_SHARE`` of the learning documents up, whatever
their number, so there are at most ``1 / LEAST_SHARE`` languages, and stray values are none. The sample takes,
per language, the documents with hash below a bound set by the language's count, about
``PER_LANGUAGE`` of them; words are counted in Spark. So what reaches the driver is at most
``WORDS`` words per language, whatever the input.

Cases: null text and text without a letter are ``und`` with score 0 and not accepted; ties go
to the language with more documents, then by name; without any learned language (each value too rare) all is
``und``; repeated rows are treated alike; null doc_id counts as not held out; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetwright.llm.shared import settled

LEAST_SHARE = 0.002
PER_LANGUAGE = 1_000
WORDS = 12_000
PIECE = 2_000
LEVEL = 9
MARGIN = 0.01
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_PIECES = re.compile(rf"(?s).{{1,{PIECE}}}(?:\s|$)|.{{1,{PIECE}}}")


def learned(
    docs: DataFrame, per_language: int = PER_LANGUAGE, words: int = WORDS, least_share: float = LEAST_SHARE
) -> dict[str, bytes]:
    """Dictionary content by language, the most frequent language first."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    every = settled(known.groupBy("lang").count(), "languages")
    least = least_share * (every.agg(F.sum("count")).first()[0] or 0)
    counts = every.filter(F.col("count") >= least)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    # One row per language, at most 1 / least_share: sent along, so that texts are not moved.
    sample = known.join(F.broadcast(counts), "lang").filter(draw < per_language / F.col("count"))
    tokens = sample.select("lang", F.explode(F.split(F.lower("text"), r"[\s\p{Punct}]+")).alias("word"))
    frequent = tokens.filter("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = frequent.withColumn("rank", rank).filter(F.col("rank") <= words)
    found: dict[str, list[str]] = {}
    for row in top.join(F.broadcast(counts), "lang").orderBy(F.desc("count"), "lang", F.desc("rank")).select("lang", "word").collect():
        found.setdefault(row["lang"], []).append(row["word"])
    return {lang: (" " + " ".join(own) + " ").encode() for lang, own in found.items()}


def identified(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every document."""
    names = list(dictionaries)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = []
        for content in dictionaries.values():
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            encoders.append(zstandard.ZstdCompressor(dict_data=dictionary, level=LEVEL, write_content_size=False))
        for batch in batches:
            found = [_best(text.as_py(), encoders) for text in batch.column(1)]
            scores = [score for _, score in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([UNKNOWN if k is None else names[k] for k, _ in found], pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array([k is not None and s >= margin for k, s in found], pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "accepted"],
            )

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return columns.mapInArrow(classify, "doc_id long, lang_pred string, score double, accepted boolean")


def _best(text: str | None, encoders: list) -> tuple[int | None, float]:
    """Index of the encoder with the smallest output, and by what share it beats the next."""
    if not encoders or not text or not _LETTER.search(text):
        return None, 0.0
    pieces = [f" {x} ".encode() for x in _PIECES.findall(text.lower())]
    sizes = np.array([sum(len(e.compress(x)) for x in pieces) for e in encoders])
    best = int(np.argmin(sizes))
    rest = np.delete(sizes, best)
    return best, float(1 - sizes[best] / rest.min()) if len(rest) else 1.0
