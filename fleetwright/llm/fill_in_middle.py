"""Fill-in-middle texts whose cuts are found by a wavelet matrix over character classes.

A text is cut between tokens: ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``, matched
left to right. Each byte of its UTF-8 form has one of four classes: a later byte of a character, a
blank, the first byte of a word, the first byte of another character of a word. A slice of texts is
one wavelet matrix of two bit planes over these classes. Then

- the tokens of a text are its words, a difference of ranks of the third class, and one more if it
  ends with a blank;
- the end of token k is the first blank after the k-th word: select finds the word, rank counts the
  blanks before it, select finds the next one;
- characters between two places are the ranks of the last three classes together.

All texts of a slice are asked at once. Slices have about 1 MB; a longer text is one of its own and
needs about 30 bytes of memory for each of its own.

Both cuts and the form come from the SHA-256 of ``<seed>:<doc_id>``, so a repeated task gives the
same text. A text is left plain if it is empty or contains one of the three marks, else by chance.

Cases: null text counts as empty; a null doc_id is spelled as nothing in the hash; a text without a
word is one token, an empty one none; the two cuts may coincide, which leaves parts empty; equal
texts of different ids are cut differently, repeated rows alike; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwright.llm.texts import SPACE, row_starts, text_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
CUT_PERCENT = 50
SPM_PERCENT = 80

INNER, BLANK, WORD_START, IN_WORD = range(4)
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Plane:
    """Bits in words of 64, with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        self.length = len(bits)
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed[: -(-len(bits) // 8)] = np.packbits(bits, bitorder="little")
        self.words = packed.view("<u8")
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros_before = 64 * np.arange(len(self.ones)) - self.ones
        self.zeros = self.length - int(self.ones[-1])

    def rank(self, bit: int, ends: np.ndarray) -> np.ndarray:
        """Bits equal to ``bit`` before each place."""
        word, inner = ends >> 6, (ends & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << inner) - np.uint64(1))
        ones = self.ones[word] + np.bitwise_count(below)
        return ones if bit else ends - ones

    def select(self, bit: int, order: np.ndarray) -> np.ndarray:
        """Place of the bit equal to ``bit`` that has ``order`` of its kind before it; each must exist."""
        before = self.ones if bit else self.zeros_before
        word = np.searchsorted(before, order, "right") - 1
        left = order - before[word]
        bits = self.words[word] if bit else ~self.words[word]
        place = np.zeros(len(order), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = (bits >> place.astype(np.uint64)) & np.uint64((1 << width) - 1)
            count = np.bitwise_count(low).astype(np.int64)
            beyond = left >= count
            left = np.where(beyond, left - count, left)
            place += width * beyond
        return 64 * word + place


class ClassMatrix:
    """Wavelet matrix of a sequence of classes 0 to 3."""

    def __init__(self, classes: np.ndarray):
        self.length = len(classes)
        high = classes >= 2
        low = (classes & 1).astype(bool)
        self.planes = Plane(high), Plane(np.concatenate([low[~high], low[high]]))
        #: Where a class begins after the first plane.
        zeros = self.planes[0].zeros
        self.begin = [0, 0, zeros, zeros]
        self.skipped = [int(self.planes[1].rank(c & 1, np.array([self.begin[c]]))[0]) for c in range(4)]

    def rank(self, kind: int, ends: np.ndarray) -> np.ndarray:
        """Members of a class before each place."""
        within = self.planes[0].rank(kind >> 1, ends) + self.begin[kind]
        return self.planes[1].rank(kind & 1, within) - self.skipped[kind]

    def select(self, kind: int, order: np.ndarray) -> np.ndarray:
        """Place of the member of a class that has ``order`` others before it; each must exist."""
        within = self.planes[1].select(kind & 1, order + self.skipped[kind])
        return self.planes[0].select(kind >> 1, within - self.begin[kind])

    def size(self, kind: int) -> int:
        return int(self.rank(kind, np.array([self.length]))[0])


def classes_of(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Class of each byte of a slice."""
    blank = SPACE[data]
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]
    before[row_starts(bounds)] = True
    found = np.where(before, np.uint8(WORD_START), np.uint8(IN_WORD))
    found[(data & 0xC0) == 0x80] = INNER
    found[blank] = BLANK
    return found


class Cutter:
    """Token counts, cuts and lengths of the texts of a slice."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.matrix = ClassMatrix(classes_of(data, bounds))
        self.starts, self.ends = bounds[:-1], bounds[1:]
        self.words_before = self.matrix.rank(WORD_START, self.starts)
        self.words = self.matrix.rank(WORD_START, self.ends) - self.words_before
        last = np.maximum(self.ends - 1, self.starts)
        self.tokens = self.words + (self.matrix.rank(BLANK, self.ends) - self.matrix.rank(BLANK, last))
        self.blanks = self.matrix.size(BLANK)

    def cut(self, tokens: np.ndarray) -> np.ndarray:
        """Place after so many tokens of each text."""
        places = np.where(tokens <= 0, self.starts, self.ends)
        asked = np.flatnonzero((tokens > 0) & (tokens <= self.words))
        word = self.matrix.select(WORD_START, self.words_before[asked] + tokens[asked] - 1)
        blank = self.matrix.rank(BLANK, word)
        ended = blank < self.blanks
        asked = asked[ended]
        places[asked] = np.minimum(self.ends[asked], self.matrix.select(BLANK, blank[ended]))
        return places

    def characters(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        ranks = (self.matrix.rank(kind, ends) - self.matrix.rank(kind, starts) for kind in (BLANK, WORD_START, IN_WORD))
        return sum(ranks)


def draws(doc_ids: list[int | None], seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers for each id."""
    spelled = (f"{seed}:{'' if x is None else x}".encode() for x in doc_ids)
    digests = b"".join(hashlib.sha256(x).digest()[:16] for x in spelled)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def _sliced(piece, doc_ids: pa.Array, seed: int, cut_percent: int, spm_percent: int) -> pa.RecordBatch:
    cutter = Cutter(piece.data, piece.bounds)
    drawn = draws(doc_ids.to_pylist(), seed)
    first, second = (drawn[:, k] % (cutter.tokens + 1) for k in range(2))
    one, two = cutter.cut(np.minimum(first, second)), cutter.cut(np.maximum(first, second))
    spm = drawn[:, 3] % 100 < spm_percent
    plain = (drawn[:, 2] % 100 >= cut_percent) | (piece.bounds[:-1] == piece.bounds[1:])
    content = piece.data.tobytes()
    outputs = []
    for k, (s, a, b, e) in enumerate(zip(piece.bounds.tolist(), one.tolist(), two.tolist(), piece.bounds.tolist()[1:], strict=False)):
        text = content[s:e]
        if not plain[k] and (PREFIX in text or SUFFIX in text or MIDDLE in text):
            plain[k] = True
        if plain[k]:
            outputs.append(text)
        elif spm[k]:
            outputs.append(b"".join((SUFFIX, content[b:e], PREFIX, content[s:a], MIDDLE, content[a:b])))
        else:
            outputs.append(b"".join((PREFIX, content[s:a], SUFFIX, content[b:e], MIDDLE, content[a:b])))
    forms = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    lengths = [cutter.characters(*x) for x in ((piece.bounds[:-1], one), (one, two))]
    return pa.RecordBatch.from_arrays(
        [
            doc_ids,
            pa.array(cutter.tokens.astype(np.int64)),
            pa.array(forms.tolist(), pa.string()),
            *(pa.array(x.astype(np.int64), mask=plain) for x in lengths),
            pa.array(outputs, pa.binary()).cast(pa.string()),
        ],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def transformed(
    docs: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): texts with their middle at the end.

    ``cut_percent`` of the texts are cut, ``spm_percent`` of those with the suffix first; the rest
    stays or has the prefix first. ``n`` counts tokens; lengths are characters, null where plain.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch.column(1)):
                own = batch.column(0).slice(piece.first, piece.last - piece.first)
                yield _sliced(piece, own, seed, cut_percent, spm_percent)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, OUTPUT)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from."""
    marks = [x.decode() for x in (PREFIX, SUFFIX, MIDDLE)]
    psm = "(?s)^{}(.*?){}(.*?){}(.*)$".format(*marks)
    spm = "(?s)^{1}(.*?){0}(.*?){2}(.*)$".format(*marks)
    return (
        F.when(F.col(form) == "psm", F.regexp_replace(output, psm, "$1$3$2"))
        .when(F.col(form) == "spm", F.regexp_replace(output, spm, "$2$3$1"))
        .otherwise(F.col(output))
    )
