"""Token ids of whole texts by the tokenizers library.

Byte-level BPE encodes words one by one: no token crosses the edge from other characters to
white space, or from a letter to an ASCII sign other than the apostrophe. So a text's ids are
those of its pieces between such edges. A text that holds one of the vocabulary's added tokens, such as
an end-of-text mark, goes to the library as a whole, which finds them as it does in any text. Texts
repeat most pieces; each worker encodes a piece once and remembers it, up to a fixed number.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers

from fleetwright.llm.texts import SPACE, gather, row_starts, span_hashes

BYTE_BPE = "byte_bpe_50k.json"
#: Pieces a worker remembers; then it starts anew. About 30 bytes each.
REMEMBERED = 1_000_000
#: Longer pieces are encoded each time.
LONGEST = 64

LETTER = np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
SIGN = np.zeros(256, bool)
SIGN[list(b'!"#$%&()*+,-./:;<=>?@[]^_`{|}~')] = True


def byte_bpe_path() -> str:
    return public_tokenizers.path(BYTE_BPE)


class Memory:
    """Ids by the hash of a piece: a large sorted part, and a small one that is merged into it."""

    def __init__(self, dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))] * 2
        self.ids = np.zeros(1 << 16, self.dtype)
        self.used = 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each is known, where its ids begin, how many they are."""
        known = np.zeros(len(hashes), bool)
        at, lengths = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        for keys, starts, counts in self.parts:
            if len(keys):
                slot = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[slot] == hashes
                known |= hit
                at[hit], lengths[hit] = starts[slot[hit]], counts[slot[hit]]
        return known, at, lengths

    def add(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        large, small = self.parts
        small = self._merged(small, (hashes, starts, lengths.astype(np.int32)))
        if len(small[0]) > max(50_000, len(large[0]) // 8):
            large, small = self._merged(large, small), tuple(x[:0] for x in small)
        self.parts = [large, small]

    @staticmethod
    def _merged(one, other):
        joined = [np.concatenate(x) for x in zip(one, other, strict=True)]
        order = np.argsort(joined[0], kind="stable")
        return tuple(x[order] for x in joined)

    def __len__(self) -> int:
        return sum(len(x[0]) for x in self.parts)


class PieceTokenizer:
    """Encodes slices of texts (``texts.Slice``)."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = file.read()
        self.library = Tokenizer.from_str(content)
        spec = json.loads(content)
        splits = spec["pre_tokenizer"] or {}
        if splits.get("type") != "ByteLevel" or spec["normalizer"] or splits.get("add_prefix_space"):
            raise ValueError(f"{path}: only plain byte-level vocabularies can be encoded by pieces")
        self.size = max(self.library.get_vocab(with_added_tokens=True).values()) + 1
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.model = self.library.model
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.letters = byte_letters()
        self.memory, self.remembered = Memory(self.dtype), remembered

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice, and the number of ids of each row."""
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(bounds) - 1, np.int64)
        starts, other = self._pieces(data, bounds)
        ends = np.append(starts[1:], len(data))
        codes, hashes = pd.factorize(span_hashes(data, starts, ends))
        example = np.empty(len(hashes), np.int64)
        example[codes[::-1]] = np.arange(len(codes))[::-1]
        known, at, lengths = self.memory.find(hashes)
        ids = self.memory.ids
        new = np.flatnonzero(~known)
        if len(new):
            example = example[new]
            fresh, counts = self._encoded(data, starts[example], ends[example], other)
            at[new] = len(ids) + np.cumsum(counts) - counts
            lengths[new] = counts
            ids = np.concatenate([ids, fresh])
            kept = np.flatnonzero(ends[example] - starts[example] <= LONGEST)
            if len(self.memory) + len(kept) > self.remembered:
                self.memory.clear()
            self.memory.add(
                hashes[new[kept]], gather(fresh, at[new[kept]] - at[new[0]], counts[kept]), counts[kept]
            )
        total = np.concatenate([[0], np.cumsum(lengths[codes])])
        return gather(ids, at[codes], lengths[codes]), np.diff(total[np.searchsorted(starts, bounds)])

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin, and for each byte the number of bytes before it that aren't of letters.

        Texts that hold added tokens, or may hold white space outside ASCII, are pieces as a whole.
        """
        space, letter = SPACE[data], LETTER[data]
        lead, after = data[:-1], data[1:]
        latin = (lead == 0xC3) & (after != 0x97) & (after != 0xB7)
        letter[:-1] |= latin
        letter[1:] |= latin
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[1:] |= SIGN[after] & letter[:-1]
        wide = (
            (lead == 0xC2) & ((after == 0x85) | (after == 0xA0))
            | (lead == 0xE1) & (after == 0x9A)
            | (lead == 0xE2) & ((after == 0x80) | (after == 0x81))
            | (lead == 0xE3) & (after == 0x80)
        )
        added = self._added_rows(data, bounds)
        for row in added:
            # An added token may be a word; the whole text is none.
            letter[bounds[row] : bounds[row + 1]] = False
        for row in np.union1d(np.searchsorted(bounds, np.flatnonzero(wide), "right") - 1, added):
            begin[bounds[row] : bounds[row + 1]] = False
        begin[row_starts(bounds)] = True
        return np.flatnonzero(begin), np.concatenate([[0], np.cumsum(~letter, dtype=np.int64)])

    def _added_rows(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows that hold the text of an added token, perhaps across their edges."""
        content, places = data.tobytes(), []
        for token in self.added:
            at = content.find(token)
            while at >= 0:
                places.append(at)
                at = content.find(token, at + 1)
        return np.unique(np.searchsorted(bounds, places, "right") - 1).astype(np.int64)

    def _encoded(self, data, starts, ends, other) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces and their counts. A word, with or without one space before it, goes to
        the vocabulary's model at once; other pieces are split by the library first."""
        spaced = data[starts] == 0x20
        word = (other[ends] == other[starts + spaced]) & (ends > starts + spaced)
        texts = [data[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        rest = [texts[k].decode() for k in np.flatnonzero(~word)]
        found = iter(self.library.encode_batch_fast(rest, add_special_tokens=False))
        ids: list[int] = []
        counts = np.empty(len(texts), np.int64)
        for k, (text, direct) in enumerate(zip(texts, word.tolist(), strict=True)):
            if direct:
                own = [x.id for x in self.model.tokenize(text.decode("latin-1").translate(self.letters))]
            else:
                own = next(found).ids
            ids += own
            counts[k] = len(own)
        return np.array(ids, self.dtype), counts


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for
    themselves, the others by those from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [x for x in range(256) if x not in printable]
    return {x: chr(x) for x in printable} | {x: chr(0x100 + k) for k, x in enumerate(others)}


@lru_cache(maxsize=2)
def piece_tokenizer(path: str) -> PieceTokenizer:
    """One per worker process."""
    return PieceTokenizer(path)
