"""Words, hashes and token ids against plain Python and the library itself."""

import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetwright.llm import packing, wavelet
from fleetwright.llm.queries import QUERIES
from fleetwright.llm.shared import open_file, settled
from fleetwright.llm.texts import gram_hashes, span_hashes, text_slices, words_of
from fleetwright.llm.tokens import PieceTokenizer, byte_bpe_path
from fleetwright.session import new_folder

TEXTS = st.lists(
    st.one_of(st.none(), st.text(alphabet="aZ é×ß.,'!\n\t 　 日1%😀-", max_size=40), st.text(max_size=30)),
    max_size=8,
)
TOKENIZER = PieceTokenizer(byte_bpe_path(), remembered=50)
#: The library as anyone loads it.
LIBRARY = Tokenizer.from_file(byte_bpe_path())


def clean(texts):
    return [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]


def library_ids(texts):
    return [x.ids for x in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_words_and_hashes(texts, size):
    texts = clean(texts)
    for piece in text_slices(pa.array(texts, pa.string()), size):
        words = words_of(piece.data, piece.bounds)
        for k, text in enumerate(texts[piece.first : piece.last]):
            own = slice(words.rows[k], words.rows[k + 1])
            spans = zip(words.starts[own], words.ends[own], strict=True)
            assert [piece.data[s:e].tobytes().decode() for s, e in spans] == re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_equal_spans_hash_alike_wherever_they_stand():
    data = np.frombuffer(b"ab cd ab cd ab cde", np.uint8)
    words = words_of(data, np.array([0, len(data)]))
    hashes = span_hashes(data, words.starts, words.ends)
    assert hashes[0] == hashes[2] == hashes[4] and len(set(hashes.tolist())) == 3
    grams, at = gram_hashes(hashes, words.rows, 2)
    assert grams[0] == grams[2] and grams[1] != grams[0] and at.tolist() == [0, 1, 2, 3, 4]


def test_different_spans_hash_differently():
    # Two words that every polynomial modulo a power of two takes for one.
    word = "a"
    while len(word) < 2048:
        word += word.translate({97: 98, 98: 97})
    words = [word[:n] for n in (1024, 2048)] + [word[:n].translate({97: 98, 98: 97}) for n in (1024, 2048)]
    # And words that differ only in zeros, at an edge of eight bytes, or in length.
    words += ["x" * n for n in range(1, 140)] + ["x" * n + "\0" for n in range(140)] + [f"{k:08d}{j:08d}" for k in range(40) for j in range(40)]
    assert len(set(words)) == len(words)
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    assert len(set(span_hashes(data, ends - [len(w) for w in words], ends).tolist())) == len(words)
    for k in (0, 2):
        own = np.frombuffer((words[k] + " " + words[2 - k]).encode(), np.uint8)
        assert TOKENIZER.encode(own, np.array([0, len(own)]))[0].tolist() == library_ids([own.tobytes().decode()])[0]


def test_added_tokens_are_the_library_s():
    mark = "<|endoftext|>"
    texts = [mark, f"a{mark}b", f" {mark} ", f"{mark}{mark}\n", mark[:-1], f"word {mark}\u3000x", None, f"é{mark}", "<|end" + mark, "plain"]
    for size in (1, 20, 1000):
        found = []
        for piece in text_slices(pa.array(texts), size):
            ids, counts = TOKENIZER.encode(piece.data, piece.bounds)
            found += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert found == library_ids(texts)
    assert sum(50256 in x for x in library_ids(texts)) == 7
    # A mark that only two texts together spell is none.
    assert TOKENIZER.encode(np.frombuffer(mark.encode(), np.uint8), np.array([0, 5, 13]))[0].tolist() == sum(library_ids([mark[:5], mark[5:]]), [])


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_ids_are_the_library_s(texts, size):
    texts = clean(texts)
    found = []
    for piece in text_slices(pa.array(texts, pa.string()), size):
        ids, counts = TOKENIZER.encode(piece.data, piece.bounds)
        ends = np.cumsum(counts)
        found += [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)]
    assert found == library_ids(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=400), st.integers(0, 50_300))
def test_wavelet_answers(ids, other):
    import io

    values = np.array(ids, np.uint16)
    content = wavelet.encode_shard(values, np.array([1]), np.array([False]), np.array([len(ids)]), 16)
    shard = wavelet.WaveletShard(io.BytesIO(content))
    assert shard.ids().tolist() == ids
    assert [shard.access(k) for k in range(len(ids))] == ids
    for token in {*ids[:5], other}:
        places = [k for k, x in enumerate(ids) if x == token]
        assert shard.count(token) == len(places)
        assert shard.count(token, len(ids) // 3, len(ids) // 2) == ids[len(ids) // 3 : len(ids) // 2].count(token)
        assert [shard.locate(token, k) for k in range(len(places))] == places


def test_wavelet_over_many_blocks():
    import io

    ids = np.random.default_rng(1).zipf(1.3, 150_000).clip(0, 50_000).astype(np.uint16)
    content = wavelet.encode_shard(ids, np.array([1]), np.array([False]), np.array([len(ids)]), 16)
    assert len(content) < ids.nbytes
    shard = wavelet.WaveletShard(io.BytesIO(content))
    assert np.array_equal(shard.ids(), ids)
    for at in (0, 65_535, 65_536, 131_072, 149_999):
        assert shard.access(at) == ids[at]
    places = np.flatnonzero(ids == 7)
    assert shard.count(7) == len(places) and shard.count(7, 60_000, 140_000) == ((places >= 60_000) & (places < 140_000)).sum()
    assert [shard.locate(7, k) for k in (0, len(places) // 2, len(places) - 1)] == places[[0, len(places) // 2, -1]].tolist()


def check_documents(found, rows, end_id=2):
    start = 0
    for row, (doc_id, text) in zip(found, rows, strict=True):
        ids = library_ids([text])[0] + [end_id]
        assert tuple(row) == (doc_id, start, len(ids), crc(ids))
        start += len(ids)


def test_wavelet_query(spark, folder, rows):
    found = QUERIES["op7_wavelet_shards"](spark, folder).orderBy("doc_id").collect()
    check_documents(found, rows)


def test_wavelet_odd_rows(spark, odd_docs, odd_rows, no_docs):
    for shard_ids in (10, 1_000_000):
        files = new_folder(spark, "wavelet")
        manifest = settled(wavelet.write_corpus(odd_docs, files, shard_ids=shard_ids), "manifest")
        found = wavelet.read_documents(spark, files, manifest).orderBy("start").collect()
        check_documents(found, sorted(((r[0], r[1]) for r in odd_rows), key=lambda x: (x[0] is not None, x[0])))
        name = manifest.first()["name"]
        with open_file(f"file://{files}", name) as file:
            shard = wavelet.WaveletShard(file)
            assert shard.count(2) == shard.length - np.count_nonzero(shard.ids() != 2)
    files = new_folder(spark, "wavelet")
    manifest = settled(wavelet.write_corpus(no_docs, files), "manifest")
    assert wavelet.read_documents(spark, files, manifest).count() == 0


def check_pieces(found, rows, end_id=1, length=packing.LENGTH):
    expected = sorted((doc_id is None, doc_id, tuple(ids + [end_id])) for (doc_id, _), ids in zip(rows, library_ids([t for _, t in rows])))
    assert sum(r["length"] for r in found) == sum(len(x[2]) for x in expected)
    whole = {}
    for r in found:
        ids = np.frombuffer(r["ids"], "<u2").tolist()
        assert len(ids) == r["length"] > 0 and crc(ids) == r["ids_crc32"]
        whole.setdefault(r["doc_id"], []).append((r["start"], r["doc_tokens"], ids))
    for doc_id in {d for d, _ in rows}:
        own = sorted(ids for _, d, ids in expected if d == doc_id)
        joined = [k for _, _, ids in sorted(whole[doc_id]) for k in ids]
        assert len(joined) == sum(map(len, own))
        if len(own) == 1:
            assert tuple(joined) == own[0] and all(n == len(own[0]) for _, n, _ in whole[doc_id])
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= length and at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))


def test_packing_query(spark, folder, docs, rows):
    check_pieces(packing.packed(docs).collect(), rows)
    assert "ids" not in QUERIES["op6_hilbert_packing"](spark, folder).columns


def test_packing_odd_rows(odd_docs, odd_rows, no_docs):
    pairs = [(r[0], r[1]) for r in odd_rows]
    check_pieces(packing.packed(odd_docs).collect(), pairs)
    check_pieces(packing.packed(odd_docs, length=16).collect(), pairs, length=16)
    assert packing.packed(no_docs).count() == 0


def test_hilbert_curve_visits_neighbours():
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), -1).reshape(-1, n)
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_like_documents_stand_together(spark):
    words = ["alpha beta gamma delta", "uno dos tres cuatro", "eins zwei drei vier"]
    docs = spark.createDataFrame([(k, f"{words[k % 3]} " * 40) for k in range(60)], "doc_id long, text string")
    found = packing.packed(docs, length=1 << 20).orderBy("sequence_id", "offset").collect()
    kinds = [r["doc_id"] % 3 for r in found]
    assert sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) <= 8
