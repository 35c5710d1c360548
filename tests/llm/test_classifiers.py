"""Toxicity, language and tokenizer fertility: held-out accuracy, brute force, odd rows."""

import math
import re
import unicodedata
from collections import Counter
from random import Random

import numpy as np
import pyarrow as pa
import pytest

from fleetwright.llm import fertility, quality, toxicity, zstd_language
from fleetwright.llm.queries import QUERIES
from fleetwright.llm.shared import settled

LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def toxic_scores(spark):
    return QUERIES["op1_toxicity_nb_ngrams"](spark, LARGE).toPandas().set_index("doc_id")


def test_toxicity_is_learned(spark, toxic_scores):
    labels = spark.read.parquet(f"{LARGE}/labels.parquet").toPandas().set_index("doc_id").toxic
    found = toxic_scores.join(labels, how="inner")
    assert len(toxic_scores) == 10_000 and toxic_scores.score.between(0, 1).all()
    assert ((toxic_scores.score >= 0.5).astype(int) == toxic_scores.predicted).all()
    held = found[found.held_out]
    assert held[held.toxic == 0].predicted.mean() < 0.01
    assert held[held.toxic == 1].predicted.mean() > 0.5
    ranks = held.score.rank()
    n = (held.toxic == 1).sum()
    area = (ranks[held.toxic == 1].sum() - n * (n + 1) / 2) / (n * (len(held) - n))
    assert area > 0.9


def test_distinct_ngram_buckets():
    texts = ["abcabcabc", "", None, "AB", "ÀÉ x", "abc\nabc"]
    for row, own in toxicity.row_buckets(pa.array(texts)):
        text = re.sub(r"[\t-\r]", " ", (texts[row] or "").lower())
        grams = {text[i : i + n] for n in toxicity.GRAMS for i in range(len(text) - n + 1)}
        assert len(own) == len(set(own.tolist())) == len(grams)


def test_logistic_regression_separates():
    held = [np.array([0, 2]), np.array([1, 2]), np.array([0]), np.array([1])] * 5
    weights, constant = toxicity.logistic(held, np.array([1, 0, 1, 0] * 5), np.ones(3))
    assert weights[0] > 1 and weights[1] < -1 and abs(weights[2]) < 0.1 and abs(constant) < 0.1


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 0), (6, 1), (6, 0), (7, 0), (4, None), (99, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels)
    found = toxicity.scored(odd_docs, model)
    assert found.columns == [*(c for c in odd_docs.columns if c != "score"), "score"]
    scores = {(r["doc_id"], r["text"]): r["score"] for r in found.collect()}
    assert found.count() == 10 and scores[(1, None)] == scores[(2, "")]
    assert toxicity.scored(no_docs, model).count() == 0
    nothing = toxicity.fit(no_docs, labels.filter("false"))
    assert toxicity.scored(odd_docs, nothing).filter("score < 0.5").count() == 10
    unlabelled = toxicity.fit(odd_docs, labels.filter("doc_id = 99"))
    assert toxicity.scored(odd_docs, unlabelled).filter("score > 0.5").count() == 10


def test_language_is_learned(spark):
    found = QUERIES["op10_zstd_language"](spark, LARGE).toPandas().set_index("doc_id")
    truth = spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    found = found.join(truth)
    held = found[found.held_out]
    assert len(found) == 10_000 and found.score.between(0, 1).all()
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert (held.lang == held.lang_pred)[held.accepted].mean() > 0.99


def test_language_odd_rows(spark, odd_docs, no_docs):
    dictionaries = zstd_language.learned(odd_docs)
    assert set(dictionaries) == {"en", "de", "fr"}
    found = {r["doc_id"]: r for r in zstd_language.identified(odd_docs, dictionaries).collect()}
    assert len(found) == 9 and {found[k]["lang_pred"] for k in (1, 2, 3)} == {"und"}
    assert found[5]["lang_pred"] == "en" and found[1]["score"] == 0
    assert zstd_language.identified(no_docs, dictionaries).count() == 0
    assert zstd_language.learned(no_docs) == {}
    assert {r["lang_pred"] for r in zstd_language.identified(odd_docs, {}).collect()} == {"und"}


def test_stray_languages_are_not_learned(spark):
    rows = [(i, f"the green house stands by the water {i}", "en") for i in range(6000)]
    rows += [(10_000 + i, f"das alte Haus steht am Wasser {i}", "de") for i in range(3000)]
    rows += [(20_000 + i, f"stray words {i}", f"x-{i}") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dictionaries = zstd_language.learned(docs)
    assert list(dictionaries) == ["en", "de"]
    assert set(zstd_language.learned(docs.filter("doc_id >= 24900"))) == {f"x-{i}" for i in range(4900, 5000)}
    found = zstd_language.identified(docs, dictionaries).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"] for r in found} == {"en", "de"} and sum(r["count"] for r in found) == 14_000


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again),
    )


def test_fertility_counts_and_measures(spark, folder, rows):
    found = {r["doc_id"]: r for r in QUERIES["op4_tokenizer_fertility"](spark, folder).collect()}
    library = fertility.word_tokenizer(fertility.piece_path()).library
    for doc_id, text in rows:
        row, counts = found[doc_id], base_counts(text)
        assert tuple(row[c] for c in fertility.COUNTS) == counts
        assert row["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (row["base_failed"] and row["kept"])
    for doc_id, text in rows[:40]:
        tokens = [k for w in re.findall(r"[^\x20\x09-\x0D]+", text) for k in library.encode(w)]
        shares = [c / len(tokens) for c in Counter(tokens).values()]
        assert math.isclose(found[doc_id]["entropy"], -sum(p * math.log2(p) for p in shares), abs_tol=1e-9)
        assert math.isclose(found[doc_id]["piece_chars"], found[doc_id]["word_chars"] / len(tokens))
        assert math.isclose(found[doc_id]["fallback_share"], sum(map(library.is_byte, tokens)) / len(tokens))


def script_by_names(text):
    """The script that most letters have, by their Unicode names."""
    names = {"CJK": "han", "HIRAGANA": "kana", "KATAKANA": "kana"}
    seen = Counter()
    for c in text or "":
        if unicodedata.category(c)[0] in "LM":
            first = unicodedata.name(c, "?").split()[0]
            seen[names.get(first, first.lower())] += 1
    return seen.most_common(1)[0][0] if seen else ""


SENTENCES = [
    "The green house", "\u00c9t\u00e9 \u00e0 la mer", "\u0417\u0435\u043b\u0451\u043d\u044b\u0439 \u0434\u043e\u043c",
    "\u03a0\u03c1\u03ac\u03c3\u03b9\u03bd\u03bf", "\u05d1\u05d9\u05ea \u05d9\u05e8\u05d5\u05e7",
    "\u0628\u064a\u062a \u0623\u062e\u0636\u0631", "\u0939\u0930\u093e \u0918\u0930", "\u0e1a\u0e49\u0e32\u0e19",
    "\u7eff\u8272\u7684\u623f\u5b50", "\u3072\u3089\u304c\u306a", "\ucd08\ub85d\uc0c9 \uc9d1", "\U00020000\U00020001", "12 + 34",
    "", "\U0001f600 !", "a \u4e2d\u6587\u5b57", "\u4e2d bc d",
]


def test_scripts_are_told_apart_by_code_points(spark):
    rows = [(i, text, None) for i, text in enumerate(SENTENCES)]
    found = fertility.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["doc_id"]: r["script"] for r in found} == {i: script_by_names(text) for i, text, _ in rows}


def test_bands_by_script_without_languages(spark):
    """Texts of four scripts whose language is unknown stay: each is measured against its own script."""
    random = Random(5)
    letters = {"latin": "abcdefghij", "cyrillic": "\u0430\u0431\u0432\u0433\u0434\u0435\u0436", "thai": "\u0e01\u0e02\u0e04\u0e07",
               "han": "\u4e00\u4e2d\u56fd\u4eba\u5927"}
    rows = []
    for k, own in enumerate(letters.values()):
        words = ["".join(random.choices(own, k=random.randint(2, 8))) for _ in range(400)]
        rows += [(1000 * k + i, " ".join(random.choices(words, k=80)), None) for i in range(60)]
    found = fertility.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    kept = Counter(r["doc_id"] // 1000 for r in found if r["kept"])
    assert all(kept[k] >= 57 for k in range(4))


def test_fertility_follows_quality(spark):
    found = QUERIES["op4_tokenizer_fertility"](spark, LARGE).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{LARGE}/labels.parquet").toPandas().set_index("doc_id")
    found = found.join(labels, how="inner")
    found = found[~found.base_failed]
    assert found[found.quality == 1].kept.mean() > 0.97
    assert found[found.quality == 0].kept.mean() < 0.2


def test_fertility_odd_rows(odd_docs, odd_rows, no_docs):
    found = {r["doc_id"]: r for r in fertility.rules(odd_docs).collect()}
    for row in odd_rows:
        assert tuple(found[row[0]][c] for c in fertility.COUNTS) == base_counts(row[1])
    assert found[1]["entropy"] is None and not found[1]["kept"]
    assert fertility.rules(no_docs).count() == 0


def test_band_of_a_rare_language_rejects_nothing(spark):
    rows = settled(fertility.measured(spark.createDataFrame(
        [(1, "xx", " ".join(f"w{k}q" for k in range(60)))], "doc_id long, lang string, text string")), "test")
    assert fertility.judged(rows).first()["kept"]


def judged_rows(spark, rows):
    """Verdicts of (doc_id, lang, script, n_tokens, piece_chars, entropy), whatever else is as usual."""
    measured = spark.createDataFrame(
        [(k, lang, script, n, 4 * n, 0, 0, 0, n, chars, chars, 0.01, bits) for k, lang, script, n, chars, bits in rows],
        "doc_id long, lang string, script string, "
        + ", ".join([f"{c} long" for c in [*fertility.COUNTS, "n_tokens"]] + [f"{m} double" for m in fertility.MEASURES]),
    )
    return {r["doc_id"]: r["kept"] for r in fertility.judged(settled(measured, "test")).collect()}


def test_thin_lengths_and_rare_languages_have_bounds(spark):
    rows = [(k, "en", "latin", 2 ** (6 + k % 4), 4 + k % 5 / 100, 5 + k % 4 * 0.8 + k % 7 / 100) for k in range(400)]
    # A few long and very long texts, and texts of a language and of a script that hardly occur.
    rows += [(1000, "en", "latin", 2**12, 4.0, 9.7), (1001, "en", "latin", 2**12, 4.0, 5.5), (1002, "en", "latin", 2**14, 4.0, 6.0)]
    rows += [(2000, "xx", "latin", 2**8, 4.0, 6.6), (2001, "xx", "latin", 2**8, 4.0, 2.0), (2002, "xx", "latin", 2**8, 0.5, 6.6)]
    rows += [(3000, None, "four-byte", 2**8, 4.0, 6.6), (3001, None, "four-byte", 2**8, 0.5, 6.6)]
    # Short ones are not held to the entropy of longer ones.
    rows += [(4000, "en", "latin", 2**5 + 20, 4.0, 4.7)]
    kept = judged_rows(spark, rows)
    assert all(kept[k] for k in range(400))
    assert {k: v for k, v in kept.items() if k >= 1000} == {
        1000: True, 1001: False, 1002: False, 2000: True, 2001: False, 2002: False, 3000: True, 3001: False, 4000: True
    }


def test_quality_is_learned(spark):
    found = QUERIES["op12_indexed_quality"](spark, LARGE).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{LARGE}/labels.parquet").toPandas().set_index("doc_id").quality
    assert len(found) == 10_000 and found.score.between(0, 1).all()
    assert ((found.score >= 0.7).astype(int) == found.predicted).all()
    held = found.join(labels, how="inner").query("held_out")
    assert held[held.quality == 1].predicted.mean() > 0.99
    assert held[held.quality == 0].predicted.mean() < 0.05
    # Probabilities are calibrated: of what scores about p, about p is good.
    assert abs(held.score.mean() - held.quality.mean()) < 0.02
    assert ((held.score - held.quality) ** 2).mean() < 0.02


def test_quality_contexts_equal_plain_counts(spark):
    texts = ["the cat, the dog 12!!", None, "", "one", "x " * 500, "the the\nthe"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    seen, sums = quality.contexts(docs)
    places, signs = quality.index_vectors()
    plain_seen, plain_sums = np.zeros_like(seen), np.zeros_like(sums)
    for text in texts:
        data = np.frombuffer((text or "").encode(), np.uint8)
        words, rows = quality.bucketed_words(data, np.array([0, len(data)]))
        assert len(words) == len(re.findall(r"[A-Za-z]+|\d+|([^\w\s])\1*", text or "")) == rows[1]
        for i, w in enumerate(words):
            plain_seen[w] += 1
            for j in range(max(i - 2, 0), min(i + 3, len(words))):
                if j != i:
                    plain_sums[w, places[words[j]]] += signs[words[j]]
    assert (seen == plain_seen).all() and (sums == plain_sums).all()
    vectors = quality.word_vectors(seen, sums)
    assert np.allclose(np.linalg.norm(vectors, axis=1), 1, atol=1e-5)
    pools = np.concatenate([p for _, p in quality.row_pools(pa.array(texts), vectors)])
    words, _ = quality.bucketed_words(np.frombuffer(texts[0].encode(), np.uint8), np.array([0, len(texts[0])]))
    steps = np.abs(vectors[words[1:]] - vectors[words[:-1]]).mean(axis=0)
    assert np.allclose(pools[0, : quality.DIMENSIONS], vectors[words].mean(axis=0), atol=1e-5)
    assert np.allclose(pools[0, quality.DIMENSIONS : 2 * quality.DIMENSIONS], steps, atol=1e-5)
    assert not pools[1].any() and not pools[4, quality.DIMENSIONS :].any()


def test_quality_temperature_and_network():
    rng = np.random.default_rng(1)
    inputs = rng.normal(size=(600, 4))
    kinds = ((inputs[:, 0] * inputs[:, 1]) > 0).astype(float)
    layers = quality.trained(inputs, kinds)
    # One layer would get about half of these right.
    assert ((quality.margins(inputs, layers) > 0) == kinds).mean() > 0.85
    margins = rng.normal(0, 4, 4000)
    drawn = (rng.random(4000) < 1 / (1 + np.exp(-margins / 3))).astype(float)
    assert 2.5 < quality.best_temperature(margins, drawn) < 3.6
    assert quality.best_temperature(margins, np.ones(4000)) == 1.0


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 0), (6, 1), (6, 0), (7, 0), (4, 1), (99, 1), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(odd_docs, labels)
    found = quality.scored(odd_docs, model)
    assert found.columns == [*(c for c in odd_docs.columns if c != "score"), "score"]
    scores = {r["doc_id"]: r["score"] for r in found.collect()}
    assert found.count() == 10 and scores[1] == scores[2] == scores[3] and all(0 <= x <= 1 for x in scores.values())
    assert quality.scored(no_docs, model).count() == 0
    nothing = quality.fit(no_docs, labels.filter("false"))
    assert quality.scored(odd_docs, nothing).filter("score < 0.5").count() == 10
    unlabelled = quality.fit(odd_docs, labels.filter("doc_id = 99"))
    assert quality.scored(odd_docs, unlabelled).filter("score > 0.5").count() == 10
