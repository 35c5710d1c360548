"""SimHash classes and benchmark passages against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from fleetwright.llm import decontamination, simhash
from fleetwright.llm.components import components
from fleetwright.llm.queries import QUERIES


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(len(words) - 3, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(ids, values, distance=4):
    """Smallest id in reach of each row, by comparing all pairs."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(values)), 2):
        if bin(values[a] ^ values[b]).count("1") <= distance:
            root[find(b)] = find(a)
    least = {}
    for k in range(len(values)):
        if ids[k] is not None:
            least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return [least.get(find(k)) for k in range(len(values))]


def check_classes(found, rows):
    values = [fingerprint(t) for _, t in rows]
    wanted = least_reachable([d for d, _ in rows], values)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    expected = sorted(((d, f"{v:016x}", c) for (d, _), v, c in zip(rows, values, wanted, strict=True)), key=key)
    assert sorted((tuple(r) for r in found), key=key) == expected


def test_simhash_query(spark, folder, rows):
    check_classes(QUERIES["op8_simhash_pigeonhole"](spark, folder).collect(), rows)


def test_simhash_odd_rows(odd_docs, odd_rows, no_docs):
    check_classes(simhash.classes(odd_docs).collect(), [(r[0], r[1]) for r in odd_rows])
    assert simhash.classes(no_docs).count() == 0


def test_one_row_of_each_class_stays(odd_docs):
    kept = simhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] or 0 for r in kept.collect())) == [0, 1, 4, 5, 7, 8]


def test_no_text_is_lost_where_rows_share_an_id(spark):
    a, b, c = (" ".join(random.Random(x).choices("lorem ipsum dolor sit amet elit sed".split(), k=40)) for x in "abc")
    rows = [(1, a, "x"), (5, b, "y"), (5, a, "x"), (5, c, "x"), (7, c, "x"), (7, c, "x"), (8, None, "x"), (None, "", "y")]
    rows += [(None, "no id", "z"), (None, "no id", "y")] + [(2, "often said", "x")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    kept = sorted((str(r[0]), str(r[1])) for r in simhash.deduplicated(docs).collect())
    wanted = [(1, a), (2, "often said"), (5, b), (5, c), (8, None), (None, "no id")]
    assert kept == sorted((str(i), str(t)) for i, t in wanted)
    assert {r["lang"] for r in simhash.deduplicated(docs).filter("text = 'no id'").collect()} == {"y"}
    assert simhash.deduplicated(docs.limit(0)).count() == 0


@pytest.mark.parametrize("total", [10, 10_000, 10**7, 10**9])
def test_thresholds_leave_no_pair_out(total):
    random.seed(total)
    share = np.random.default_rng(total).uniform(0.1, 0.9, 64)
    both = np.outer(share, share) * total
    both[np.diag_indices(64)] = share * total
    groups = simhash.chosen_groups(total, both)
    bits = [b for g in groups for b in g.bits]
    assert len(bits) == len(set(bits))
    # Bits left out count with threshold -1: all thresholds plus one add up to the distance plus one.
    assert sum(g.threshold + 1 for g in groups) == simhash.DISTANCE + 1
    masks = [m for g in groups for m in g.masks()]
    for _ in range(300):
        a = random.getrandbits(64)
        b = a
        for k in random.sample(range(64), simhash.DISTANCE):
            b ^= 1 << k
        assert any(a & m == b & m for m in masks)


def test_more_rows_get_longer_keys():
    both = np.full((64, 64), 0.25)
    both[np.diag_indices(64)] = 0.5
    few, many = (simhash.chosen_groups(n, both * n) for n in (10**4, 10**9))
    assert min(len(g.bits) for g in many) > min(len(g.bits) for g in few)


def test_a_large_group_of_near_copies_gives_few_links(spark):
    """3,000 fingerprints around one centre, in blocks of 100."""
    random.seed(5)
    centre = random.getrandbits(63)
    values = {centre}
    while len(values) < 3000:
        x = centre
        for k in random.sample(range(63), random.randint(1, 3)):
            x ^= 1 << k
        values.add(x)
    values |= {random.getrandbits(63) for _ in range(500)}
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    groups = simhash.chosen_groups(*simhash.bit_counts(prints))
    links = simhash.links(prints, groups, block=500)
    near = np.array(sorted(values), np.uint64)
    pairs = sum(int((np.bitwise_count(near[k + 1 :] ^ near[k]) <= 4).sum()) for k in range(len(near)))
    assert links.count() < pairs / 20
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    ids = sorted(values)
    wanted = least_reachable(ids, ids)
    assert [roots.get(v, v) for v in ids] == wanted


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}
    assert components(links.filter("false")).count() == 0


def plain_alignment(passage, item):
    best, table = 0, [[0] * (len(item) + 1) for _ in range(len(passage) + 1)]
    for i, a in enumerate(passage):
        for j, b in enumerate(item):
            table[i + 1][j + 1] = max(0, table[i][j] + (2 if a == b else -1), table[i][j + 1] - 1, table[i + 1][j] - 1)
            best = max(best, table[i + 1][j + 1])
    return best


def test_alignment_equals_plain_smith_waterman():
    rng = np.random.default_rng(3)
    for _ in range(200):
        passage, item = rng.integers(0, 6, rng.integers(1, 25)), rng.integers(0, 6, rng.integers(1, 15))
        score, start, end = decontamination.align(passage, item)
        assert score == plain_alignment(passage.tolist(), item.tolist())
        assert plain_alignment(passage[start:end].tolist(), item.tolist()) == score


WORDS = [f"{a}{b}" for a in "bcdfghjklm" for b in ("a", "ei", "ost", "und", "yx")]


def test_exact_edited_and_clean_documents(spark):
    random.seed(9)

    def text(n):
        return [random.choice(WORDS) for _ in range(n)]

    items = [text(30) for _ in range(5)]
    edited = [w if k % 7 else "changed" for k, w in enumerate(items[1])]
    documents = [
        (1, text(50) + items[0] + text(50)),
        (2, text(500) + edited + text(10)),
        (3, text(200)),
        (4, items[2][:8] + text(60)),
        (5, [f"{w.upper()}," for w in items[3]]),
        (6, items[0] + text(20) + items[4]),
    ]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in documents], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(9, None), (10, "too short")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(docs, bench).collect()}
    assert set(found) == {(1, 0), (2, 1), (5, 3), (6, 0), (6, 4)}
    assert found[(1, 0)]["score"] == 1 and (found[(1, 0)]["start_word"], found[(1, 0)]["end_word"]) == (50, 80)
    assert 0.5 < found[(2, 1)]["score"] < 1
    assert {r["doc_id"] for r in decontamination.decontaminated(docs, bench).collect()} == {3, 4}


def test_benchmark_query_finds_every_copy(spark, folder, rows):
    split = lambda t: re.findall(r"[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", t.lower())
    items = [(r["item_id"], split(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    joined = {d: f" {' '.join(split(t))} " for d, t in rows}
    wanted = {(d, i) for i, w in items for d, t in joined.items() if f" {' '.join(w)} " in t}
    found = QUERIES["op3_rare_seed_alignment"](spark, folder).collect()
    assert wanted and wanted <= {(r["doc_id"], r["item_id"]) for r in found}
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in items}
    for r in found:
        words = split(dict(rows)[r["doc_id"]])
        shared = grams[r["item_id"]] & {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        assert len(shared) >= 1 and r["score"] >= decontamination.MIN_SCORE


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame(
        [(1, "the same words stand here twice over", 1.0), (1, "the same words stand here twice over", 1.0), (None, "no id at all but more", 2.0)],
        "item_id long, text string, score double",
    )
    found = decontamination.contaminated(odd_docs, bench).collect()
    assert sorted(r["doc_id"] for r in found) == [5, 5, 6, 6, 6, 6]
    kept = decontamination.decontaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == 7
    assert decontamination.contaminated(no_docs, bench).count() == 0
    assert decontamination.contaminated(odd_docs, bench.filter("false")).count() == 0


def test_short_edited_items_against_whole_alignments(spark):
    """Copies with every fifth word or so replaced are found as aligning whole documents with all items finds them."""
    rng = random.Random(4)
    vocabulary = [f"{w}{k}" for w in WORDS for k in range(20)]
    items = [[rng.choice(vocabulary) for _ in range(rng.choice((10, 15, 25)))] for _ in range(60)]
    documents = []
    for k, item in enumerate(items):
        edited = [w if rng.random() > 0.2 else "changed" for w in item]
        around = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 80))] for _ in range(2)]
        documents.append((k, around[0] + edited + around[1]))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in documents], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    number = {w: k for k, w in enumerate([*vocabulary, "changed"])}
    wanted = {}
    for d, text in documents:
        for i, item in enumerate(items):
            words, parts = (np.array([number[w] for w in x], np.int64) for x in (text, item))
            score, start, end = decontamination.align(words, parts)
            if score >= decontamination.MIN_SCORE * 2 * len(item):
                wanted[d, i] = (score / (2 * len(item)), start, end)
    rows = decontamination.contaminated(docs, bench).collect()
    found = {(r["doc_id"], r["item_id"]): (r["score"], r["start_word"], r["end_word"]) for r in rows}
    assert len(rows) == len(found) and all(wanted[k] == v for k, v in found.items())
    assert len(found) >= 0.95 * len(wanted) >= 50


def test_items_of_few_words_long_items_and_copies(spark):
    long_item = " ".join(f"w{k}" for k in range(700))
    bench = spark.createDataFrame(
        [(1, "red green blue"), (2, "one two three four"), (3, long_item), (4, long_item), (5, "no seed"), (6, "a a a a a a a a a a a a a a")],
        "item_id long, text string",
    )
    docs = spark.createDataFrame(
        [(1, "so Red, green blue!"), (2, "red green grey"), (3, "one two three fore"), (4, "x " * 900 + long_item), (5, "no seed")]
        + [(k, "y " + long_item + " one two three four") for k in range(10, 40)]
        + [(50, "a " * 3000)],
        "doc_id long, text string",
    )
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(docs, bench).collect()}
    copies = {(d, i) for d in range(10, 40) for i in (2, 3, 4)}
    assert set(found) == {(1, 1), (4, 3), (4, 4), (50, 6)} | copies
    assert found[4, 3]["start_word"] == 900 and found[50, 6]["start_word"] == 0
    assert all(found[k]["score"] == 1 for k in copies)


def test_bloom_filter_lets_all_its_values_pass(spark):
    values = np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, 30_000)
    known = decontamination.bloom_filter(spark.createDataFrame([(int(v),) for v in values[:20_000]], "gram long"))
    passed = decontamination._marked(values.view(np.uint64), known)
    assert list(passed[:20_000]) == list(range(20_000)) and len(passed) < 20_020
    assert not len(decontamination._marked(values.view(np.uint64), decontamination.bloom_filter(spark.range(0).toDF("gram"))))
