"""Integer centroids and fill-in-middle texts: brute force, round trips, odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from fleetwright.llm import centroids, fill_in_middle
from fleetwright.llm.texts import text_slices

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def lloyd(rows, k, rounds):
    """Plain rounds over (vec_id, vector) with integer vectors."""
    first = sorted(
        rows, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    )
    found = [list(v) for _, v in first[:k]]
    for turn in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(found)) for _, v in rows]
        if turn < rounds:
            for j in range(len(found)):
                members = [v for (_, v), (_, o) in zip(rows, own, strict=True) if o == j]
                if members:
                    found[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return sorted((str(r[0]), j, d) for r, (d, j) in zip(rows, own, strict=True)), found


def embeddings(spark, rows):
    return spark.createDataFrame(
        [(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance int"
    ).repartition(3)


def test_rounds_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(0, 1, 64)]) for k in range(120)]
    # One vector makes up a third of the rows; ids repeat, one is null; two vectors tie.
    rows += [(500 + k % 7, rows[0][1]) for k in range(60)] + [(None, rows[3][1]), (3, rows[4][1])]
    found, centers = centroids.clustered(embeddings(spark, rows))
    plain, plain_centers = lloyd([(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows], 16, 3)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in found.collect()) == plain
    assert centers == plain_centers
    full = centroids.with_inertia(found, centers).collect()
    assert {r["inertia"] for r in full} == {sum(d for _, _, d in plain)}
    for row in full:
        assert row["cluster_inertia"] == sum(d for _, j, d in plain if j == row["cluster"])
        spelled = ",".join(map(str, plain_centers[row["cluster"]]))
        assert row["centroid_sha256"] == hashlib.sha256(spelled.encode()).hexdigest()


def test_odd_vectors(spark):
    good = [0.5] * 64
    rows = [
        (1, None), (2, []), (3, good[:-1]), (4, [*good[:-1], None]), (5, [*good[:-1], float("nan")]),
        (6, [*good[:-1], float("-inf")]), (7, good), (8, [1e30] * 64), (9, [-3e38] * 64), (None, [-0.001] * 64),
    ]
    found, centers = centroids.clustered(embeddings(spark, rows))
    assert sorted(r["vec_id"] or 0 for r in found.collect()) == [0, 7, 8, 9]
    assert len(centers) == 4 and found.filter("distance = 0").count() == 4
    assert centers[-1] == [-1] * 64 and [1 << 27] * 64 in centers
    assert centroids.with_inertia(found, centers).filter("inertia = 0").count() == 4
    one, center = centroids.clustered(embeddings(spark, rows), k=1, rounds=0)
    assert len(center) == 1 and one.filter("distance > 0").count() == 3
    assert centroids.with_inertia(one, center).count() == 4
    none, center = centroids.clustered(embeddings(spark, rows[:6]))
    assert center == [] and centroids.with_inertia(none, center).count() == 0
    assert centroids.clustered(embeddings(spark, rows).limit(0))[0].count() == 0


def test_assignment_is_one_scan_without_python(spark):
    vectors = centroids.integer_vectors(embeddings(spark, [(1, [0.5] * 64)]))
    plan = vectors.select(centroids.nearest("vector", [[1] * 64] * 16))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange hash" not in plan


def test_ranks_and_selects_of_classes():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 1000, 4096):
        classes = rng.integers(0, 4, n).astype(np.uint8)
        matrix = fill_in_middle.ClassMatrix(classes)
        for kind in range(4):
            places, ends = np.flatnonzero(classes == kind), np.arange(n + 1)
            assert (matrix.rank(kind, ends) == np.searchsorted(places, ends)).all()
            assert (matrix.select(kind, np.arange(len(places))) == places).all()


def test_every_cut_of_random_texts():
    random.seed(1)
    texts = ["".join(random.choice(" \n\tabé中\U0001f600 ") for _ in range(random.randrange(25))) for _ in range(600)]
    texts += ["", None, " ", "a", " a", "a ", "\x1c \x85x"]
    for piece in text_slices(pa.array(texts), 300):
        cutter = fill_in_middle.Cutter(piece.data, piece.bounds)
        tokens = [TOKEN.findall(t or "") for t in texts[piece.first : piece.last]]
        assert cutter.tokens.tolist() == [len(t) for t in tokens]
        for k in range(max(map(len, tokens)) + 1):
            asked = np.minimum(k, cutter.tokens)
            cuts = cutter.cut(asked)
            lengths = cutter.characters(piece.bounds[:-1], cuts)
            for i, own in enumerate(tokens):
                prefix = "".join(own[: asked[i]])
                assert piece.data[piece.bounds[i] : cuts[i]].tobytes().decode() == prefix and lengths[i] == len(prefix)


def plain_middle(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_texts_are_cut_and_restored(spark, rows, odd_rows, odd_docs, no_docs):
    marks = [(100 + k, "a < b <" + x + " c\n") for k, x in enumerate(["<P>", "<S>", "<M>", "<P", "<", "S>"] * 20)]
    given = [*rows, *marks]
    docs = spark.createDataFrame([(i, t, "x") for i, t in given], "doc_id long, text string, output string").repartition(4)
    for frame, pairs in ((docs, given), (odd_docs, [(r[0], r[1]) for r in odd_rows])):
        cut = fill_in_middle.transformed(frame)
        found = cut.select("*", fill_in_middle.restored().alias("again")).collect()
        expected = sorted((str(i), t or "", *map(str, plain_middle(i, t))) for i, t in pairs)
        assert sorted((str(r["doc_id"]), r["again"], *map(str, r[1:6])) for r in found) == expected
    assert fill_in_middle.transformed(no_docs).count() == 0
