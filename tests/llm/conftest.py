import pytest

from fleetwright.llm.shared import let_workers_import

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, row int, n string"


@pytest.fixture(scope="session", autouse=True)
def importing_workers(spark):
    let_workers_import(spark)


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, one-word, repeated, tied and very long texts; null and repeated ids."""
    long = "Word. " * 30_000 + "\n" + "é" * 5_000 + " " + "x" * 100_000
    rows = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \n\t ", "en", "a"),
        (4, "one", None, "a"),
        (5, "the same words stand here twice over", "en", "a"),
        (6, "the same words stand here twice over", "en", "b"),
        (6, "the same words stand here twice over", "en", "b"),
        (7, long, "de", "c"),
        (None, "no id at all", "de", None),
        (8, "12 34 %   　 <|endoftext|> it's  ok.\n", "fr", "c"),
    ]
    return [(*r, len(r[1] or ""), 0.5, "clash", 1, "clash") for r in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    """(doc_id, text) of the sample."""
    return sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
