"""Cleaning and packing the documents: five stages, each over all that its predecessor kept.

Cases: null and empty texts pass the first stage unless the prior rejects them, and are near copies of each other, so one
of them stays and is packed as its end mark; very long texts are treated whole; of repeated rows, and of rows
whose texts are near copies, the one with the smallest doc_id stays; rows that share an id but not their text are
different documents to the near-copy stage, while a benchmark passage takes all rows of its id along; a row
without an id stays if no row with one is a near copy; without labels no document is rejected as toxic, without test items
none as contaminated; no documents give no pieces; other columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetwright.llm import decontamination, packing, secrets, simhash, toxicity
from fleetwright.llm.shared import let_workers_import, settled


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the classifier learns from the labelled ones among ``docs``."""
    let_workers_import(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model, "_toxicity").filter("_toxicity < 0.5").drop("_toxicity")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    let_workers_import(spark)
    return simhash.deduplicated(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without test items."""
    let_workers_import(spark)
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their token ids."""
    let_workers_import(spark)
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_copies),
    ("secret scans", hide_secrets),
    ("packing", pack),
]
#: SQL has no classifier, tokenizer or alignment; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settled(docs, f"stage-{k}")
    return docs
