"""The operators of this subpackage over the sample tables: ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwright.llm import (
    centroids,
    decontamination,
    fertility,
    fill_in_middle,
    packing,
    quality,
    quotes,
    secrets,
    simhash,
    surrogates,
    toxicity,
    wavelet,
    zstd_language,
)
from fleetwright.llm.shared import held_out, let_workers_import, settled
from fleetwright.session import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query
def op1_toxicity_nb_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(docs, labels.filter(~held_out("doc_id", 5, 0)))
    return toxicity.scored(docs, model).select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query
def op2_keyed_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.replaced(docs, key="sample tables")


@query
def op3_rare_seed_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op4_tokenizer_fertility(spark: SparkSession, folder: str) -> DataFrame:
    return fertility.rules(table(spark, folder, "documents"))


@query
def op5_quotation_links(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.conversations(table(spark, folder, "conversations"))


@query
def op6_hilbert_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents")).drop("ids")


@query
def op7_wavelet_shards(spark: SparkSession, folder: str) -> DataFrame:
    files = new_folder(spark, "wavelet")
    manifest = settled(wavelet.write_corpus(table(spark, folder, "documents"), files), "wavelet-manifest")
    return wavelet.read_documents(spark, files, manifest)


@query
def op8_simhash_pigeonhole(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.classes(table(spark, folder, "documents"))


@query
def op9_entropy_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scanned(table(spark, folder, "documents"))


@query
def op10_zstd_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    dictionaries = zstd_language.learned(docs.filter(~held_out("doc_id", 4, 2)))
    found = zstd_language.identified(docs, dictionaries)
    return found.withColumn("held_out", held_out("doc_id", 4, 2))


@query
def op11_integer_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.with_inertia(*centroids.clustered(table(spark, folder, "embeddings")))


@query
def op12_indexed_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.fit(docs, labels.filter(~held_out("doc_id", 4, 2)))
    return quality.scored(docs, model).select(
        "doc_id",
        held_out("doc_id", 4, 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


@query
def op13_middle_by_classes(spark: SparkSession, folder: str) -> DataFrame:
    cut = fill_in_middle.transformed(table(spark, folder, "documents"))
    digests = (("output_sha256", F.col("output")), ("restored_sha256", fill_in_middle.restored()))
    return cut.select(
        *(c for c in cut.columns if c != "output"), *(F.sha2(x.cast("binary"), 256).alias(c) for c, x in digests)
    )


def _centroid_rounds(rounds: int = 3) -> str:
    """Lloyd's rounds over ``cells`` (row, i, x) from centroids ``c0`` (cluster, i, x)."""
    parts = []
    for k in range(rounds + 1):
        parts.append(f"""
            d{k} AS MATERIALIZED (
                SELECT a.row, b.cluster, CAST(sum((a.x - b.x) * (a.x - b.x)) AS BIGINT) AS distance
                FROM cells a JOIN c{k} b USING (i) GROUP BY a.row, b.cluster),
            n{k} AS MATERIALIZED (
                SELECT row, min(distance) AS distance, arg_min(cluster, distance * 16 + cluster) AS cluster
                FROM d{k} GROUP BY row)""")
        if k < rounds:
            parts.append(f"""
            s{k} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM cells JOIN n{k} USING (row) GROUP BY cluster, i),
            c{k + 1} AS MATERIALIZED (
                SELECT c.cluster, c.i, CASE WHEN n IS NULL THEN c.x ELSE CAST((s - (s % n + n) % n) // n AS BIGINT) END AS x
                FROM c{k} c LEFT JOIN s{k} USING (cluster, i))""")
    return ",".join(parts)


ORACLES["op11_integer_centroids"] = f"""
    WITH kept AS MATERIALIZED (
        SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
        WHERE len(embedding) = 64
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) = 64),
    cells AS MATERIALIZED (
        SELECT row, i, CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) AS x
        FROM (SELECT row, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM kept)),
    firsts AS (
        SELECT row, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM kept
        ORDER BY sha256('1:' || vec_id) LIMIT 16),
    c0 AS MATERIALIZED (SELECT cluster, i, x FROM cells JOIN firsts USING (row)),
    {_centroid_rounds()},
    inertia AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM n3 GROUP BY cluster),
    digests AS (
        SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY cluster)
    SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, cluster_inertia,
        (SELECT CAST(sum(distance) AS BIGINT) FROM n3) AS inertia, centroid_sha256
    FROM n3 JOIN kept USING (row) JOIN inertia USING (cluster) JOIN digests USING (cluster)
"""

ORACLES["op13_middle_by_classes"] = r"""
    WITH drawn AS (
        SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    tokens AS (
        SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS own,
            [CAST('0x' || h[8 * k - 7 : 8 * k] AS BIGINT) for k in [1, 2, 3, 4]] AS d
        FROM drawn),
    cuts AS (
        SELECT *, len(own) AS n, least(d[1] % (len(own) + 1), d[2] % (len(own) + 1)) AS a,
            greatest(d[1] % (len(own) + 1), d[2] % (len(own) + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50
                THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
        FROM tokens),
    parts AS (
        SELECT doc_id, text, n, form, array_to_string(own[1 : a], '') AS prefix,
            array_to_string(own[a + 1 : b], '') AS middle, array_to_string(own[b + 1 :], '') AS suffix
        FROM cuts)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
        sha256(prefix || middle || suffix) AS restored_sha256
    FROM parts
"""
