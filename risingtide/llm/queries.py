"""The queries of the numbered operators, over whole tables, with their SQL where it exists.

Each query returns the full result of its operator as the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from risingtide.llm import alignment, toxicity
from risingtide.llm.centroids import CLUSTERS, ROUNDS, cluster_vectors
from risingtide.llm.exact_dedup import exact_duplicates
from risingtide.llm.html import main_texts
from risingtide.llm.licenses import scan_licenses
from risingtide.llm.near_dedup import near_duplicates
from risingtide.llm.packing import pack_documents
from risingtide.llm.quality_classifier import classify
from risingtide.llm.quality_rules import quality_rules
from risingtide.llm.sentence_pieces import digests
from risingtide.llm.sharding import shards
from risingtide.llm.tables import documents
from risingtide.llm.warc import archived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL giving the same rows."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder))


def trusted_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents labelled as good: the trusted set of the quality rules."""
    return spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").select("doc_id")


@query()
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(documents(spark, folder), trusted_ids(spark, folder), texts_once=True)


@query()
def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{folder}/pages.parquet"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op4_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return digests(documents(spark, folder), tokenizer_path("piece_bpe_32k.model"))


@query()
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(documents(spark, folder), tokenizer_path())


@query()
def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shards(documents(spark, folder)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classify(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query("""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id IS NULL OR doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(documents(spark, folder))


@query("""
    WITH sized AS (
      SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
      FROM pages),
    same AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM sized)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
    FROM same
""")
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archived(spark.read.parquet(f"{folder}/pages.parquet"))


@query()
def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(documents(spark, folder))


def centroid_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """Rounds of assignment to the nearest centroid and exact floored means, over all pairs."""
    steps = [f"""
    WITH points AS MATERIALIZED (
      SELECT row_number() OVER () AS point, vec_id,
             list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    centroids0 AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, v AS c
      FROM points WHERE vec_id IS NOT NULL QUALIFY cluster < {clusters})"""]
    for n in range(rounds + 1):
        steps.append(f"""
    nearest{n} AS MATERIALIZED (
      SELECT point, vec_id, v, cluster, CAST(distance AS BIGINT) AS distance FROM (
        SELECT point, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance
        FROM points CROSS JOIN centroids{n})
      QUALIFY row_number() OVER (PARTITION BY point ORDER BY distance, cluster) = 1)""")
        if n < rounds:
            steps.append(f"""
    means{n} AS (
      SELECT cluster, list((total - ((total % n) + n) % n) // n ORDER BY place) AS mean FROM (
        SELECT cluster, place, CAST(sum(v[place]) AS BIGINT) AS total, count(*) AS n
        FROM nearest{n}, range(1, 65) AS t(place) GROUP BY cluster, place)
      GROUP BY cluster),
    centroids{n + 1} AS MATERIALIZED (
      SELECT cluster, coalesce(mean, c) AS c FROM centroids{n} LEFT JOIN means{n} USING (cluster))""")
    return ",".join(steps) + f"""
    SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
           CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
           CAST(sum(distance) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM nearest{rounds} JOIN centroids{rounds} USING (cluster)"""


@query(centroid_sql())
def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{folder}/embeddings.parquet")).drop("compared")


@query()
def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query()
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.digests(documents(spark, folder), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
