"""The queries of this folder, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    centroids,
    embedding_dedup,
    language_crf,
    line_dedup,
    mixing,
    near_join,
    packing,
    quality_classifier,
    quality_rules,
    secrets_scan,
    toxicity,
    url_filter,
    whitening,
)
from .common import crc_fold, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def word_tokenizer() -> str:
    return str(public_tokenizers.path("word_bpe_49k.json"))


@query("op1_near_join")
def op1_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_links", "n_same")


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), word_tokenizer())


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learned from: one document in four is held out."""
    labels = table(spark, sf_dir, "labels").where(crc_fold(F.col("doc_id"), 4) != 2)
    return labels.select("doc_id", F.col("quality").alias("label"))


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, quality_labels(spark, sf_dir))
    scored = quality_classifier.score(docs.withColumn("held_out", crc_fold(F.col("doc_id"), 4) == 2), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), shared AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(s.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (s.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN shared s ON l.key = s.key
GROUP BY doc_id
"""


@query("op4_line_dedup", LINE_DEDUP_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op5_embedding_dedup")
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


REPETITION_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.repetition(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(*REPETITION_COLUMNS, "dup_line_chars", *[f"chars_{n}" for n in quality_rules.GRAM_LIMITS])


#: The given URL rules.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


@query("op7_url_filter")
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_fold(F.col("doc_id"), 5) != 0)
    lexicon = toxicity.train(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    scored = toxicity.score(docs.withColumn("held_out", crc_fold(F.col("doc_id"), 5) == 0), lexicon)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


@query("op9_source_mix")
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixing.taken_words(mixed).select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in secrets_scan.KINDS
    ]
    digest = F.sha2(secrets_scan.listed(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secrets_scan.listed(F.col("found")).alias("spans"))


def centroid_sql(dim: int = 64, k: int = 8, rounds: int = 10) -> str:
    """The same rounds as a chain of tables; whole numbers as doubles stay exact far below 2^53."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS BIGINT) AS cluster, x FROM kept
  ORDER BY cluster LIMIT {k})""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT rid, vec_id, x, best % {k} AS cluster, best // {k} AS distance FROM (
    SELECT rid, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, min(CAST(list_inner_product(v.x, v.x)
      - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x) AS BIGINT) * {k} + c.cluster) AS best
    FROM kept v CROSS JOIN c{r} c GROUP BY rid))"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT cluster, list(floor(s / n) ORDER BY i) AS x FROM (
      SELECT cluster, i, sum(x[i]) AS s, count(*) AS n
      FROM a{r}, (SELECT unnest(range(1, {dim + 1})) AS i) GROUP BY cluster, i) GROUP BY cluster) m ON m.cluster = c.cluster)"""
            )
    return (
        "WITH "
        + ", ".join(steps)
        + f"""
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.x, lambda v: CAST(v AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""
    )


@query("op11_centroid_clustering", centroid_sql())
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op12_language_id")
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_crf.train(docs.where(crc_fold(F.col("doc_id"), 4) != 2))
    asked = docs.select("doc_id", "text", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"))
    return language_crf.predict(asked, model).select("doc_id", "held_out", "lang_pred", "score")


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
