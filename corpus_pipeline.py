"""The corpus pipeline: five stages from raw documents to packed token sequences.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next one's docs. All but the last return the columns of documents. Empty tables pass
through every stage; NULL and empty texts are scored, split, kept, mixed (never taken) and packed as
each operator's docstring says, and rows may repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import line_dedup, mixing, near_join, packing, quality_classifier
from panelwright.llm.common import stored
from panelwright.llm.queries import quality_labels, word_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Bytes of a batch of rows sent to Python. Spark's own limit is 10,000 rows, which long texts make as large as they like.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's batches by bytes, unless it has a bound; results do not depend on it.

    The setting stays, since a stage's rows are computed when its result is written.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (probability of 0.7 or more)."""
    bounded_batches(spark)
    model = quality_classifier.train(docs, quality_labels(spark, sf_dir))
    return quality_classifier.score(docs.select(*COLUMNS), model, name="_score").where("_score >= 0.7").select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; none is dropped whole."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return kept.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text"))).withColumn(
        "n_chars", F.char_length("text").cast("long")
    ).select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; documents without words all stay."""
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    return near_join.one_of_each(docs, near_join.near_duplicates(docs)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once for each round that takes words of it, with the words taken."""
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    return mixing.mixed_texts(docs, mixing.mix(docs)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences of 4096 tokens."""
    bounded_batches(spark)
    return packing.pack_documents(docs, word_tokenizer())


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_shared_lines),
    ("near_join", one_of_near_copies),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; between stages the rows are written and read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: learned scores, permutations and token ids have none. tests/llm checks the stages.
ORACLE_SQL = None
