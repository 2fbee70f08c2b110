"""From raw documents to tokens: five stages, each on what the one before it kept.

Every stage but the last returns the columns of ``documents``; its result is written
as Parquet to the shared folder and read again, so that no stage runs twice and a
lost executor costs a few tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm import decontaminate, queries, secret_scan, simhash, toxicity
from glossmill.sources.workspace import keep


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the score from which a text is toxic; weights come from the labelled rows of ``docs``."""
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    scored = docs.withColumn("__score", toxicity.score(F.col("text"), model))
    return scored.filter(F.col("__score") < queries.TOXIC_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id."""
    return simhash.keep_one(docs, shingle=queries.SHINGLE, max_bits=queries.MAX_BITS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret; ``n_chars`` follows the text."""
    redacted = secret_scan.redact(docs)
    return redacted.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the token ids, and digests of ids and decoded text."""
    coded = queries.with_tokens(docs.select("doc_id", "text"))
    return coded.select("doc_id", *queries.token_digests(coded), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("tokens", tokens),
]

# No SQL has fingerprints, tiles or tokens; tests/llm holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
