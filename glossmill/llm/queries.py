"""One query for each operator of this subpackage, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm import align_tokens, bpe, decontaminate, exact_dedup, fill_middle, html_text, license_scan, quality_model, quality_rules, secret_scan, simhash, toxicity, warc
from glossmill.sources.workspace import work_dir

TOKENIZER = "word_bpe_49k.json"
ALIGNED_TOKENIZERS = ("byte_bpe_50k.json", "piece_bpe_32k.model")
#: A text is toxic from this score on.
TOXIC_FROM = 0.3
SHINGLE, MAX_BITS = 3, 3
#: Rows that a Python worker holds at a time.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Rows are whole texts, so Python workers get fewer of them at a time than is usual."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> F.Column:
    """Rows whose labels are never learned from; a null id is not one of them."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def toxicity_model(documents: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(toxicity.labelled_rows(documents, labels.filter(~held_out())))


def with_tokens(documents: DataFrame) -> DataFrame:
    """``ids`` and ``decoded`` of every text."""
    return bpe.encode(documents, public_tokenizers.path(TOKENIZER), decoded="decoded")


def token_digests(tokens: DataFrame) -> list[F.Column]:
    return [
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return tokens.select("doc_id", *token_digests(tokens))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity_model(documents, table(spark, sf_dir, "labels"))
    scored = documents.select("doc_id", toxicity.score(F.col("text"), model).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_model.classify(documents).select("doc_id", "weak", "score", "kept")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=SHINGLE, max_bits=MAX_BITS)
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = table(spark, sf_dir, "documents").select("doc_id", license_scan.scan(F.col("text")).alias("s"))
    names = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scanned.select(
        "doc_id",
        "s.n_words",
        F.size("s.base").cast("bigint").alias("n_base"),
        F.array_min("s.base.word").alias("first_word"),
        F.array_max("s.base.word").alias("last_word"),
        names(F.col("s.base.label")).alias("base_labels"),
        names(F.concat("s.base.label", "s.found.label")).alias("labels"),
        "s.score",
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.judge(documents).select(*columns)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    root = warc.archive_folder(pages)
    records = warc.read_records(warc.write_archives(pages, root), root)
    is_response = F.col("record_type") == "response"
    # Of a response the payload that was read counts, not what its headers say.
    return records.select(
        "page_id",
        F.when(is_response, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(is_response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.leaks(documents, table(spark, sf_dir, "benchmark"))
    leaks = found.select("doc_id", F.explode("leaks").alias("leak"))
    return leaks.select("doc_id", F.col("leak.item").alias("item_id"), "leak.coverage", "leak.n_tiles", "leak.matched_words", "leak.longest")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == secret_scan.KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, ("assign", "access", "hex")),
        F.sha2(secret_scan.joined(F.col("base_spans")), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    weights = html_text.fit(pages)
    text = pages.select("page_id", "url", html_text.main_text(F.col("html"), weights).alias("text"))
    return text.withColumn("n_chars", F.length("text").cast("bigint"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = fill_middle.fill_in_middle(documents)
    return done.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = lambda groups: F.when(groups.isNull(), "").otherwise(F.sha2(groups, 256))
    found = align_tokens.alignments(documents, *map(public_tokenizers.path, ALIGNED_TOKENIZERS), groups=digest)
    counts = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), *counts, F.col("groups").alias("groups_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.duplicates(documents, work_dir(spark, "exact-index"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_toxicity,
        op3_quality_classifier,
        op4_simhash,
        op5_license_scan,
        op6_quality_rules,
        op7_warc,
        op8_decontamination,
        op9_secret_scan,
        op10_html_text,
        op11_exact_dedup,
        op12_fill_in_middle,
        op13_token_alignment,
    )
}
