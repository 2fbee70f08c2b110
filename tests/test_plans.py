"""What the plans of the jobs look like: shuffles, pruning, no Python."""

import re

import pytest
from pyspark.sql import functions as F

from glossmill.config import JobConfig
from glossmill.functions.comments import strip_comments
from glossmill.functions.languages import detect_language
from glossmill.operators import chunks as chunking
from glossmill.operators import review
from glossmill.operators.edits import apply_spans
from glossmill.plans import document
from glossmill.plans.strip import strip_corpus


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "files")
    rows = spark.range(200).select(
        F.concat(F.lit("r/f"), F.col("id").cast("string"), F.lit(".py")).alias("path"),
        F.repeat(F.lit("\ndef f():\n  x = 1 # c\n"), 100).alias("content"),
        F.lit("unused").alias("note"),
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange\b", plan(df)))


@pytest.mark.parametrize("mode", ["regex", "lexical"])
def test_strip_is_narrow(files, mode):
    text = plan(strip_corpus(files, mode=mode))
    # Scripts that a pattern cannot tell are scanned, as one Arrow column of nulls but for these.
    assert "Exchange" not in text and text.count("ArrowEvalPython") == (mode == "lexical")
    assert "BatchEvalPython" not in text and ("THEN content" in text) == (mode == "lexical")
    assert "ReadSchema: struct<path:string,content:string>" in text


def test_requests_are_narrow(files):
    planned = document.plan_files(files)
    for df in (document.corpus_requests(planned), chunking.chunks(planned, 80), chunking.file_lines(planned)):
        assert exchanges(df) == 0 and "Python" not in plan(df)


def test_review_and_audit_are_narrow(files):
    pairs = files.select("path", F.lit("python").alias("language"), F.col("content").alias("before"), F.upper("content").alias("after"))
    for df in (review.review(pairs), review.preservation_audit(pairs), review.guarded(pairs, 0.5)):
        assert exchanges(df) == 0


@pytest.mark.parametrize("places", [False, True])
def test_the_audit_strips_each_side_once(files, places):
    """Python's functions in a row had every text between them worked out again for each use."""
    pairs = files.select("path", detect_language(F.col("path")).alias("language"), F.col("content").alias("before"), F.upper("content").alias("after"))
    text = review.preservation_audit(pairs, places=places)._jdf.queryExecution().optimizedPlan().toString()
    once = strip_comments(F.col("before"), F.col("language"))
    stripped = pairs.select(once)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < text.count("(?<rest>") <= 2 * stripped.count("(?<rest>")


def responses_of(files):
    planned = document.plan_files(files)
    return planned, chunking.chunks(planned, 80).select(
        "path", "chunk_index", F.col("text").alias("output"), F.lit(None).cast("string").alias("error")
    )


def test_assembling_shuffles_each_side_once_and_no_source_text(spark, files):
    planned, responses = responses_of(files)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = document.document_corpus(planned, responses, JobConfig())
        text = plan(done)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert exchanges(done) == 2
    source_side = text[: text.rindex("ObjectHashAggregate")]
    shuffled = re.findall(r"Project \[path#\d+, language#\d+, (.*)", source_side)
    assert shuffled and not any(re.search(r"(^|, )content#\d+(,|\])", columns) for columns in shuffled[1:])
    assert "ObjectHashAggregate(keys=[path" in text and "partial_collect_set" in text


def test_selections_shuffle_the_files_once(spark, files):
    planned, _ = responses_of(files)
    chosen = planned.select("path", F.lit(1).alias("start"), F.lit(9).alias("end"))
    answers = planned.select(
        "path", F.lit(1).alias("chunk_index"), F.lit("x").alias("output"), F.lit(None).cast("string").alias("error")
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(document.document_selections(planned, chosen, answers))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("ReadSchema: struct<path:string,content:string>") == 1


def test_sparse_spans_shuffle_no_other_text(spark, files):
    """Of the files only those whose path is marked are shuffled; the rest is joined with the marks alone."""
    spans = files.select("path", F.lit(1).alias("start"), F.lit(2).alias("end"), F.lit("x").alias("replacement")).where("path like '%7.py'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edited = apply_spans(files, spans, sparse=True)
        text, rows = plan(edited), edited.groupBy("n_spans").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    edited_side, untouched_side = text.split("\n   :- ", 1)[1].split("\n   +- ", 1)
    assert "SortMergeJoin" in edited_side and "BroadcastHashJoin" in edited_side
    assert "SortMergeJoin" not in untouched_side and not re.search(r"Exchange hashpartitioning\(path", untouched_side)
    assert sorted(tuple(r) for r in rows) == [(0, 180), (1, 20)]


def test_chunk_arrays_are_not_evaluated_per_element(files):
    """The array of chunks is a column when lambdas look into it."""
    text = plan(chunking.chunks(document.plan_files(files), 80))
    for body in re.findall(r"lambdafunction\((.*)", text):
        assert "regexp_extract_all" not in body.split("AS ")[0]


def test_top_failures_are_a_top_k(files):
    planned, responses = responses_of(files)
    from glossmill.operators.summary import run_summary

    text = run_summary(document.document_corpus(planned, responses))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=5" in text
