"""Document a corpus, or selections of its files."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.config import SELECTION_RATIO, JobConfig
from glossmill.functions.text import strip_code_fences
from glossmill.operators.chunks import chunks, deal
from glossmill.operators.edits import apply_spans, extract_selections
from glossmill.operators.requests import build_requests
from glossmill.operators.responses import assemble, generate, normalise_output
from glossmill.operators.review import line_changes, long_enough, review
from glossmill.operators.select import not_blank, select_files
from glossmill.operators.store import ask
from glossmill.operators.summary import observe_run, observed_summary
from glossmill.sources.sinks import write_table
from glossmill.sources.tables import source_files
from glossmill.sources.workspace import keep


CHANGES = ("lines_added", "lines_removed", "changed")


def plan_files(files: DataFrame, config: JobConfig = JobConfig()) -> DataFrame:
    """The files of ``(path, content | raw)`` a run documents."""
    return select_files(source_files(files), "generate", config.skip_patterns)


def corpus_requests(planned: DataFrame, config: JobConfig = JobConfig()) -> DataFrame:
    """Requests for every chunk of ``plan_files`` rows. No shuffle."""
    return build_requests(_corpus_chunks(planned, config), config)


def _corpus_chunks(planned: DataFrame, config: JobConfig) -> DataFrame:
    return chunks(not_blank(planned), config.min_lines, "language", max_lines=config.max_lines)


def document_corpus(planned: DataFrame, responses: DataFrame, config: JobConfig = JobConfig()) -> DataFrame:
    """``(path, language, success, error, accepted, output)`` from ``plan_files``
    rows and the responses to ``corpus_requests``, which come from a batch run
    elsewhere or from ``operators.responses.generate``.
    """
    return assemble(planned, responses, config)


def review_corpus(planned: DataFrame, responses: DataFrame, config: JobConfig = JobConfig()) -> DataFrame:
    """``(path, before, after, lines_added, lines_removed, changed)`` of the
    accepted files, to look at before they are written."""
    return _changes(assemble(planned, responses, config, "content"))


def _changes(done: DataFrame) -> DataFrame:
    accepted = done.where("accepted")
    return review(accepted.select("path", F.col("content").alias("before"), F.col("output").alias("after")))


def run_corpus(
    files: DataFrame,
    answer: Callable[[Any], Any],
    target: str,
    config: JobConfig = JobConfig(),
    store: str | None = None,
) -> DataFrame:
    """The whole run. Writes ``target/files`` and, if the config asks for it,
    ``target/review``, the line counts of accepted files; returns the one-row summary.

    Responses are written before they are used, so no retry calls the model
    twice, and every later step reads the written files. With ``store``, a folder of
    answers that runs share, only requests that it has no answer to are sent, equal ones once.
    """
    spark = files.sparkSession
    planned = plan_files(files, config)
    if store is None:
        dealt = deal(_corpus_chunks(planned, config), config.generate_partitions)
        responses = keep(generate(build_requests(dealt, config), answer), "responses")
    else:
        responses = ask(corpus_requests(planned, config), answer, store, partitions=config.generate_partitions)
    if config.review:
        assembled = _with_changes(assemble(planned, responses, config, "content"))
    else:
        assembled = assemble(planned, responses, config)
    assembled, seen = observe_run(assembled)
    write_table(assembled, f"{target}/files")
    done = spark.read.parquet(f"{target}/files")
    if config.review:
        done.where("accepted").select("path", *CHANGES).write.parquet(f"{target}/review")
    return observed_summary(seen, done)


def _with_changes(done: DataFrame) -> DataFrame:
    """Line counts in place of the source text, which is not stored again."""
    counted = done.withColumn("changes", F.when(F.col("accepted"), line_changes(F.col("content"), F.col("output"))))
    return counted.select(
        *(c for c in done.columns if c != "content"),
        "changes.lines_added",
        "changes.lines_removed",
        F.when(F.col("accepted"), ~F.col("content").eqNullSafe(F.col("output"))).alias("changed"),
    )


def publish(done: DataFrame, approvals: DataFrame, target: str) -> None:
    """Write the accepted outputs of ``done`` that ``approvals`` names by ``path``,
    as ``(path, language, content)`` by language, at a new place."""
    approved = done.where("accepted").join(approvals.select("path").distinct(), "path", "left_semi")
    write_table(approved.select("path", "language", F.col("output").alias("content")), target)


def selection_requests(
    files: DataFrame, selections: DataFrame, config: JobConfig = JobConfig()
) -> DataFrame:
    """One request per selection, never chunked; its start stands as chunk index."""
    picked = extract_selections(files, selections, "language").where(F.col("language").isNotNull())
    return build_requests(picked.withColumn("chunk_index", F.col("start")), config)


def document_selections(
    files: DataFrame,
    selections: DataFrame,
    responses: DataFrame,
    ratio: float = SELECTION_RATIO,
) -> DataFrame:
    """``(path, content, n_spans, applied)``: accepted answers put in place of
    the selections they answer; files without any stay as they are. An answer is
    judged beside the text it replaces, so the files are shuffled once. Of several
    answers to one selection the least text counts; selections that overlap, those
    with one start among them, leave their file as it is."""
    answered = responses.where(F.col("error").isNull()).select(
        "path",
        F.col("chunk_index").alias("start"),
        strip_code_fences(normalise_output(F.col("output"))).alias("replacement"),
    )
    answers = answered.groupBy("path", "start").agg(F.min("replacement").alias("replacement"))
    chosen = selections.where(F.col("end") > F.col("start"))
    spans = chosen.join(answers, ["path", "start"]).select("path", "start", "end", "replacement")
    return apply_spans(files, spans, lambda before, after: long_enough(before, after, ratio))
