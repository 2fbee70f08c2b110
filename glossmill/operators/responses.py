"""Model responses: running a caller's model, and answers back into files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.config import RESPONSES, JobConfig
from glossmill.functions.text import js_trim, strip_code_fences, utf16_length
from glossmill.operators.chunks import chunk_edges
from glossmill.operators.review import length_guard


def generate(requests: DataFrame, answer: Callable[[Any], Any], batch_size: int = 16) -> DataFrame:
    """``(path, chunk_index, output, error)`` by calling ``answer`` on batches.

    ``answer`` takes a pandas frame of request rows and returns one text, None or
    exception per row. If it raises, the rows of that batch are tried one by one,
    so only those at fault end with an ``error``. Waiting between calls, retries
    and keys are its own business.

    No call needs another's result: a partition's requests run one after the
    other, partitions side by side, and ``chunks.deal`` sets how many there are.
    Write the result with ``sources.workspace.keep`` before using it, or a lost
    task calls the model again.
    """

    def run(frames: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        def failure(cause: Exception) -> tuple[None, str]:
            return None, str(cause) or type(cause).__name__

        def outcome(batch: Any) -> list[tuple[str | None, str | None]]:
            try:
                answers = list(answer(batch))
                if len(answers) != len(batch):
                    raise ValueError(f"{len(answers)} answers to {len(batch)} requests")
            except Exception as cause:  # noqa: BLE001 - any failure is that row's error
                if len(batch) == 1:
                    return [failure(cause)]
                return [pair for i in range(len(batch)) for pair in outcome(batch.iloc[i : i + 1])]
            return [failure(a) if isinstance(a, Exception) else (a, None) for a in answers]

        for frame in frames:
            known = frame["messages"].notna() | frame["prompt"].notna()
            for name, rows in (("known", frame[known]), ("unknown", frame[~known])):
                for start in range(0, len(rows), batch_size):
                    batch = rows.iloc[start : start + batch_size]
                    if name == "known":
                        pairs = outcome(batch)
                    else:
                        pairs = [(None, f"unknown provider: {p}") for p in batch["provider"]]
                    yield pd.DataFrame(
                        {
                            "path": batch["path"].to_numpy(),
                            "chunk_index": batch["chunk_index"].to_numpy(),
                            "output": [output for output, _ in pairs],
                            "error": [error for _, error in pairs],
                        }
                    )

    return requests.mapInPandas(run, RESPONSES)


def normalise_output(output: Column) -> Column:
    """Trimmed output; a missing one reads as empty."""
    return F.coalesce(js_trim(output), F.lit(""))


def file_results(responses: DataFrame) -> DataFrame:
    """``(path, success, error)``: one failed chunk fails its file, the first
    failed chunk's message stands for it."""
    failed = F.col("error").isNotNull()
    # A chunk has failed if no response to it is an answer.
    tried = responses.groupBy("path", "chunk_index").agg(
        F.when(F.bool_and(failed), F.min("error")).alias("error")
    )
    return tried.groupBy("path").agg(
        F.bool_and(~failed).alias("success"),
        F.min_by("error", F.when(failed, F.col("chunk_index"))).alias("error"),
    )


def gather(responses: DataFrame) -> DataFrame:
    """``(path, answers)``, a file's responses in chunk order.

    A set, so copies of one response collapse before the shuffle. Of several
    responses to one chunk an answer comes before an error, then the least text.
    """
    response = F.struct("chunk_index", F.col("error").isNotNull().alias("failed"), "output", "error")
    grouped = responses.groupBy("path").agg(F.array_sort(F.collect_set(response)).alias("answers"))

    def first_of_chunk(answer: Column, index: Column) -> Column:
        before = F.get(F.col("answers"), index - 1)["chunk_index"]
        return (index == 0) | (before != answer["chunk_index"])

    return grouped.withColumn("answers", F.filter("answers", first_of_chunk))


def sources_of(files: DataFrame, config: JobConfig, *keep: str) -> DataFrame:
    """What assembling needs of the source files: ``(path, language, *keep, n_chunks, source_length)`` and their edges, if asked for."""
    source = chunk_edges(files, config.min_lines, config.preserve_edges, config.max_lines)
    columns = ["path", "language", *keep, "n_chunks"] + (["edges"] if config.preserve_edges else [])
    return source.select(*columns, utf16_length(js_trim(F.col("content"))).alias("source_length"))


def assemble(files: DataFrame, responses: DataFrame, config: JobConfig, *keep: str) -> DataFrame:
    """Documented files ``(path, language, *keep, success, error, accepted, output)``.

    Responses are shuffled once, by path. Of the source only what the result
    needs goes along: its length, its number of chunks and ``keep``. A blank file
    succeeds without output. ``accepted`` marks outputs to write; the others
    failed, or are too short to be trusted.
    """
    return judged(sources_of(files, config, *keep).join(gather(responses), "path", "left"), config, *keep)


def judged(joined: DataFrame, config: JobConfig, *keep: str) -> DataFrame:
    """``assemble``'s rows from those of ``sources_of`` beside a file's ``answers``. Works inside the row."""
    answers = F.col("answers")
    blank = F.col("source_length") == 0
    first_error = F.get(F.filter(answers, lambda a: a["error"].isNotNull()), F.lit(0))["error"]
    complete = F.transform(answers, lambda a: a["chunk_index"]) == F.sequence(F.lit(0), F.col("n_chunks") - 1)
    error = (
        F.when(blank, F.lit(None).cast("string"))
        .when(answers.isNull(), F.lit("no response"))
        .when(first_error.isNotNull(), first_error)
        .when(~complete, F.lit("responses do not match the chunks"))
    )

    def piece(answer: Column, index: Column) -> Column:
        text = normalise_output(answer["output"])
        if config.per_chunk_fences:
            text = strip_code_fences(text)
        if config.preserve_edges:
            edge = F.get(F.col("edges"), index)
            text = F.concat(edge["lead"], text, edge["trail"])
        return text

    text = F.array_join(F.transform(answers, piece), "\n")
    if not config.per_chunk_fences:
        text = strip_code_fences(text)
    done = joined.withColumn("error", error).withColumn("output", F.when(F.col("error").isNull() & ~blank, text))
    guard = F.lit(True)
    if config.guard_ratio is not None:
        guard = length_guard(F.col("source_length"), utf16_length(js_trim(F.col("output"))), config.guard_ratio)
    return done.select(
        "path",
        "language",
        *keep,
        F.col("error").isNull().alias("success"),
        "error",
        (F.col("output").isNotNull() & guard).alias("accepted"),
        "output",
    )
