"""Strip comments from a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.config import JobConfig
from glossmill.functions.comments import strip_comments
from glossmill.operators.select import select_files
from glossmill.operators.summary import observe_run, observed_summary
from glossmill.sources.sinks import write_table
from glossmill.sources.tables import source_files


def strip_corpus(
    files: DataFrame,
    config: JobConfig = JobConfig(),
    mode: str = "lexical",
    docstrings: bool = False,
    scope: str = "strip_corpus",
) -> DataFrame:
    """``(path, language, content, changed)`` of ``(path, content | raw)`` files.

    Every step works on a row by itself: the job has no shuffle, and also runs on
    a stream.
    """
    chosen = select_files(source_files(files), scope, config.skip_patterns)
    stripped = chosen.select(
        "path",
        "language",
        F.col("content").alias("before"),
        strip_comments(F.col("content"), F.col("language"), mode, docstrings).alias("content"),
    )
    return stripped.select(
        "path", "language", "content", (~F.col("before").eqNullSafe(F.col("content"))).alias("changed")
    )


def strip_results(
    files: DataFrame,
    config: JobConfig = JobConfig(),
    mode: str = "lexical",
    docstrings: bool = False,
    scope: str = "strip_corpus",
) -> DataFrame:
    """``strip_corpus`` with ``success`` and ``error``: a file without content has
    failed, for its ``read_error`` if it has one."""
    chosen = select_files(source_files(files), scope, config.skip_patterns)
    reason = F.col("read_error") if "read_error" in chosen.columns else F.lit(None).cast("string")
    stripped = chosen.select(
        "path",
        "language",
        F.col("content").alias("before"),
        strip_comments(F.col("content"), F.col("language"), mode, docstrings).alias("content"),
        F.when(F.col("content").isNull(), F.coalesce(reason, F.lit("no content"))).alias("error"),
    )
    changed = ~F.col("before").eqNullSafe(F.col("content"))
    return stripped.select(
        "path", "language", "content", changed.alias("changed"), F.col("error").isNull().alias("success"), "error"
    )


def run_strip(files: DataFrame, target: str, config: JobConfig = JobConfig(), mode: str = "lexical", docstrings: bool = False) -> DataFrame:
    """Strip, write ``target/files`` by language, failures and all, and return the one-row summary, which the write counts."""
    results, seen = observe_run(strip_results(files, config, mode, docstrings))
    write_table(results, f"{target}/files")
    return observed_summary(seen, files.sparkSession.read.parquet(f"{target}/files"), first=1)
