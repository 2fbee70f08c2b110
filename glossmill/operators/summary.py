"""What a run did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

SUMMARY = "processed bigint, succeeded bigint, failed bigint, messages array<string>"


def _message() -> Column:
    return F.concat_ws(": ", "path", F.coalesce(F.nullif("error", F.lit("")), F.lit("unknown error")))


def _first_failures(results: DataFrame, first: int) -> DataFrame:
    failures = results.where(~F.col("success")).select(F.col("path").alias("failed_path"), _message().alias("message"))
    return failures.orderBy("failed_path", "message").limit(first)


def run_summary(results: DataFrame, first: int = 5) -> DataFrame:
    """One row ``(processed, succeeded, failed, messages)`` from
    ``(path, success, error)``; ``messages`` are the first failures by path.

    The failures are cut to ``first`` by a top-k before they are gathered, so
    they stay few however many files failed.
    """
    top = _first_failures(results, first)
    messages = top.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("failed_path", "message"))), lambda f: f["message"]
        ).alias("messages")
    )
    counts = results.agg(
        F.count("*").alias("processed"),
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
    )
    return counts.withColumn("messages", messages.scalar())


def observe_run(results: DataFrame) -> tuple[DataFrame, Observation]:
    """``results`` as it is, and what is seen of it when it is written: counts, and the first failure by path.

    The write counts as it goes: nothing is read for that. Hand on the frame to one write, without a shuffle between.
    """
    seen = Observation()
    failed = ~F.col("success")
    watched = results.observe(
        seen,
        F.count(F.lit(1)).alias("processed"),
        F.count_if("success").alias("succeeded"),
        F.count_if(failed).alias("failed"),
        F.min(F.when(failed, F.struct(F.col("path").alias("path"), _message().alias("message")))).alias("first"),
    )
    return watched, seen


def observed_summary(seen: Observation, written: DataFrame, first: int = 5) -> DataFrame:
    """``run_summary`` of rows that were written under observation.

    ``written`` is read only where more failures than the first one are to be named, and then their paths and
    errors only.
    """
    counts = seen.get
    messages = [counts["first"]["message"]] if counts["failed"] else []
    if min(first, counts["failed"]) > 1:
        messages = [r["message"] for r in _first_failures(written, first).collect()]
    row = (counts["processed"], counts["succeeded"], counts["failed"], messages[:first])
    return written.sparkSession.createDataFrame([row], SUMMARY)
