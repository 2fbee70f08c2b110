"""Strip comments from files as they arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from glossmill.config import JobConfig
from glossmill.plans.strip import strip_corpus

FILES = "path string, content string"


def strip_arriving(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    config: JobConfig = JobConfig(),
    mode: str = "lexical",
) -> StreamingQuery:
    """Start ``strip_corpus`` over parquet files of ``(path, content)`` that land
    in ``source``; takes what is there, appends to ``target`` and ends."""
    arriving = spark.readStream.schema(FILES).parquet(source)
    return (
        strip_corpus(arriving, config, mode)
        .writeStream.format("parquet")
        .partitionBy("language")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )
