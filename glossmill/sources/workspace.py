"""The shared folder for tables that outlive a stage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the session's checkpoint folder.

    A cluster names a folder that every executor sees. Only where none is set,
    as in a local test, one is made on this machine.
    """
    context = spark.sparkContext
    base = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor sees")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="glossmill-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/glossmill-{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage: a task that is lost later reads the table, it does not run
    what made it again. That matters for model calls above all. ``compression`` is
    the session's own unless it is given.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def root_opener(root: str) -> Callable[[], tuple[Any, str]]:
    """For use in a task: opens a folder or URI as ``(file system, base path)``."""

    def open_root() -> tuple[Any, str]:
        from pyarrow import fs

        if "://" in root or root.startswith("file:"):
            uri = root if "://" in root else "file://" + root.removeprefix("file:")
            return fs.FileSystem.from_uri(uri)
        return fs.LocalFileSystem(), root

    return open_root
