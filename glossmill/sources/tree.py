"""A folder tree as a table.

Spark's file sources hide names that start with ``_`` or ``.``, and with them
every ``__init__.py``. This one lists and reads all files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.config import SKIP_PATTERNS
from glossmill.functions.languages import detect_language
from glossmill.operators.select import in_skipped_folder
from glossmill.sources.tables import source_files
from glossmill.sources.workspace import root_opener, work_dir

LISTING = "path string, is_folder boolean, size long, read_error string"
LISTED_ROWS = 10_000
READ_BYTES = 128 << 20
READ_FILES = 20_000
BATCH_BYTES = 32 << 20


def _list_folders(root: str) -> Callable[[Iterator[Any]], Iterator[Any]]:
    open_root = root_opener(root)

    def run(frames: Iterator[Any]) -> Iterator[Any]:
        import os
        import posixpath

        import pandas as pd
        from pyarrow import fs

        system, base = open_root()

        def size_of(entry: os.DirEntry) -> int:
            try:
                return entry.stat().st_size
            except OSError:  # gone since; reading it says so
                return 0

        def entries(folder: str) -> Iterator[tuple[str, bool, int]]:
            where = posixpath.join(base, folder) if folder else base
            if isinstance(system, fs.LocalFileSystem):
                with os.scandir(where) as listing:
                    for entry in listing:
                        path = posixpath.join(folder, entry.name)
                        if entry.is_dir(follow_symlinks=False):
                            yield path, True, 0
                        elif entry.is_file():
                            yield path, False, size_of(entry)
            else:
                for info in system.get_file_info(fs.FileSelector(where)):
                    path = posixpath.join(folder, info.base_name)
                    yield path, info.type == fs.FileType.Directory, info.size or 0

        def frame_of(rows: list[tuple[str, bool, int, str | None]]) -> Any:
            return pd.DataFrame(rows, columns=["path", "is_folder", "size", "read_error"])

        for frame in frames:
            for folder in frame["path"]:
                rows = []
                try:
                    for entry in entries(folder):
                        rows.append((*entry, None))
                        if len(rows) == LISTED_ROWS:
                            yield frame_of(rows)
                            rows = []
                except OSError as cause:
                    if not folder:
                        raise
                    rows.append((folder, True, 0, str(cause) or type(cause).__name__))
                if rows:
                    yield frame_of(rows)

    return run


def list_tree(spark: SparkSession, root: str, skip_patterns: Iterable[str] = SKIP_PATTERNS) -> DataFrame:
    """``(path, language, size, read_error)`` of the supported files under ``root``.

    A folder below it that cannot be listed, or is gone by then, is a row too, with
    its ``read_error`` and no language; a root that cannot be listed is an error.

    Folders are listed level by level, each level by as many tasks as it has
    folders to share out, and skipped folders are never entered. The driver only
    counts folders; names stay in a written table, one part per level. Symbolic
    links to folders are not followed.
    """
    patterns = tuple(skip_patterns)
    table = work_dir(spark, "listing")
    width = 4 * spark.sparkContext.defaultParallelism
    folders, count, level = spark.createDataFrame([("",)], "path string"), 1, 0
    while count:
        part = f"{table}/level={level}"
        folders.repartition(min(count, width)).mapInPandas(_list_folders(root), LISTING).write.parquet(part)
        entries = spark.read.schema(LISTING).parquet(part)
        below = F.concat("path", F.lit("/"))
        listable = F.col("is_folder") & F.col("read_error").isNull()
        folders = entries.where(listable & ~in_skipped_folder(below, patterns)).select("path")
        count, level = folders.count(), level + 1
    return (
        spark.read.schema(LISTING)
        .parquet(*[f"{table}/level={i}" for i in range(level)])
        .where(~F.col("is_folder") | F.col("read_error").isNotNull())
        .select("path", F.when(~F.col("is_folder"), detect_language(F.col("path"))).alias("language"), "size", "read_error")
        .where("language is not null or read_error is not null")
    )


def read_files(listing: DataFrame, root: str) -> DataFrame:
    """``(path, language, content, read_error)`` of listed files.

    Files are dealt out over as many tasks as their sizes and their number ask for.
    Every listed file gives a row: one that cannot be read has its ``read_error``,
    and a row that has one already keeps it.
    """
    open_root = root_opener(root)

    def run(frames: Iterator[Any]) -> Iterator[Any]:
        import posixpath

        import pandas as pd

        system, base = open_root()

        def read(path: str) -> tuple[str, bytes | None, str | None]:
            try:
                with system.open_input_stream(posixpath.join(base, path), compression=None) as stream:
                    return path, stream.read(), None
            except Exception as cause:  # noqa: BLE001 - one file's failure is its own
                return path, None, str(cause) or type(cause).__name__

        def frame_of(rows: list[tuple[str, bytes | None, str | None]]) -> Any:
            return pd.DataFrame(rows, columns=["path", "raw", "read_error"])

        rows, size = [], 0
        for frame in frames:
            for path in frame["path"]:
                rows.append(read(path))
                size += len(rows[-1][1] or b"")
                if size >= BATCH_BYTES:
                    yield frame_of(rows)
                    rows, size = [], 0
        if rows:
            yield frame_of(rows)

    cores = listing.sparkSession.sparkContext.defaultParallelism
    if "read_error" not in listing.columns:
        listing = listing.withColumn("read_error", F.lit(None).cast("string"))
    there = listing.where("read_error is null")
    total, number = there.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    dealt = there.select("path").repartition(max(cores, -(-total // READ_BYTES), -(-number // READ_FILES)))
    raw = dealt.mapInPandas(run, "path string, raw binary, read_error string")
    read = source_files(raw).select("path", "language", "content", "read_error")
    not_listed = listing.where("read_error is not null")
    return read.unionByName(not_listed.select("path", "language", F.lit(None).cast("string").alias("content"), "read_error"))


def scan_tree(spark: SparkSession, root: str, skip_patterns: Iterable[str] = SKIP_PATTERNS) -> DataFrame:
    """List, then read: only surviving files are opened."""
    return read_files(list_tree(spark, root, skip_patterns), root)
