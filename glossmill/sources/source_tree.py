"""A folder tree as a data source: ``spark.read.format("source_tree")``, and ``write`` with a commit.

Reading: the listing is cut into slices before it is made. A slice is a folder with
everything below it, or the files of one folder, or of either those whose names hash to
a number; its task lists it as a stream and opens what the filters leave. Nobody holds
the listing: the plan knows some folders, a task one open folder for each level.

Writing: tasks write whole files to a draft beside the target, under the files' own
names, so a task that runs twice leaves one file. The driver's commit moves the draft
into place at once; an abort removes it. A job that is killed leaves no target.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from glossmill.config import SKIP_PATTERNS
from glossmill.functions.languages import LANGUAGE_EXTENSIONS
from glossmill.functions.text import decode_utf8
from glossmill.operators.select import glob_regex
from glossmill.sources.workspace import root_opener

FORMAT = "source_tree"
LISTED = "path string, extension string, language string, size bigint"
#: Slices that a plan aims at, files of one folder that are one slice, subfolders that a plan takes apart.
SLICES, SLICE_FILES, PLANNED_FOLDERS = 256, 20_000, 4_096
#: Rows and bytes that a task hands over at a time.
BATCH_ROWS, BATCH_BYTES = 1_000, 32 << 20

_LANGUAGE_OF = {extension: language for language, group in LANGUAGE_EXTENSIONS.items() for extension in group}
_EXTENSION = re.compile(r"[^/]\.([^./]*)\Z")


def extension_of(path: str) -> str:
    found = _EXTENSION.search(path)
    return found[1].lower() if found else ""


@dataclass
class Slice(InputPartition):
    """Entries of ``folder`` whose names hash to ``part`` of ``parts``; ``below``: its subfolders' files too."""

    folder: str
    part: int = 0
    parts: int = 1
    below: bool = True

    def holds(self, name: str) -> bool:
        return self.parts == 1 or zlib.crc32(name.encode("utf-8", "surrogateescape")) % self.parts == self.part


class Tree:
    """Folders of a tree, listed as streams."""

    def __init__(self, root: str, skip: Iterable[str]):
        self.system, self.base = root_opener(root)()
        folders = "|".join(glob_regex(p.strip("/")) for p in skip if p.strip("/"))
        self.skipped = re.compile(rf"(?:\A|/)(?:{folders})/") if folders else re.compile(r"(?!)")

    def entries(self, folder: str) -> Iterator[tuple[str, bool, int]]:
        """``(name, is folder, size)`` of what a folder holds; links to folders are left out."""
        import os

        from pyarrow import fs

        where = posixpath.join(self.base, folder) if folder else self.base
        if not isinstance(self.system, fs.LocalFileSystem):
            for info in self.system.get_file_info(fs.FileSelector(where)):
                yield info.base_name, info.type == fs.FileType.Directory, info.size or 0
            return
        with os.scandir(where) as listing:
            for entry in listing:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.name, True, 0
                elif entry.is_file():
                    try:
                        yield entry.name, False, entry.stat().st_size
                    except OSError:  # gone since; reading it says so
                        yield entry.name, False, 0

    def enters(self, folder: str) -> bool:
        return not self.skipped.search(folder + "/")


class TreeReader(DataSourceReader):
    def __init__(self, root: str, skip: tuple[str, ...], slices: int, with_raw: bool):
        self.root, self.skip, self.slices, self.with_raw = root, skip, slices, with_raw
        self.languages, self.extensions = set(LANGUAGE_EXTENSIONS), set(_LANGUAGE_OF)
        self.paths: set[str] | None = None
        self.prefixes: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and ``in`` on language, extension and path, and what a path starts with."""
        for one in filters:
            attribute = getattr(one, "attribute", ())
            column = attribute[0] if len(attribute) == 1 else ""
            if isinstance(one, EqualTo | In):
                values = {one.value} if isinstance(one, EqualTo) else set(one.value)
                if column == "language":
                    self.languages &= values
                elif column == "extension":
                    self.extensions &= values
                elif column == "path":
                    self.paths = values if self.paths is None else self.paths & values
                else:
                    yield one
            elif isinstance(one, StringStartsWith) and column == "path":
                self.prefixes.append(one.value)
            elif not (isinstance(one, IsNotNull) and column in ("path", "language", "extension", "size")):
                yield one

    def _wanted(self, path: str) -> bool:
        extension = extension_of(path)
        return (
            extension in self.extensions
            and _LANGUAGE_OF[extension] in self.languages
            and (self.paths is None or path in self.paths)
            and all(path.startswith(p) for p in self.prefixes)
        )

    def _leads_on(self, folder: str) -> bool:
        """Whether a folder may hold what is wanted."""
        inside = folder + "/"
        return all(inside.startswith(p) or p.startswith(inside) for p in self.prefixes) and (
            self.paths is None or any(p.startswith(inside) for p in self.paths)
        )

    def partitions(self) -> list[Slice]:
        """Takes folders apart, the uppermost first, until there are slices enough."""
        tree, out, queue = Tree(self.root, self.skip), [], deque([""])
        while queue and len(queue) + len(out) < self.slices:
            folder, files, folders, below = queue.popleft(), 0, 0, []
            try:
                for name, is_folder, _ in tree.entries(folder):
                    path = posixpath.join(folder, name)
                    if not is_folder:
                        files += 1
                    elif tree.enters(path) and self._leads_on(path):
                        folders += 1
                        if folders <= PLANNED_FOLDERS:
                            below.append(path)
            except OSError:
                if not folder:
                    raise
                # Its task says so, in a row.
                out.append(Slice(folder))
                continue
            parts = -(-files // SLICE_FILES)
            if folders > PLANNED_FOLDERS:
                parts = max(parts, min(self.slices, folders // 16))
                out += [Slice(folder, part, parts) for part in range(parts)]
            else:
                out += [Slice(folder, part, parts, below=False) for part in range(parts)]
                queue.extend(below)
        return out + [Slice(folder) for folder in queue]

    def _files(self, tree: Tree, one: Slice) -> Iterator[tuple[str, int, str | None]]:
        """``(path, size, error)`` of the files of a slice; a folder that cannot be listed is one of them."""
        opened = [(one.folder, tree.entries(one.folder))]
        while opened:
            folder, entries = opened[-1]
            try:
                name, is_folder, size = next(entries)
            except StopIteration:
                opened.pop()
                continue
            except OSError as cause:
                opened.pop()
                yield folder, 0, str(cause) or type(cause).__name__
                continue
            if len(opened) == 1 and not one.holds(name):
                continue
            path = posixpath.join(folder, name)
            if not is_folder:
                if self._wanted(path):
                    yield path, size, None
            elif one.below and tree.enters(path) and self._leads_on(path):
                opened.append((path, tree.entries(path)))

    def read(self, partition: Slice) -> Iterator[Any]:
        import pyarrow as pa

        tree, rows, held = Tree(self.root, self.skip), [], 0
        names = ["path", "extension", "language", "size", "raw", "read_error"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        if not self.with_raw:
            names, kinds = [n for n in names if n != "raw"], [*kinds[:4], kinds[5]]

        def batch() -> Any:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for path, size, error in self._files(tree, partition):
            raw = None
            if error is None and self.with_raw:
                try:
                    with tree.system.open_input_stream(posixpath.join(tree.base, path), compression=None) as stream:
                        raw = stream.read()
                except Exception as cause:  # noqa: BLE001 - one file's failure is its own
                    error = str(cause) or type(cause).__name__
            extension = extension_of(path)
            row = [path, extension, _LANGUAGE_OF.get(extension), size, raw, error]
            rows.append(row if self.with_raw else [*row[:4], error])
            held += len(raw or b"")
            if len(rows) == BATCH_ROWS or held >= BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    files: int


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, root: str, names: list[str]):
        if not {"path", "content"} <= set(names):
            raise ValueError("a tree is written from the columns path and content")
        self.root = root.rstrip("/")
        system, base = root_opener(self.root)()
        if _holds_anything(system, base):
            raise FileExistsError(f"{self.root} already exists")
        #: Beside the target, so that the move stays within one file system.
        self.draft = f"{base}.draft-{uuid.uuid4().hex}"
        system.create_dir(posixpath.join(self.draft, "parts"), recursive=True)
        system.create_dir(posixpath.join(self.draft, "tree"), recursive=True)

    def write(self, iterator: Iterator[Any]) -> Written:
        system, _ = root_opener(self.root)()
        made, files = {posixpath.join(self.draft, "tree")}, 0

        def make(folder: str) -> None:
            # Step by step: a task that outlives its job must not bring back a draft that was removed.
            if folder not in made:
                make(posixpath.dirname(folder))
                system.create_dir(folder, recursive=False)
                made.add(folder)

        for batch in iterator:
            columns = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("path", "content"))
            for path, content in zip(*columns):
                if path is None or content is None:
                    raise ValueError(f"{path}: no path or no content")
                if path.startswith("/") or {"", ".", ".."} & set(path.split("/")):
                    raise ValueError(f"{path}: path leaves the tree")
                target = posixpath.join(self.draft, "tree", path)
                make(posixpath.dirname(target))
                part = posixpath.join(self.draft, "parts", uuid.uuid4().hex)
                with system.open_output_stream(part, compression=None) as stream:
                    stream.write(content.encode("utf-8"))
                system.move(part, target)
                files += 1
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = root_opener(self.root)()
        if _holds_anything(system, base):
            self.abort(messages)
            raise FileExistsError(f"{self.root} already exists")
        system.move(posixpath.join(self.draft, "tree"), base)
        system.delete_dir(self.draft)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, _ = root_opener(self.root)()
        if system.get_file_info(self.draft).type == fs.FileType.Directory:
            system.delete_dir(self.draft)


def _holds_anything(system: Any, base: str) -> bool:
    from pyarrow import fs

    found = system.get_file_info(base).type
    return found == fs.FileType.File or (found == fs.FileType.Directory and bool(system.get_file_info(fs.FileSelector(base))))


class SourceTree(DataSource):
    """Options: ``path``; ``skip``, folder patterns joined by a line end; ``slices``; ``raw`` (false: names only)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _with_raw(self) -> bool:
        return self.options.get("raw", "true").lower() != "false"

    def schema(self) -> str:
        return f"{LISTED}{', raw binary' if self._with_raw() else ''}, read_error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        skip = tuple(self.options.get("skip", "\n".join(SKIP_PATTERNS)).split("\n"))
        return TreeReader(self.options["path"], skip, int(self.options.get("slices", SLICES)), self._with_raw())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a tree is written to a new place only")
        return TreeWriter(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, which then hands filters down to sources written in python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)


def open_tree(spark: SparkSession, root: str, skip_patterns: Iterable[str] = SKIP_PATTERNS, slices: int = SLICES) -> DataFrame:
    """``(path, extension, language, size, content, read_error)`` of the supported files under ``root``.

    Filters on language, extension and path are applied to names, before a file is opened. A file that cannot be
    read, or a folder that cannot be listed, is a row with its ``read_error`` and null ``content``; a root that
    cannot be listed is an error.
    """
    register(spark)
    files = spark.read.format(FORMAT).option("skip", "\n".join(skip_patterns)).option("slices", slices).load(root)
    return files.select("path", "extension", "language", "size", decode_utf8(F.col("raw")).alias("content"), "read_error")


def list_names(spark: SparkSession, root: str, skip_patterns: Iterable[str] = SKIP_PATTERNS, slices: int = SLICES) -> DataFrame:
    """``open_tree`` without the files' contents; none is opened."""
    register(spark)
    return spark.read.format(FORMAT).option("raw", "false").option("skip", "\n".join(skip_patterns)).option("slices", slices).load(root)


def commit_tree(files: DataFrame, root: str) -> None:
    """Write ``(path, content)`` as files under ``root``: all of them, or none.

    ``root`` is a folder or URI that every executor and the driver see, and must hold nothing. A path that leaves
    the tree, or a null, fails the job. Of several rows with one path any one is written.
    """
    register(files.sparkSession)
    files.select("path", "content").write.format(FORMAT).mode("append").save(root)
