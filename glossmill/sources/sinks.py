"""Writing results. A run never overwrites what it read."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame

from glossmill.config import RESULTS
from glossmill.sources.workspace import keep, root_opener


def _in_use(system: Any, base: str) -> bool:
    from pyarrow import fs

    found = system.get_file_info(base).type
    return found == fs.FileType.File or (found == fs.FileType.Directory and bool(system.get_file_info(fs.FileSelector(base))))


def write_table(files: DataFrame, path: str, rebalance: bool = False) -> None:
    """Parquet by language, at a place that does not exist yet.

    Each task writes a file of every language it meets. ``rebalance`` shuffles the
    rows by language first, into tasks of the session's advisory size that hold one
    language each or nearly so; a language that is most of the rows is split.
    """
    dealt = files.hint("rebalance", "language") if rebalance else files
    dealt.write.partitionBy("language").parquet(path)


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Write ``(path, content)`` as files under ``root``; returns ``(path, success, error)``.

    ``root`` is a folder or URI that every executor sees, and is refused if it
    holds anything. Each file is written
    under a name of its own and then moved into place, so a task that runs twice
    leaves whole files. The results are a written table: reading them does not
    write again.
    """

    open_root = root_opener(root)
    system, base = open_root()
    if _in_use(system, base):
        raise FileExistsError(f"{root} already exists")

    def write(frames: Iterator[Any]) -> Iterator[Any]:
        import posixpath
        import uuid

        import pandas as pd

        system, base = open_root()
        made = set()

        def put(path: str, content: str) -> None:
            if path.startswith("/") or ".." in path.split("/"):
                raise ValueError("path leaves the tree")
            raw = content.encode("utf-8")
            target = posixpath.join(base, path)
            folder = posixpath.dirname(target)
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            draft = posixpath.join(folder, f".{uuid.uuid4().hex}.part")
            with system.open_output_stream(draft) as stream:
                stream.write(raw)
            system.move(draft, target)

        for frame in frames:
            errors = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    put(path, content)
                    errors.append(None)
                except Exception as cause:  # noqa: BLE001 - one file's failure is its own
                    errors.append(str(cause) or type(cause).__name__)
            yield pd.DataFrame(
                {"path": frame["path"], "success": [e is None for e in errors], "error": errors}
            )

    return keep(files.select("path", "content").mapInPandas(write, RESULTS), "written")
