"""The tree as a data source: slices, filters, and writing with a commit."""

import itertools
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull, Not, StringStartsWith

from glossmill.sources import source_tree
from glossmill.sources.source_tree import TreeReader, TreeWriter, commit_tree, list_names, open_tree
from glossmill.sources.tree import scan_tree
from tests.test_sources import FILES, KEPT, tree  # noqa: F401


def rows_of(reader, **limits):
    return [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]


@pytest.mark.parametrize("slices", [1, 3, 256])
def test_reads_what_the_scan_reads(spark, tree, slices):  # noqa: F811
    got = {r.path: (r.language, r.content, r.read_error) for r in open_tree(spark, str(tree), slices=slices).collect()}
    assert got == {r.path: (r.language, r.content, r.read_error) for r in scan_tree(spark, str(tree)).collect()}
    assert set(got) == KEPT
    names = list_names(spark, f"file://{tree}", slices=slices).collect()
    assert {r.path: r.size for r in names} == {p: len(FILES[p]) for p in KEPT} and "raw" not in names[0]
    other = open_tree(spark, str(tree), ("b", "_*", "dist/deep"), slices)
    assert {r.path for r in other.collect()} == {"__init__.py", ".hidden/Z.JS", "a/node_modules/x.js", "a/sp ace's é.css"}


@pytest.mark.parametrize(
    "wanted",
    ["language = 'python'", "extension in ('js', 'css')", "path like 'a/%'", "path = '_priv/_u.py'", "path in ('__init__.py', 'a/b/empty.ts') and size > 1",
     "path like 'a/b/c%' and language = 'java'", "language = 'java' and extension = 'css'", "not language = 'python'", "length(path) > 9", "extension = 'txt'"],
)
def test_filters_reach_the_listing(spark, tree, wanted, capsys):  # noqa: F811
    files = open_tree(spark, str(tree))
    found = files.where(wanted)
    assert {r.path for r in found.collect()} == {r.path for r in spark.createDataFrame(files.collect(), files.schema).where(wanted).collect()}
    found.explain("formatted")
    plan = capsys.readouterr().out
    if "size" not in wanted and "not" not in wanted and "length" not in wanted:
        assert "PushedFilters: [" in plan and "Filter (" not in plan
    if "size" in wanted or "length" in wanted:
        assert "Filter (" in plan


def reader_of(root, slices=8, raw=True):
    return TreeReader(str(root), ("dist", "node_modules"), slices, raw)


def test_folders_that_cannot_hold_what_is_wanted_are_not_entered(tree, monkeypatch):  # noqa: F811
    seen, entries = [], source_tree.Tree.entries
    monkeypatch.setattr(source_tree.Tree, "entries", lambda self, folder: seen.append(folder) or entries(self, folder))
    reader = reader_of(tree)
    rest = list(reader.pushFilters([StringStartsWith(("path",), "a/b/c"), IsNotNull(("path",)), Not(EqualTo(("size",), 1)), In(("extension",), ("java", "py"))]))
    assert [type(f) for f in rest] == [Not]
    assert [r["path"] for r in rows_of(reader)] == ["a/b/c/d/e.java"]
    assert set(seen) == {"", "a", "a/b", "a/b/c", "a/b/c/d"}


def test_a_large_folder_is_many_slices_and_a_stream(tmp_path, monkeypatch):
    for i in range(300):
        (tmp_path / f"f{i}.py").write_text(str(i))
        if i < 60:
            (tmp_path / f"d{i}").mkdir()
            (tmp_path / f"d{i}" / "x.js").write_text("x")
    monkeypatch.setattr(source_tree, "SLICE_FILES", 50)
    for folders in (source_tree.PLANNED_FOLDERS, 10):
        monkeypatch.setattr(source_tree, "PLANNED_FOLDERS", folders)
        for slices in (2, 8, 100):
            reader = reader_of(tmp_path, slices)
            parts = reader.partitions()
            paths = [r["path"] for r in rows_of(reader)]
            assert len(paths) == len(set(paths)) == 360 and len(parts) >= 6 - 3 * (folders == 10)
    # One batch after the other, however much is still to come.
    endless = lambda self, folder: ((f"g{i}.py", False, 0) for i in itertools.count())
    monkeypatch.setattr(source_tree.Tree, "entries", endless)
    batches = reader_of(tmp_path, raw=False).read(source_tree.Slice(""))
    assert next(batches).num_rows == next(batches).num_rows == source_tree.BATCH_ROWS


def test_what_cannot_be_read_is_a_row(spark, tree, monkeypatch):  # noqa: F811
    entries = source_tree.Tree.entries

    def with_gone_ones(self, folder):
        if folder == "":
            yield from [("gone.py", False, 3), ("gone", True, 0)]
        yield from entries(self, folder)

    monkeypatch.setattr(source_tree.Tree, "entries", with_gone_ones)
    for slices in (1, 50):
        rows = {r["path"]: r for r in rows_of(reader_of(tree, slices))}
        assert set(rows) == KEPT | {"gone.py", "gone"}
        assert rows["gone"]["language"] is None and "gone" in rows["gone"]["read_error"]
        assert rows["gone.py"]["raw"] is None and "gone.py" in rows["gone.py"]["read_error"]
    monkeypatch.undo()
    with pytest.raises(Exception, match="nowhere"):
        open_tree(spark, str(tree / "nowhere")).count()


def files_under(root):
    return sorted(os.path.relpath(os.path.join(where, name), root) for where, _, names in os.walk(root) for name in names)


def batch(*rows):
    return pa.RecordBatch.from_pylist([{"path": p, "content": c} for p, c in rows])


def test_all_files_or_none(spark, tmp_path):
    files = spark.range(200).select(F.concat(F.lit("d"), F.col("id") % 7, F.lit("/f"), F.col("id"), F.lit(".py")).alias("path"), F.lit("é\n").alias("content"))
    commit_tree(files.repartition(5), str(tmp_path / "out"))
    assert len(files_under(tmp_path)) == 200 and (tmp_path / "out" / "d3" / "f3.py").read_bytes() == "é\n".encode()
    failing = {
        "half": files.repartition(5).withColumn("content", F.when(F.col("path") == "d3/f3.py", F.raise_error(F.lit("broken"))).otherwise(F.col("content"))),
        "null": files.withColumn("content", F.when(F.col("path") != "d3/f3.py", F.col("content"))),
        "out of it": files.withColumn("path", F.when(F.col("path") == "d3/f3.py", "a/../../x.py").otherwise(F.col("path"))),
        "absolute": files.withColumn("path", F.concat(F.lit("/"), "path")),
    }
    for name, rows in failing.items():
        with pytest.raises(Exception, match="broken|no content|leaves the tree"):
            commit_tree(rows, str(tmp_path / name))
    assert sorted(os.listdir(tmp_path)) == ["out"]
    with pytest.raises(Exception, match="already exists"):
        commit_tree(files, str(tmp_path / "out"))
    commit_tree(files.limit(0), f"file://{tmp_path}/empty")
    assert os.listdir(tmp_path / "empty") == [] and len(files_under(tmp_path)) == 200


def test_a_task_that_runs_twice_writes_once(tmp_path):
    root = str(tmp_path / "deep" / "out")
    writer = TreeWriter(root, ["path", "content"])

    def killed():
        yield batch(("a/x.py", "1"), ("y.py", "2"))
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        writer.write(killed())
    assert not os.path.exists(root)
    done = [writer.write(iter([batch(("a/x.py", "1"), ("y.py", "2")), batch(("z.py", "3"))])), writer.write(iter([]))]
    assert not os.path.exists(root)
    writer.commit(done)
    assert files_under(tmp_path) == ["deep/out/a/x.py", "deep/out/y.py", "deep/out/z.py"] and os.listdir(tmp_path / "deep") == ["out"]


def test_a_target_that_is_taken_meanwhile(tmp_path):
    root = tmp_path / "out"
    writer = TreeWriter(str(root), ["path", "content"])
    done = [writer.write(iter([batch(("x.py", "1"))]))]
    root.mkdir()
    (root / "other").write_text("mine")
    with pytest.raises(FileExistsError):
        writer.commit(done)
    assert files_under(tmp_path) == ["out/other"]
    with pytest.raises(ValueError, match="columns path and content"):
        TreeWriter(str(tmp_path / "new"), ["path", "text"])
