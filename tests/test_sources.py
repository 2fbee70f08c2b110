"""Trees of files in and out, the shared folder, the stream."""

import os

import pytest
from pyspark.sql import functions as F

from glossmill.config import RESULTS
from glossmill.plans.strip import strip_corpus
from glossmill.sources.sinks import write_table, write_tree
from glossmill.sources.tree import list_tree, read_files, scan_tree
from glossmill.sources.workspace import keep, work_dir
from glossmill.streaming.strip import strip_arriving

FILES = {
    "__init__.py": b"x = 1\n",
    "_priv/_u.py": b"y",
    ".hidden/Z.JS": b"\xef\xbb\xbfz\xff",
    "a/b/c/d/e.java": b"class A {}",
    "a/b/empty.ts": b"",
    "a/node_modules/x.js": b"no",
    "a/dist/deep/x.js": b"no",
    "a/Makefile": b"no",
    "a/.js": b"no",
    "a/sp ace's é.css": b"b{}",
}
KEPT = {"__init__.py", "_priv/_u.py", ".hidden/Z.JS", "a/b/c/d/e.java", "a/b/empty.ts", "a/sp ace's é.css"}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for path, raw in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(raw)
    os.symlink(root / "a", root / "a" / "loop")
    return root


@pytest.mark.parametrize("prefix", ["", "file://"])
def test_scan(spark, tree, prefix):
    root = f"{prefix}{tree}"
    listing = list_tree(spark, root)
    assert {r.path: r.size for r in listing.collect()} == {p: len(FILES[p]) for p in KEPT}
    got = {r.path: r for r in read_files(listing, root).collect()}
    assert set(got) == KEPT and all(r.read_error is None for r in got.values())
    assert got[".hidden/Z.JS"].content == "z�" and got[".hidden/Z.JS"].language == "javascript"
    assert got["a/b/empty.ts"].content == "" and got["__init__.py"].content == "x = 1\n"


def test_scan_with_other_patterns(spark, tree):
    got = {r.path for r in scan_tree(spark, str(tree), ("b", "_*", "dist/deep")).collect()}
    assert got == {"__init__.py", ".hidden/Z.JS", "a/node_modules/x.js", "a/sp ace's é.css"}


def test_a_file_that_vanishes_is_a_row(spark, tree):
    listing = list_tree(spark, str(tree))
    os.remove(tree / "_priv" / "_u.py")
    got = {r.path: r for r in read_files(listing, str(tree)).collect()}
    assert set(got) == KEPT
    assert got["_priv/_u.py"].content is None and "_u.py" in got["_priv/_u.py"].read_error


def test_a_folder_that_cannot_be_listed_is_a_row(spark, tree, monkeypatch):
    from glossmill.sources import tree as module

    def with_a_gone_folder(root):
        run = list_folders(root)

        def listed(frames):
            import pandas as pd

            def more():
                for frame in frames:
                    top = "" in set(frame["path"])
                    yield pd.concat([frame, pd.DataFrame({"path": ["gone.py"]})]) if top else frame

            return run(more())

        return listed

    list_folders = module._list_folders
    monkeypatch.setattr(module, "_list_folders", with_a_gone_folder)
    got = {r.path: r for r in scan_tree(spark, str(tree)).collect()}
    assert set(got) == KEPT | {"gone.py"}
    assert got["gone.py"].language is None and got["gone.py"].content is None and "gone.py" in got["gone.py"].read_error
    monkeypatch.undo()
    with pytest.raises(Exception, match="nowhere"):
        list_tree(spark, str(tree / "nowhere")).count()


def test_write_table_in_few_files(spark, tmp_path):
    rows = spark.range(400).select(F.concat(F.lit("p"), "id").alias("path"), F.concat(F.lit("l"), F.col("id") % 3).alias("language"), F.lit("x").alias("content"))
    for rebalance in (False, True):
        write_table(rows.repartition(4), str(tmp_path / str(rebalance)), rebalance)
    files = {flag: len(list((tmp_path / flag).rglob("*.parquet"))) for flag in ("False", "True")}
    assert files["True"] == 3 < files["False"] and spark.read.parquet(str(tmp_path / "True")).count() == 400


def test_write_tree(spark, tmp_path):
    rows = [("a/b.py", "é\n"), ("../x.py", "no"), ("/y.py", "no"), ("n.py", None)]
    files = spark.createDataFrame(rows, "path string, content string")
    results = write_tree(files, str(tmp_path / "out"))
    assert results.dtypes == [(f.name, f.dataType.simpleString()) for f in RESULTS]
    got = {r.path: (r.success, r.error) for r in results.collect()}
    assert got["a/b.py"] == (True, None) and got["../x.py"] == got["/y.py"] == (False, "path leaves the tree")
    assert not got["n.py"][0]
    assert [str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()] == ["out/a/b.py"]
    assert (tmp_path / "out" / "a" / "b.py").read_bytes() == "é\n".encode()


def test_write_table_never_overwrites(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "x # y\n"), ("b.c", "z // y\n")], "path string, content string")
    target = str(tmp_path / "out")
    write_table(strip_corpus(files), target)
    got = {r.path: (r.language, r.content) for r in spark.read.parquet(target).collect()}
    assert got == {"a.py": ("python", "x\n"), "b.c": ("c", "z\n")}
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        write_table(strip_corpus(files), target)


def test_work_dir_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    base = named or spark.sparkContext.getCheckpointDir()
    own = work_dir(spark, "x")
    assert own.startswith(f"{base.rstrip('/')}/glossmill-x-") and own != work_dir(spark, "x")
    kept = keep(spark.range(3), "x")
    assert kept.count() == 3 and all(base in f for f in kept.inputFiles())


def test_stream_picks_up_where_it_stopped(spark, tmp_path):
    landing, target, progress = (str(tmp_path / n) for n in ("landing", "target", "progress"))
    for turn, path in enumerate(["a.py", "b.py"]):
        batch = spark.createDataFrame([(path, "x # y\n"), ("dist/c.py", "z")], "path string, content string")
        batch.write.mode("append").parquet(landing)
        strip_arriving(spark, landing, target, progress).awaitTermination()
        rows = spark.read.parquet(target).select("path", F.col("language").cast("string"), "content").collect()
        assert sorted(map(tuple, rows)) == [(p, "python", "x\n") for p in ["a.py", "b.py"][: turn + 1]]
