"""Languages, skipped folders, order and counts."""

import pytest
from pyspark.sql import functions as F

from glossmill.config import JobConfig
from glossmill.functions.languages import EXTENSIONS, detect_language
from glossmill.operators.select import (
    glob_regex,
    in_skipped_folder,
    not_blank,
    ordered,
    plan_summary,
    select_files,
    supported,
)
from glossmill.sources.tables import source_files


def test_languages(values):
    cases = {
        "a/x.TSX": "typescript",
        "a/.js": None,
        ".js": None,
        "a/Makefile": None,
        "a/b.test.cjs": "javascript",
        "a/h.h": "cpp",
        "a.js/b": None,
        "x.": None,
        "a/..js": "javascript",
        "a/__init__.py": "python",
        "x.PY\n": None,
    }
    assert values([(c,) for c in cases], "p string", detect_language(F.col("p"))) == list(cases.values())
    assert len(EXTENSIONS) == 17


def test_language_id_wins_where_it_is_an_extension(values):
    rows = [("h.h", "c"), ("h.h", "javascript"), ("h.h", None), ("x", "css"), ("x", "python")]
    got = values(rows, "p string, i string", detect_language(F.col("p"), F.col("i")))
    assert got == ["c", "cpp", "cpp", "css", None]


def test_skipped_folders(values):
    paths = ["a/dist/b.js", "a/dist.js", "a/xdist/b.js", "dist/b.js", "a/.git/x.py", "a/xgit/x.py", "out", "a/out/b/c.js"]
    got = values([(p,) for p in paths], "p string", in_skipped_folder(F.col("p")))
    assert got == [True, False, False, True, True, False, False, True]
    assert values([("dist/a.js",)], "p string", in_skipped_folder(F.col("p"), ())) == [False]


@pytest.mark.parametrize(
    ("pattern", "path", "skipped"),
    [
        ("gen*", "a/generated/x.js", True),
        ("gen*", "a/gen/b/x.js", True),
        ("g?n", "gen/x.js", True),
        ("g?n", "g/n/x.js", False),
        ("{a,b*}", "bc/x.js", True),
        ("[ab]", "b/x.js", True),
        ("[!ab]", "b/x.js", False),
        ("src/gen", "r/src/gen/x.js", True),
        ("src/gen", "r/src/x/gen/x.js", False),
        ("src/**/gen", "r/src/x/y/gen/x.js", True),
        ("a.b", "axb/x.js", False),
        ("c++", "c++/x.cpp", True),
        ("[", "[/x.cpp", True),
    ],
)
def test_globs(values, pattern, path, skipped):
    assert values([(path,)], "p string", in_skipped_folder(F.col("p"), (pattern,))) == [skipped]
    assert glob_regex("*") == "[^/]*"


def test_selection(spark):
    paths = ["b.py", "a/dist/b.js", "x.md", "s.css", "a.h", "t.ts"]
    files = source_files(spark.createDataFrame([(p, "x") for p in paths], "path string, content string"))
    taken = {s: {r.path for r in select_files(files, s).collect()} for s in ("generate", "strip_corpus", "strip_file")}
    assert taken["generate"] == taken["strip_file"] == {"b.py", "s.css", "a.h", "t.ts"}
    assert taken["strip_corpus"] == {"b.py", "a.h", "t.ts"}
    assert files.where(supported(F.col("language"), "generate")).count() == 5
    summary = {r.language: r.files for r in plan_summary(select_files(files)).collect()}
    assert summary == {"python": 1, "css": 1, "cpp": 1, "typescript": 1, None: 4}


def test_order_and_limit(spark):
    paths = ["B", "b", "a", "A", "_x", "é", "e", "f", "a10", "a2"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in ordered(files).collect()] == ["_x", "a", "A", "a10", "a2", "b", "B", "e", "é", "f"]
    assert [r.path for r in ordered(files, 3).collect()] == ["_x", "a", "A"]


def test_blank_files(spark):
    files = spark.createDataFrame([("a", " \n﻿"), ("b", ""), ("c", " x ")], "path string, content string")
    assert [r.path for r in not_blank(files).collect()] == ["c"]


def test_raw_bytes_are_decoded(spark):
    files = spark.createDataFrame([("a.py", bytearray(b"\xef\xbb\xbfx\xff"))], "path string, raw binary")
    assert source_files(files).first().asDict() == {"path": "a.py", "content": "x�", "language": "python"}


def test_config_is_checked():
    with pytest.raises(ValueError):
        JobConfig(provider="other")
    with pytest.raises(ValueError):
        JobConfig(min_lines=0)
    with pytest.raises(ValueError):
        JobConfig(preserve_edges=True)
