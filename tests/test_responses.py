"""Requests, model calls, assembling, results and the summary."""

import json

from pyspark.sql import functions as F

from glossmill.config import REQUESTS, RESPONSES, JobConfig
from glossmill.operators.requests import build_requests, resolve_model, system_prompt, write_requests
from glossmill.operators.responses import assemble, file_results, gather, generate, normalise_output
from glossmill.operators.summary import run_summary
from glossmill.plans.document import run_corpus
from glossmill.sources.tables import source_files
from glossmill.sources.workspace import keep


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "path string, chunk_index int, language string, text string, provider string")


def test_envelopes(spark, tmp_path):
    rows = [("p", i, "python", "x", name) for i, name in enumerate(["openai", "openrouter", "anthropic", "gemini", "?"])]
    built = build_requests(chunk_rows(spark, rows), JobConfig(), provider=F.col("provider"))
    assert built.dtypes == [(f.name, f.dataType.simpleString()) for f in REQUESTS]
    chat, router, anthropic, gemini, unknown = sorted(built.collect(), key=lambda r: r.chunk_index)
    assert [m.role for m in chat.messages] == [m.role for m in router.messages] == ["system", "user"]
    assert chat.system is None and chat.prompt is None and chat.messages[1].content == chat.user
    assert [m.role for m in anthropic.messages] == ["user"] and anthropic.system == chat.messages[0].content
    assert gemini.messages is None and gemini.prompt == anthropic.system + "\n\n" + gemini.user
    assert (chat.temperature, chat.max_tokens, gemini.temperature, gemini.max_tokens) == (0.2, 4096, None, None)
    assert unknown.model is None and unknown.messages is None and unknown.prompt is None
    write_requests(built, str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 5 and {x.get("max_tokens") for x in lines} == {4096, None}


def test_models(values):
    rows = [("gemini", ""), ("gemini", None), ("gemini", "m"), ("?", "")]
    got = values(rows, "p string, o string", resolve_model(F.col("p"), F.col("o")))
    assert got == ["gemini-2.5-flash-preview-05-20", "gemini-2.5-flash-preview-05-20", "m", None]


def test_prompt_parts(values):
    rows = [("python", "jsdoc"), ("python", "inline"), ("python", "both"), ("python", "?"), ("css", "both")]
    jsdoc, inline, both, unknown, css = (
        p.split("\n") for p in values(rows, "l string, s string", system_prompt(F.col("l"), F.col("s")))
    )
    assert len(jsdoc) == 6 and len({jsdoc[1], inline[1], both[1]}) == 3 and unknown == both
    assert "css" in css[0] and "css" in css[2] and css[3:] == jsdoc[3:]


def test_generate_isolates_failures(spark):
    rows = [("p", i, "c", f"code {i}", "openai" if i % 10 else "?") for i in range(100)]
    built = build_requests(chunk_rows(spark, rows), JobConfig(), provider=F.col("provider"))

    def answer(batch):
        out = []
        for user in batch["user"]:
            number = int(user.rsplit(" ", 1)[1])
            if number % 7 == 0:
                raise ValueError(f"no {number}")
            out.append(KeyError() if number % 11 == 0 else None if number % 13 == 0 else f"ok {number}")
        return out

    got = {r.chunk_index: (r.output, r.error) for r in generate(built.repartition(3), answer, 8).collect()}
    assert len(got) == 100
    for i, pair in got.items():
        if i % 10 == 0:
            assert pair == (None, "unknown provider: ?")
        elif i % 7 == 0:
            assert pair == (None, f"no {i}")
        elif i % 11 == 0:
            assert pair == (None, "KeyError")
        else:
            assert pair == (None if i % 13 == 0 else f"ok {i}", None)


def test_generate_refuses_a_short_answer_list(spark):
    built = build_requests(chunk_rows(spark, [("p", 0, "c", "x", "openai")]), JobConfig())
    assert generate(built, lambda batch: []).first().error == "0 answers to 1 requests"


def test_kept_responses_are_not_made_again(spark):
    calls = spark.sparkContext.accumulator(0)
    built = build_requests(chunk_rows(spark, [("p", i, "c", "x", "openai") for i in range(20)]), JobConfig())

    def answer(batch):
        calls.add(len(batch))
        return ["y"] * len(batch)

    kept = keep(generate(built, answer), "responses")
    assert [kept.count() for _ in range(3)] == [20, 20, 20]
    assert kept.where("output = 'y'").count() == 20 and calls.value == 20
    assert [f.dataType for f in kept.schema] == [f.dataType for f in RESPONSES]


def test_normalise(values):
    got = values([(" \n﻿x\t",), (None,), ("",)], "o string", normalise_output(F.col("o")))
    assert got == ["x", "", ""]


def response_rows(spark, rows):
    return spark.createDataFrame(rows, RESPONSES)


def test_file_results(spark):
    rows = [("a", 0, "x", None), ("a", 1, "y", None), ("b", 2, None, "late"), ("b", 1, None, "early"), ("b", 0, "x", None)]
    got = {r.path: (r.success, r.error) for r in file_results(response_rows(spark, rows)).collect()}
    assert got == {"a": (True, None), "b": (False, "early")}


LONG = "\n".join(["x"] * 3 + ["", "  class A"] + ["y"] * 3)


def assembled(spark, rows, contents, **config):
    files = source_files(spark.createDataFrame(contents, "path string, content string"))
    done = assemble(files, response_rows(spark, rows), JobConfig(min_lines=3, **config))
    return {r.path: r for r in done.collect()}


def test_assemble(spark):
    contents = [(f"{n}.c", LONG) for n in ("ok", "failed", "missing", "part", "extra", "short", "copy")] + [("blank.c", " \n")]
    rows = [
        ("ok.c", 1, "class A y y y y\n```", None), ("ok.c", 0, "```c\n// d\nx x x", None),
        ("failed.c", 0, None, "first"), ("failed.c", 1, None, "second"),
        ("part.c", 0, "x", None),
        ("extra.c", 0, "x", None), ("extra.c", 1, "x", None), ("extra.c", 2, "x", None),
        ("short.c", 0, "x", None), ("short.c", 1, None, None),
        ("copy.c", 0, LONG, None), ("copy.c", 0, LONG, None), ("copy.c", 1, LONG, None),
        ("stranger.c", 0, "x", None),
    ]
    got = assembled(spark, rows, contents)
    assert set(got) == {path for path, _ in contents}
    assert got["ok.c"][1:] == ("c", True, None, True, "// d\nx x x\nclass A y y y y")
    assert got["failed.c"][2:] == (False, "first", False, None)
    assert got["missing.c"][2:] == (False, "no response", False, None)
    assert got["part.c"][2:] == got["extra.c"][2:] == (False, "responses do not match the chunks", False, None)
    assert got["short.c"][2:] == (True, None, False, "x")
    assert got["copy.c"][2:] == (True, None, True, LONG + "\n" + LONG)
    assert got["blank.c"][2:] == (True, None, False, None)


def test_assemble_options(spark):
    contents = [("a.c", LONG + "\n")]
    rows = [("a.c", 0, "```\nx\n```", None), ("a.c", 1, "```\nclass A\n```\n", None)]
    plain = assembled(spark, rows, contents, guard_ratio=None)["a.c"]
    assert (plain.accepted, plain.output) == (True, "x\n```\n```\nclass A")
    per_chunk = assembled(spark, rows, contents, guard_ratio=None, per_chunk_fences=True)["a.c"]
    assert per_chunk.output == "x\nclass A"
    edged = assembled(spark, rows, contents, guard_ratio=None, per_chunk_fences=True, preserve_edges=True)["a.c"]
    assert edged.output == "x\n\n  class A\n"


def test_copies_of_one_response_stay_small(spark):
    """A third of all rows may be copies of one: they collapse before the shuffle."""
    copies = spark.range(200_000).select(
        F.lit("hot").alias("path"), F.lit(0).alias("chunk_index"), F.lit("x" * 50).alias("output"),
        F.lit(None).cast("string").alias("error"),
    )
    row = gather(copies).first()
    assert (row.path, len(row.answers)) == ("hot", 1)


def test_summary(spark):
    rows = [(f"p{i:02}", i < 3, None if i < 3 else f"e{i}") for i in range(10)]
    results = spark.createDataFrame(rows, "path string, success boolean, error string")
    got = run_summary(results).first()
    assert (got.processed, got.succeeded, got.failed) == (10, 3, 7)
    assert got.messages == [f"p{i:02}: e{i}" for i in range(3, 8)]
    assert run_summary(results, 1).first().messages == ["p03: e3"]
    none = run_summary(results.where("success")).first()
    assert (none.processed, none.failed, none.messages) == (3, 0, [])
    assert run_summary(results.where("false")).first().processed == 0


def test_whole_run(spark, tmp_path):
    contents = [("a.c", LONG), ("b.py", "x = 1\n"), ("dist/c.js", "y"), ("d.md", "z"), ("e.js", "\n"), ("f.ts", "boom")]
    files = spark.createDataFrame(contents, "path string, content string")

    def answer(batch):
        if any("boom" in user for user in batch["user"]):
            raise RuntimeError("down")
        return ["// note\n" + user.split("\n\n", 1)[1] for user in batch["user"]]

    got = run_corpus(files, answer, str(tmp_path / "out"), JobConfig(min_lines=3)).first()
    assert (got.processed, got.succeeded, got.failed, got.messages) == (4, 3, 1, ["f.ts: down"])
    written = {r.path: r.output for r in spark.read.parquet(str(tmp_path / "out" / "files")).collect()}
    assert written["b.py"] == "// note\nx = 1" and written["e.js"] is None
    review = {r.path: (r.lines_added, r.lines_removed) for r in spark.read.parquet(str(tmp_path / "out" / "review")).collect()}
    assert review == {"a.c": (2, 1), "b.py": (1, 1)}
    run_corpus(files, answer, str(tmp_path / "plain"), JobConfig(review=False))
    assert not (tmp_path / "plain" / "review").exists()
