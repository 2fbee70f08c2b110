"""Answers that are kept: what is asked, what is not asked again, what a run gets that was cut off."""

import json
import os

import pytest

from glossmill.config import JobConfig
from glossmill.operators import store as stores
from glossmill.operators.requests import build_requests
from glossmill.operators.store import ask, read_answers, request_key
from glossmill.plans.document import run_corpus

CHUNKS = "path string, chunk_index int, language string, text string"
ROWS = [("a.py", 0, "python", "x = 1"), ("a.py", 1, "python", "same"), ("b.py", 0, "python", "same"), ("c.js", 0, "javascript", "same"), ("d.py", 0, "python", "bad")]


def teller(folder):
    """A model that writes down what it is asked, and fails on some texts."""

    def answer(batch):
        import uuid

        texts = [u.split("\n\n", 1)[1] for u in batch["user"]]
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
            json.dump(texts, file)
        return [ValueError("failed") if t == "bad" else None if t == "empty" else f"// {t}" for t in texts]

    return answer


@pytest.fixture
def asked(tmp_path):
    """Asked texts since the last look, in order."""
    folder = tmp_path / "asked"
    folder.mkdir()

    def look():
        found = sorted(t for f in folder.iterdir() for t in json.loads(f.read_text()))
        for f in folder.iterdir():
            os.remove(f)
        return found

    look.folder = str(folder)
    return look


def requests_of(spark, rows, config=JobConfig()):
    return build_requests(spark.createDataFrame(rows, CHUNKS), config)


def outputs(df):
    return sorted((r.path, r.chunk_index, r.output, r.error) for r in df.collect())


def test_asked_once_and_not_again(spark, tmp_path, asked):
    answer, store = teller(asked.folder), str(tmp_path / "store")
    want = [("a.py", 0, "// x = 1", None), ("a.py", 1, "// same", None), ("b.py", 0, "// same", None), ("c.js", 0, "// same", None), ("d.py", 0, None, "failed")]
    # The language is part of what is sent, so the script is another request.
    first = ask(requests_of(spark, ROWS), answer, store, batch_size=1)
    assert asked() == ["bad", "same", "same", "x = 1"] and outputs(first) == want
    again = ask(requests_of(spark, ROWS + [("e.py", 7, "python", "same"), ("f.py", 0, "python", "new")]), answer, store, batch_size=1)
    assert asked() == ["bad", "new"]
    assert outputs(again) == want + [("e.py", 7, "// same", None), ("f.py", 0, "// new", None)]
    other = ask(requests_of(spark, ROWS[:1], JobConfig(provider="gemini")), answer, store)
    assert asked() == ["x = 1"] and outputs(other) == [("a.py", 0, "// x = 1", None)]


def test_rounds_keep_what_a_dead_run_paid_for(spark, tmp_path, asked):
    store, rows = str(tmp_path / "store"), [(f"p{i}.py", 0, "python", f"t{i}") for i in range(40)]
    told, turns = teller(asked.folder), str(tmp_path / "turns")
    os.mkdir(turns)

    def dies(batch):
        # From the third round on the process is gone; a batch's own failure would be an answer's error.
        if len(os.listdir(turns)) >= 20:
            raise KeyboardInterrupt
        for _ in range(len(batch)):
            import uuid

            open(f"{turns}/{uuid.uuid4().hex}", "w").close()
        return told(batch)

    with pytest.raises(Exception):
        ask(requests_of(spark, rows), dies, store, batch_size=4, partitions=1, round_requests=8)
    paid = {r.output for r in read_answers(spark, store).collect()}
    assert 0 < len(paid) < 40
    asked()
    done = ask(requests_of(spark, rows), told, store, batch_size=4, round_requests=8)
    assert {r.output for r in done.collect()} == {f"// t{i}" for i in range(40)}
    assert {f"// {t}" for t in asked()} == {f"// t{i}" for i in range(40)} - paid


def test_odd_requests(spark, tmp_path, asked):
    answer, store = teller(asked.folder), str(tmp_path / "store")
    assert ask(requests_of(spark, []), answer, store).count() == 0 and read_answers(spark, store).count() == 0
    rows = [("a.py", 0, "python", "empty"), ("a.py", 0, "python", "empty"), ("b.py", None, "python", "t"), (None, 0, "python", "t")]
    got = ask(requests_of(spark, rows), answer, store)
    assert sorted(map(str, ((r.path, r.chunk_index, r.output) for r in got.collect()))) == sorted(
        map(str, [("a.py", 0, ""), ("a.py", 0, ""), ("b.py", None, "// t"), (None, 0, "// t")])
    )
    assert asked() == ["empty", "t"]
    keys = requests_of(spark, ROWS).select(request_key(requests_of(spark, ROWS)).alias("k"))
    assert keys.distinct().count() == 4


def test_a_second_run_over_an_unchanged_corpus_makes_no_call(spark, tmp_path, asked):
    files = spark.createDataFrame([(f"d/f{i}.py", f"x = {i % 3}\n") for i in range(9)], "path string, content string")
    answer, store = teller(asked.folder), str(tmp_path / "store")
    first = run_corpus(files, answer, str(tmp_path / "one"), store=store).collect()
    assert len(asked()) == 3
    second = run_corpus(files, answer, str(tmp_path / "two"), store=store).collect()
    assert asked() == [] and first == second and first[0].succeeded == 9
    read = lambda name: sorted(map(tuple, spark.read.parquet(str(tmp_path / name / "files")).select("path", "output").collect()))
    assert read("one") == read("two") == [(f"d/f{i}.py", f"// x = {i % 3}") for i in range(9)]
    plain = run_corpus(files, answer, str(tmp_path / "three")).collect()
    assert plain == first and len(asked()) == 9


def test_a_round_shuffles_its_own_texts_only(spark, tmp_path, asked, monkeypatch):
    """Before its requests are dealt out, no round shuffles what the others ask."""
    plans, sizes, plain = [], [], stores.generate

    def seen(requests, *rest):
        plans.append(requests._jdf.queryExecution().executedPlan().toString())
        sizes.append(requests.count())
        return plain(requests, *rest)

    monkeypatch.setattr(stores, "generate", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(f"p{i}.py", 0, "python", f"t{i % 60}") for i in range(90)]
        done = ask(requests_of(spark, rows), teller(asked.folder), str(tmp_path / "store"), round_requests=20).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 3 and sizes == [20, 20, 20]
    assert not [p for p in plans if "SortMergeJoin" in p]
    assert sorted(r.output for r in done) == sorted(f"// t{i % 60}" for i in range(90)) and len(asked()) == 60
