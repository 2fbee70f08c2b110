"""Hunks: goldens, random texts, and taking all, none or some of them."""

import random
import time

from pyspark.sql import functions as F

from glossmill.operators.diff import _in_order, apply_hunks, changed_runs, hunks, matched


def applied(before, runs):
    out, at = [], 0
    for r in runs:
        out += [before[at : r["start"]], r["replacement"]]
        assert before[r["start"] : r["end"]] == r["removed"]
        at = r["end"]
    return "".join([*out, before[at:]])


def test_goldens():
    def brief(before, after):
        return [(r["before_line"], r["lines_removed"], r["after_line"], r["lines_added"]) for r in changed_runs(before, after)]

    assert brief("a\nb\nc\n", "a\nx\nc\n") == [(1, 1, 1, 1)]
    assert brief("a\nb\n", "n\na\nb\nm") == [(0, 0, 0, 1), (2, 0, 3, 1)]
    assert brief("a\nb", "a\nb\n") == [(1, 1, 1, 1)]
    assert brief("", "") == [] and brief("", "a") == [(0, 0, 0, 1)] and brief("a\n", "") == [(0, 1, 0, 0)]
    # A block that moved: the longer rest stays in place.
    assert brief("1\n2\n3\n4\n5\n", "4\n5\n1\n2\n3\n") == [(0, 0, 0, 2), (3, 2, 5, 0)]
    # Lines that stand twice are matched between those that stand once.
    assert brief("f(\n}\n\ng(\n}\n", "f(\n}\n\nh(\n}\n\ng(\n}\n") == [(3, 0, 3, 3)]


def test_sequences_in_order():
    rng = random.Random(1)
    for _ in range(300):
        places = rng.sample(range(12), rng.randrange(9))
        got = [places[i] for i in _in_order(places)]
        longest = [1] * len(places)
        for i, p in enumerate(places):
            longest[i] = 1 + max((longest[j] for j in range(i) if places[j] < p), default=0)
        assert got == sorted(got) and len(got) == max(longest, default=0)


def random_pairs(n):
    rng = random.Random(4)
    for _ in range(n):
        lines = [rng.choice(["a", "b", "", "}", f"u{rng.randrange(30)}", "\U0001f600é\r"]) for _ in range(rng.randrange(25))]
        other = [x for x in lines if rng.random() > 0.2]
        for _ in range(rng.randrange(4)):
            other.insert(rng.randrange(len(other) + 1), rng.choice(["a", "new", "}"]))
        if rng.random() < 0.3:
            cut = rng.randrange(len(other) + 1)
            other = other[cut:] + other[:cut]
        yield "\n".join(lines), "\n".join(other)


def test_random_texts():
    for before, after in random_pairs(2000):
        runs = changed_runs(before, after)
        assert applied(before, runs) == after
        pairs = matched(before.split("\n"), after.split("\n"))
        assert all(before.split("\n")[i] == after.split("\n")[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
        # Hunks are apart, and none is empty on both sides.
        assert all(r["removed"] or r["replacement"] for r in runs)
        assert all(x["end"] < y["start"] for x, y in zip(runs, runs[1:]))


def test_time_in_proportion():
    texts = {
        "once": ("".join(f"{i}\n" for i in range(100_000)), "".join(f"{i}\n" for i in range(100_000) if i % 7)),
        "same": ("x\n" * 100_000, "x\n" * 90_000 + "y\n"),
        "turned": ("".join(f"{i}\n" for i in range(100_000)), "".join(f"{i}\n" for i in range(100_000, 0, -1))),
        "two": ("a\nb\n" * 50_000, "b\na\n" * 50_000),
    }
    for before, after in texts.values():
        start = time.perf_counter()
        assert applied(before, changed_runs(before, after)) == after
        assert time.perf_counter() - start < 10


def test_taking_hunks(spark):
    pairs = [(str(i), *p) for i, p in enumerate(random_pairs(60))] + [("null", None, "a"), ("gone", "a", None)]
    df = spark.createDataFrame(pairs, "path string, before string, after string")
    found = hunks(df.withColumn("note", F.lit("n")), "note")
    assert found.columns == ["path", "note", "hunk", "before_line", "lines_removed", "after_line", "lines_added", "start", "end", "removed", "replacement"]
    files = df.where("before is not null and after is not null").select("path", F.col("before").alias("content"))
    whole = {p: (b, a) for p, b, a in pairs if b is not None and a is not None}
    everything = {r.path: r.content for r in apply_hunks(files, found).collect()}
    assert everything == {p: a for p, (_, a) in whole.items()}
    nothing = {r.path: r.content for r in apply_hunks(files, found, found.where("false")).collect()}
    assert nothing == {p: b for p, (b, _) in whole.items()}
    some = {r.path: (r.content, r.applied) for r in apply_hunks(files, found, found.where("hunk % 2 = 0").union(found.where("hunk = 0"))).collect()}
    assert some == {p: (applied(b, changed_runs(b, a)[::2]), True) for p, (b, a) in whole.items()}
