"""Lines, declarations, chunks: goldens and the plain definition."""

import random
import time

from pyspark.sql import functions as F

from glossmill.functions.lines import bounded_chunk_texts, chunk_texts, is_declaration
from glossmill.functions.text import JS_WS
from glossmill.operators.chunks import break_points, chunk_edges, chunks, file_lines, rejoin

S = f"[{JS_WS}]"
# Lines that declare something, and lines that only look like it.
DECLARING = ("class A", "  def f():", "int f (", "\tpublic a b(", "export default async function f()")
OTHER = ("", " ", "　\r", "x", "def", "function", "é\U0001f600", "class ", "const f = () => {")


def points(lines):
    """Indices of declaring lines after a blank one."""
    return [i for i, (before, line) in enumerate(zip(lines, lines[1:]), 1) if line in DECLARING and not before.strip(JS_WS)]


def starts(lines, n):
    """The next chunk starts at the least break point n lines on or more."""
    out, cuts = [0], points(lines) if len(lines) > n else []
    while (after := next((p for p in cuts if p >= out[-1] + n), None)) is not None:
        out.append(after)
    return out


def expected(text, n):
    lines = text.split("\n")
    edges = [*starts(lines, n), len(lines)]
    return [(a, b, "\n".join(lines[a:b])) for a, b in zip(edges, edges[1:])]


def run(spark, texts, n):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    rows = sorted(chunks(df, n).collect(), key=lambda r: (int(r.path), r.chunk_index))
    out = [[] for _ in texts]
    for r in rows:
        assert r.chunk_index == len(out[int(r.path)])
        out[int(r.path)].append((r.start_line, r.end_line, r.text))
    return out


def test_declarations(values):
    cases = {
        "export default async function f()": True,
        "async def f():": False,
        "std::string f(": False,
        "public static void main(": True,
        "publicx foo bar (": True,
        "public (": False,
        "publicfoo(": False,
        "static  foo  bar  ": False,
        "  \tdef f():": True,
        "def": False,
        "def ": False,
        "class A": True,
        "export class": False,
        "default class B {": True,
        "std:: f(": True,
        "Foo bar(": True,
        "foo bar(": False,
        "const f = () => {": False,
        "int main (": True,
        "functionx": False,
        "　function f": True,
        "": False,
    }
    assert values([(c,) for c in cases], "t string", is_declaration(F.col("t"))) == list(cases.values())


def test_lines(spark):
    df = spark.createDataFrame([("a", "x\r\n\ny\n")], "path string, content string")
    assert [tuple(r) for r in file_lines(df).orderBy("line_index").collect()] == [
        ("a", 0, "x\r"), ("a", 1, ""), ("a", 2, "y"), ("a", 3, "")
    ]


def test_cuts(spark):
    lines = ["x"] * 400
    for point in (10, 85, 90, 170, 300):
        lines[point - 1], lines[point] = " \t", "  class A"
    text = "\n".join(lines)
    assert [c[0] for c in run(spark, [text], 80)[0]] == [0, 85, 170, 300]
    plain = ["\n".join(["x"] * 80), "\n".join(["x"] * 81)]
    assert [len(c) for c in run(spark, plain, 80)] == [1, 1]


def random_texts(seed, count):
    rng = random.Random(seed)
    kinds = [*DECLARING, *OTHER]
    return ["\n".join(rng.choices(kinds, k=rng.randrange(1, 60))) for _ in range(count)]


def test_cuts_are_the_least_break_points(spark):
    texts = random_texts(1, 400) + ["", "\n", "\nclass A", "class A", " \nclass A\n", "\n\nint f (\n\nclass A"]
    for n in (1, 2, 7):
        assert run(spark, texts, n) == [expected(t, n) for t in texts]


def test_break_points(spark):
    texts = random_texts(2, 200)
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    got = [[] for _ in texts]
    for r in break_points(df).collect():
        got[int(r.path)].append(r.line_index)
    assert [sorted(g) for g in got] == [points(t.split("\n")) for t in texts]


def test_rejoin_and_minimum(spark):
    texts = random_texts(3, 200)
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    cut = chunks(df, 5)
    assert {r.path: r.content for r in rejoin(cut).collect()} == {str(i): t for i, t in enumerate(texts)}
    last = cut.groupBy("path").agg(F.max("chunk_index").alias("last"))
    short = cut.join(last, "path").where("chunk_index < last and end_line - start_line < 5")
    assert short.count() == 0


def test_one_very_long_file(spark):
    """Two million lines, over sixty thousand chunks, in one row."""
    start = time.time()
    df = spark.range(1).select(
        F.lit("big").alias("path"),
        F.repeat(F.lit("\nclass A\n" + "x\n" * 30), 62_500).alias("content"),
    )
    got = chunks(df, 30).agg(
        F.count("*").alias("n"), F.max("end_line").alias("lines"), F.sum(F.length("text")).alias("size")
    ).first()
    lines = 62_500 * 32 + 1
    assert (got.lines, got.n) == (lines, 62_500)
    assert got.size == 62_500 * (9 + 60) - (got.n - 1)
    assert time.time() - start < 60


def test_edges(spark):
    text = "  a\n\nclass B\n  b\n\n"
    df = spark.createDataFrame([("p", text)], "path string, content string")
    row = chunk_edges(df, 2, True).first()
    assert row.n_chunks == 2
    assert [tuple(e) for e in row.edges] == [("  ", "\n"), ("", "\n\n")]
    assert set(chunk_edges(df, 2, False).columns) == {"path", "content", "n_chunks"}


def test_copies_of_rows_rejoin_as_one(spark):
    rows = [("a", 0, "x"), ("a", 0, "x"), ("a", 1, "y"), ("a", 1, "z"), ("b", 1, None), ("b", 0, "")]
    got = rejoin(spark.createDataFrame(rows, "path string, chunk_index int, text string")).collect()
    assert sorted(tuple(r) for r in got) == [("a", "x\ny"), ("b", "\n")]


def fewest(pieces, limit, joint):
    """The least number of groups of neighbours within the limit; a piece above it is a group by itself."""
    best = [0] + [len(pieces) + 1] * len(pieces)
    for end in range(1, len(pieces) + 1):
        for start in range(end):
            if end - start == 1 or sum(pieces[start:end]) + joint * (end - start - 1) <= limit:
                best[end] = min(best[end], best[start] + 1)
    return best[-1]


def test_bounded_chunks_are_fewest(spark):
    rng = random.Random(8)
    texts = ["", "\n", "a", "\n\n\ndef f():"] + [
        "\n".join(rng.choices(["x", "", "def f(a):", "\n\ndef g(b):", "yy y", "\nclass A:"], k=rng.randrange(60))) for _ in range(150)
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    for limit in (1, 4, 15):
        for unit, joint in (("lines", 0), ("characters", 1)):
            rows = df.select("t", chunk_texts(t, 1).alias("pieces"), bounded_chunk_texts(t, limit, unit).alias("got")).collect()
            size = (lambda x: x.count("\n") + 1) if unit == "lines" else len
            for r in rows:
                assert "\n".join(r.got) == r.t
                assert len(r.got) == fewest([size(p) for p in r.pieces], limit, joint)
                assert all(size(c) <= limit or c in r.pieces for c in r.got)


def test_bounded_chunks_of_long_texts(spark):
    text = F.repeat(F.lit("x\n\ndef f():\n"), 100_000)
    start = time.perf_counter()
    got = spark.range(1).select(F.size(bounded_chunk_texts(text, 60)).alias("n")).first().n
    assert got == 5000 or got == 5001
    assert time.perf_counter() - start < 60


def test_chunks_within_a_limit_have_places(spark):
    text = "\n\ndef f():\n    a\n" * 9
    files = spark.createDataFrame([("p", text)], "path string, content string")
    got = sorted(chunks(files, 80, max_lines=7).collect(), key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in got] == list(range(len(got))) and "\n".join(r.text for r in got) == text
    lines = text.split("\n")
    assert all(r.text == "\n".join(lines[r.start_line : r.end_line]) and r.end_line - r.start_line <= 7 for r in got)
