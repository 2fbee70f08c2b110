"""Spans, selections, guard, line changes, audit."""

import random
from collections import Counter

from pyspark.sql import functions as F

from glossmill.config import RESPONSES, SELECTIONS, SPANS
from glossmill.operators.edits import apply_spans, extract_selections
from glossmill.operators.review import guarded, preservation_audit, review
from glossmill.plans.document import document_selections, selection_requests


def edit(spark, texts, spans):
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    rows = [(str(i), *s) for i, many in enumerate(spans) for s in many]
    made = spark.createDataFrame(rows, SPANS)
    got = apply_spans(files, made).collect()
    assert sorted(apply_spans(files, made, sparse=True).collect()) == sorted(got)
    return [tuple(r)[1:] for r in sorted(got, key=lambda r: int(r.path))]


def test_spans(spark):
    texts = ["abcdef", "abc", "abc", "abc", "abc", "", "a\U0001f600b", "abc", "abc", "abc", "abc", "abc"]
    spans = [
        [(4, 5, ""), (1, 2, "")],
        [],
        [(0, 2, "x"), (1, 3, "y")],
        [(2, 9, "x")],
        [(2, 1, "x")],
        [(0, 0, "new")],
        [(1, 2, "é")],
        [(0, 1, "x"), (0, 1, "x")],
        [(0, 3, ""), (3, 3, "end")],
        [(1, 2, None)],
        [(0, 1, "x"), (2, None, "y")],
        [(None, 1, "x")],
    ]
    assert edit(spark, texts, spans) == [
        ("acdf", 2, True),
        ("abc", 0, True),
        ("abc", 2, False),
        ("abc", 1, False),
        ("abc", 1, False),
        ("new", 1, True),
        ("aéb", 1, True),
        ("xbc", 1, True),
        ("end", 2, True),
        ("ac", 1, True),
        ("abc", 2, False),
        ("abc", 1, False),
    ]


def test_spans_match_plain_definition(spark):
    rng = random.Random(5)
    texts, spans, expected = [], [], []
    for _ in range(150):
        text = "".join(rng.choices("ab\n\U0001f600é", k=rng.choice([0, 5, 256, 512, 700, 3000])))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randrange(6))))
        many = [(a, b, rng.choice(["", "<>", "\n"])) for a, b in zip(cuts[::2], cuts[1::2])]
        out = text
        for a, b, by in sorted(many, reverse=True):
            out = out[:a] + by + out[b:]
        texts.append(text)
        spans.append(many)
        expected.append((out, len(many), True))
    assert edit(spark, texts, spans) == expected


def test_many_spans_in_one_long_text(spark):
    files = spark.range(1).select(F.lit("p").alias("path"), F.repeat(F.lit("0123456789"), 100_000).alias("content"))
    spans = spark.range(100_000).select(
        F.lit("p").alias("path"), (F.col("id") * 10).cast("int").alias("start"),
        (F.col("id") * 10 + 3).cast("int").alias("end"), F.lit("").alias("replacement"),
    )
    row = apply_spans(files, spans).first()
    assert row.content == "3456789" * 100_000 and row.n_spans == 100_000


def test_selections(spark):
    files = spark.createDataFrame([("a.py", "python", "0123456789")], "path string, language string, content string")
    chosen = spark.createDataFrame([("a.py", 2, 5), ("a.py", 7, 7), ("b.py", 0, 1)], SELECTIONS)
    assert [r.text for r in extract_selections(files, chosen).collect()] == ["234"]
    requests = selection_requests(files, chosen).collect()
    assert [(r.path, r.chunk_index) for r in requests] == [("a.py", 2)] and requests[0].user.endswith("\n\n234")


def test_document_selections(spark):
    names = ("ok", "short", "failed", "none")
    files = spark.createDataFrame([(n, "python", "0123456789") for n in names], "path string, language string, content string")
    chosen = spark.createDataFrame([(n, 0, 4) for n in names] + [("ok", 5, 8)], SELECTIONS)
    rows = [("ok", 0, "```\n# d\n0123\n```", None), ("ok", 5, "567 # e", None), ("short", 0, "01", None), ("failed", 0, None, "x")]
    got = {r.path: r.content for r in document_selections(files, chosen, spark.createDataFrame(rows, RESPONSES)).collect()}
    assert got == {"ok": "# d\n01234567 # e89", "short": "0123456789", "failed": "0123456789", "none": "0123456789"}


def test_guard(spark):
    rows = [("0123456789", "01234"), ("0123456789", "0123"), ("", ""), (" ", ""), ("0123456789", " 0123\n"), ("\U0001f600", "a")]
    df = spark.createDataFrame(rows, "before string, after string")
    assert [r.accepted for r in guarded(df, 0.5).collect()] == [True, False, True, True, False, True]
    assert [r.accepted for r in guarded(spark.createDataFrame([("0" * 10, "0" * 7), ("0" * 10, "0" * 6)], df.schema), 0.7).collect()] == [True, False]


def test_review(spark):
    rng = random.Random(9)
    rows = [("", ""), ("a", "a"), ("a\nb", "b\na"), ("a\na", "a")] + [
        ("\n".join(rng.choices("abc", k=rng.randrange(9))), "\n".join(rng.choices("abcd", k=rng.randrange(9)))) for _ in range(200)
    ]
    got = review(spark.createDataFrame(rows, "before string, after string")).collect()
    for r in got:
        before, after = Counter(r.before.split("\n")), Counter(r.after.split("\n"))
        assert (r.lines_added, r.lines_removed) == ((after - before).total(), (before - after).total())
        assert r.changed == (r.before != r.after)


def test_audit(spark):
    rows = [
        ("c", "a;\n\nb; // x\n", "/* doc */\na;\n// note\nb;\n"),
        ("c", "a;\nb;\n", "a;\nc;\n"),
        ("c", "a;\n\nb;\n", "a;\nb;\n"),
        ("python", "  x = 1  \n\n\n\ny", "# d\n  x = 1\n#\n#\ny # z"),
        ("python", "  x\n", " x\n"),
        ("c", "\n\na;\n", "// d\n\na;\n"),
        ("c", "a; \u00a0\t\u3000\n \u2028 \n  b;", "a;\n\n  b;\r\n"),
        ("c", "a;\u00a0b;", "a; b;"),
        ("python", "def f(a):\n    return a\n", 'def f(a):\n    """Return a."""\n    return a\n'),
        ("c", "a" + " " * 200_000 + "b" + "\u00a0" * 100_000 + "c", "x"),
    ]
    got = preservation_audit(spark.createDataFrame(rows, "language string, before string, after string")).collect()
    assert [(r.code_kept, r.lines_kept, r.preserved) for r in got] == [
        (True, True, True),
        (False, True, False),
        (True, False, False),
        (True, True, True),
        (False, True, False),
        (True, True, True),
        (True, True, True),
        (False, True, False),
        (True, True, True),
        (False, True, False),
    ]


def test_places_are_judged_before_spans_are_taken(spark):
    files = spark.createDataFrame([(str(i), "abcdef") for i in range(5)], "path string, content string")
    rows = [
        ("0", None, 1, "x"), ("0", 2, 3, "y"), ("1", 0, 1, "no"), ("1", 2, 3, "y"), ("2", 0, 3, "no"), ("2", 2, 4, "y"),
        ("3", 1, None, "no"), ("4", 0, 9, "no"),
    ]
    got = apply_spans(files, spark.createDataFrame(rows, SPANS), lambda before, after: after != "no").collect()
    assert sorted((r.path, r.content, r.n_spans, r.applied) for r in got) == [
        ("0", "abcdef", 2, False),
        ("1", "abydef", 1, True),
        ("2", "abcdef", 2, False),
        ("3", "abcdef", 1, False),
        ("4", "abcdef", 1, False),
    ]


def test_audit_fails_closed(spark):
    """What stripping might take for a comment or docstring must not hide a change."""
    rows = [
        ("python", 'x = {"a":\n """select 1"""\n}\n', 'x = {"a":\n """drop table t"""\n}\n', False),
        ("python", 'x = (a or\n"""b"""\n)\n', 'x = (a or\n"""c"""\n)\n', False),
        ("python", 'x = (1 if b else\n"""c""")\n', 'x = (1 if b else\n"""d""")\n', False),
        ("python", 'x = f"""a {b}"""\n', 'x = f"""a {c}"""\n', False),
        ("python", 'f(a,\n"b"\n)\n', 'f(a,\n"c"\n)\n', False),
        ("python", "def f(a,\n      b):\n    return a\n", 'def f(a,\n      b):\n    """Return a."""\n    return a\n', True),
        ("python", 'def f():\n    """Old."""\n', 'def f():\n    """New,\n    longer."""\n', True),
        ("python", 'def f():\n    """All there is."""\nx\n', "def f():\n# nothing\nx\n", False),
        ("javascript", r"if (ok) /\/\//.test(u); d();", r"if (ok) /\/\//.test(u); WRONG();", False),
        ("javascript", "<p>a // b</p>", "<p>a // </div>", False),
        ("javascript", "<p>a // b</p>", "// d\n<p>a // b</p> // e", True),
        ("typescript", "`${a /* b */} // c`", "`${a} // d`", False),
        ("css", "a { b: url(data:x;/*y*/) }", "a { b: url(data:x;/*z*/) }", False),
    ]
    # Columns of the caller's own stay.
    pairs = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "path string, language string, before string, after string, want boolean")
    got = preservation_audit(pairs).collect()
    assert [r.path for r in got if r.code_kept != r.want] == []


def test_audit_says_where(spark):
    rows = [
        ("c", "a;\nb;\nb;\n", "// n\na;\n\nb; // m\nx;\n", (2, "b;", "x;", 4)),
        ("c", "a;\nb;\n", "a;\n", (1, "b;", None, None)),
        ("c", "a;\n", "a;\n// n\nc; /* d */\n", (1, None, "c; /* d */"[:2], 2)),
        ("c", "a;\nb c;\n", "a;\nb /* n */ d;\n", (1, "b c;", "b  d;", None)),
        ("python", 's = """\nx\n"""\n', '# n\ns = """\ny\n"""\n', (1, "x", "y", 2)),
        ("python", "def f():\n    return 1\n", 'def f():\n    """Doc."""\n    return 2\n', (1, "    return 1", "    return 2", 2)),
        ("c", "", "x;", (0, "", "x;", 0)),
        ("c", "a;\n", "/* n */\na;\n", None),
    ]
    pairs = spark.createDataFrame([(str(i), *r[:3]) for i, r in enumerate(rows)], "path string, language string, before string, after string")
    got = preservation_audit(pairs, places=True).collect()
    assert {r.path: r.change and tuple(r.change) for r in got} == {str(i): r[3] for i, r in enumerate(rows)}


def test_spans_are_short_when_they_are_shuffled(spark):
    """Spans were sorted and shuffled as a struct each, of some 39 bytes in this case."""
    n, each = 300, 400
    files = spark.range(n, numPartitions=4).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.repeat(F.lit("x"), 10 * each + 9).alias("content"))
    spans = files.select("path", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("i"))
    spans = spans.select("path", (F.col("i") * 10).alias("start"), (F.col("i") * 10 + 3).cast("bigint").alias("end"), F.lit("<>").alias("replacement"))
    spans = spans.unionAll(spans.where("start = 0"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        done = apply_spans(files, spans)
        rows = done.collect()
        plan = done._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(rows) == n and {(r.content, r.n_spans, r.applied) for r in rows} == {("<>xxxxxxx" * each + "x" * 9, each, True)}

    def sizes(node):
        own = [node.metrics().apply("dataSize").value()] if node.nodeName() == "Exchange" else []
        children = node.children()
        return own + [size for k in range(children.size()) for size in sizes(children.apply(k))]

    shuffled = sum(sizes(plan)) - n * (10 * each + 9)
    assert 0 < shuffled < 30 * n * each
