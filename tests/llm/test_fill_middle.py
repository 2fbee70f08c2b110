"""Fill-in-the-middle against plain Python, and the wavelet matrix against counting."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import database, duck_rows, spark_rows
from glossmill.llm import fill_middle, oracles, queries

SF = "/root/testdata/sf0.001"
SOUP = ["a", "b", " ", "  ", "\n", "é", "漢", "\U0001f600", "\t", "\r\n", "<", "P>", "x" * 70, "　"]


def units(text, unit):
    if unit == "char":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    starts = [m.start() for m in re.finditer(r"(?<![^\t-\r ])[^\t-\r ]", text)]
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]


def plain(doc_id, text, unit="char", seed=1):
    """The definition, one text at a time."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    parts = units(text, unit)
    n = len(parts)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    lead = len(text) - sum(map(len, parts))
    ends = np.cumsum([0, *map(len, parts)]) + lead
    cut = [0 if unit != "word" and k == 0 else int(ends[k]) for k in (a, b)]
    if unit == "word":
        cut = [0 if k == 0 else c for k, c in zip((a, b), cut)]
    prefix, middle, suffix = text[: cut[0]], text[cut[0] : cut[1]], text[cut[1] :]
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_ranks():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 63, 64, 65, 1000):
        values = rng.integers(0, 8, n)
        matrix, at = fill_middle.WaveletMatrix(values), np.arange(n + 1)
        for v in range(8):
            assert matrix.rank(v, at).tolist() == [int((values[:i] == v).sum()) for i in range(n + 1)]


@pytest.mark.parametrize("unit", sorted(fill_middle.UNITS))
def test_every_unit(spark, unit):
    rng = random.Random(unit)
    texts = [None, "", " ", "\n", "a", " a", "one two\nthree", "<P>", "<S", "a<M>b", "no space" * 50_000, "words of it\n" * 40_000]
    texts += ["".join(rng.choices(SOUP, k=rng.randrange(60))) for _ in range(300)]
    rows = [(i, t, "mine") for i, t in enumerate(texts)] + [(3, "\n", "mine"), (None, "words without an id", "mine"), (None, None, "mine")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, output string").withColumn("form", F.lit(1))
    got = fill_middle.fill_in_middle(df, unit=unit)
    assert got.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = got.withColumn("restored", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    want = sorted((str(d), str(t), *map(str, plain(d, t, unit))) for d, t, _ in rows)
    assert sorted(tuple(map(str, (r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output))) for r in got) == want
    assert all(r.restored == (r.text or "") for r in got)
    assert {r.form for r in got} == set(fill_middle.FORMS)
    assert fill_middle.fill_in_middle(df.filter("false"), unit=unit).count() == 0


def test_small_buffers(spark, monkeypatch):
    """A text longer than a buffer is cut alone."""
    texts = [b"one text", b"", "zwölf".encode() * 9, b"x"]
    draws = [np.array([5, 6, 7, 8]), np.array([3, 1, 4, 1]), np.array([1, 1, 1, 1]), np.array([50, 50, 50, 1])]
    whole = fill_middle._cut(texts, draws, "char")
    assert whole == [fill_middle._cut([t], [d[i : i + 1] for d in draws], "char")[0] for i, t in enumerate(texts)]


def test_unknown_unit():
    with pytest.raises(ValueError, match="unit must be"):
        fill_middle.transform(F.lit("a"), [F.lit(1)] * 4, "token")


def test_query_against_sql(spark):
    df = queries.op12_fill_in_middle(spark, SF)
    columns, want = duck_rows(database(SF), oracles.ORACLES["op12_fill_in_middle"])
    assert sorted(df.columns) == columns and spark_rows(df) == want
