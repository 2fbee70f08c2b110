"""Stages and operators on nulls, empty and long texts, repeated rows, clashing names and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glossmill.llm import html_text, license_scan, quality_rules, secret_scan, simhash, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int"
LONG = "plain words of a long text " * 20_000
DOCS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "A calm note about gardens.", "en", "a", 26),
    (3, "A calm note about gardens.", "en", "a", 26),
    (4, "A calm note about gardens.", None, "b", 26),
    (5, LONG, "en", "a", len(LONG)),
    (None, "Another note, about rivers.", "en", "a", 27),
    (6, "x" * 50_000, "en", "a", 50_000),
]
CLASHING = ("ids", "decoded", "score", "fingerprint", "component_id", "leaks", "spans", "base_spans", "kept", "hash", "key", "node", "root", "label", "words")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(DOCS, SCHEMA)
    return rows.withColumns({name: F.lit("mine") for name in CLASHING})


def test_stages_on_odd_rows(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert all(r["ids"] == r["words"] == "mine" for r in rows), name
        if name == "near_duplicates":
            # Null and empty are alike, and so are the three copies.
            assert sorted((r.doc_id is None, r.doc_id) for r in rows) == [(False, 1), (False, 3), (False, 5), (False, 6), (True, None)]
        else:
            assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted((str(d[0]), str(d[1])) for d in DOCS), name
    coded = corpus_pipeline.tokens(spark, docs, SF).collect()
    assert len(coded) == len(DOCS) and {r.doc_id: r.n_tokens for r in coded if r.doc_id in (1, 2)} == {1: 0, 2: 0}


def test_stages_on_no_rows(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), SF).count() == 0, name


def test_operators_keep_rows_and_take_their_names(docs):
    assert simhash.near_duplicates(docs).count() == secret_scan.find(docs).count() == quality_rules.judge(docs).count() == len(DOCS)
    for df, n in ((docs, len(DOCS)), (docs.filter("false"), 0)):
        scored = df.select(toxicity.score(F.col("text"), toxicity.Model()).alias("s"), license_scan.scan(F.col("text")).alias("l"))
        assert scored.filter("s is not null and l.n_words is not null").count() == n


def test_pages_on_odd_rows(spark):
    page = "<body><nav>Home</nav><article><p>Some words of the article.</p></article></body>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "u", ""), (3, "u", "no markup at all"), (4, "u", "<p>" + "word " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("mine"))
    for df in (pages, pages.filter("false")):
        weights = html_text.fit(df)
        got = df.select("page_id", html_text.main_text(F.col("html"), weights).alias("main"), "text").collect()
        assert len(got) == df.count() and all(r.text == "mine" and r.main is not None for r in got)
    texts = {r.page_id: r.main for r in pages.select("page_id", html_text.main_text(F.col("html"), html_text.Weights()).alias("main")).collect()}
    assert texts[1] == "Some words of the article." and texts[2] == texts[None] == ""
    assert texts[4] == ("word " * 100_000).strip()
