"""The licence scan's base columns against a plain search over all words, and against SQL."""

import random
import re


from checks.compare import database, duck_rows, spark_rows
from glossmill.llm import license_scan, queries

SF = "/root/testdata/sf0.001"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
BASE = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
p as (select * from (values (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) v(phrase, label)),
h as (select doc_id, label, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1 : i + len(phrase)] = phrase)) as place from w, p),
g as (select doc_id, count(*) as n, min(place) as first_word, max(place) as last_word, string_agg(distinct label, ',' order by label) as labels from h group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_base, first_word, last_word, coalesce(labels, '') as base_labels
from w left join g on w.doc_id = g.doc_id
"""


def plain(text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    hits = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.encode().split()]
    places = [i for i, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in hits}))


def test_base_columns_against_a_plain_search(spark, tmp_path):
    rng = random.Random(4)
    parts = ["GNU", "general", "Public", "license", "apache", "CC", "by", "MIT", "mit-license", " ", ", ", "\n", "é", "cc_by", "x1", "İ"]
    texts = [None, "", " ", "cc by cc by", "gnu general public license" * 2, "word " * 30_000 + "MIT License"]
    texts += [" ".join(rng.choices(parts, k=rng.randrange(20))) for _ in range(400)]
    rows = list(enumerate(texts)) + [(3, "cc by")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_license_scan(spark, str(tmp_path)).select(*BASE).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *plain(t))) for i, t in rows)


def test_base_columns_against_sql(spark):
    df = queries.op5_license_scan(spark, SF)
    columns, want = duck_rows(database(SF), SQL)
    assert sorted(BASE) == columns and spark_rows(df.select(*BASE)) == want


def test_labels_hold_the_base_ones(spark):
    rows = queries.op5_license_scan(spark, SF).collect()
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)
    assert len(license_scan.rules()) > 300
