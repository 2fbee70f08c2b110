"""Bounds that hold at every size: samples, memories, a benchmark in parts; names of the caller's own."""

import random
from array import array
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glossmill.llm import bpe, decontaminate, html_text, quality_rules
from glossmill.llm.samples import by_least_hash
from tests.llm.test_llm import PATH

BODY = "<h1>Title of it</h1>" + "".join(f"<p>This is paragraph {i} of a page that has no content element.</p>" for i in range(6))
WRAPPED = [
    "<form action=x>%s</form>", "<div class='layout has-sidebar'>%s</div>", "<div id='page' class='nav-open'>%s</div>", "<div class='legal-news'>%s</div>",
    "<div class='navy'>%s</div>", "<div class='no-js cookies-accepted'>%s</div>", "<div class='post comments-open'>%s</div>", "<form><div class='menu'>%s</div></form>",
]
CHAPTERS = "share-price legal-history social-history banner-year related-work discussion copyright-law hidden-gems".split()
BESIDE = "share share-bar ad ads-box related related-posts comments comment-list newsletter cookie-notice social-share-buttons sidebar promo breadcrumbs".split()


def test_a_sample_is_as_large_as_it_was_asked_for(spark):
    rows = spark.range(5_000).select((F.col("id") % 4_000).alias("i")).withColumn("text", F.concat(F.lit("t"), "i")).withColumn("text", F.when(F.col("i") < 900, "hot").otherwise(F.col("text")))
    got = {r.text for r in by_least_hash(rows, "text", 50).collect()}
    assert len(got) == 50 == by_least_hash(rows.repartition(7), "text", 50).count()
    assert got == {r.text for r in by_least_hash(rows.repartition(7), "text", 50).collect()}
    assert by_least_hash(rows, "text", 10_000).count() == 3_101 and by_least_hash(rows.filter("false"), "text", 5).count() == 0


def test_samples_do_not_shrink_with_the_table(spark, monkeypatch):
    """However many rows there are said to be, the fits see their samples."""
    pages = spark.createDataFrame([(f"<body><nav><b>a</b></nav><article><p>Some words {i}.</p></article></body>",) for i in range(60)], "html string")
    texts = spark.createDataFrame([(" ".join(["!"] * 60 + [f"w{i}"]),) for i in range(60)], "text string")
    usual = html_text.fit(pages), [r.name for r in quality_rules.order(quality_rules.prepare(texts), quality_rules.rules())]
    monkeypatch.setattr(type(pages), "count", lambda self: 3_000_000_000)
    assert html_text.fit(pages) == usual[0] != html_text.Weights()
    assert quality_rules.order(quality_rules.prepare(texts), quality_rules.rules())[0].name in ("calls", "letters", "word_length", "same_words")


def test_rules_leave_a_column_of_the_caller_s_own(spark):
    df = spark.createDataFrame([("mine", "a b c " * 20), ("mine", None)], "text string, body string")
    got = quality_rules.judge(df, "body").collect()
    assert [r.text for r in got] == ["mine", "mine"] and sorted(r.n_words for r in got) == [0, 60]
    other = quality_rules.judge(df.withColumnRenamed("text", "note"), "body")
    assert "text" not in other.columns and [r.note for r in other.collect()] == ["mine", "mine"]


def test_long_runs_are_not_remembered():
    own = bpe.encoder(PATH)
    own.runs.clear()
    own.words.clear()
    rng = random.Random(1)
    for _ in range(30):
        own.encode("".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(4_000)) + " short " + "x" * 500)
    assert all(len(k) <= bpe.REMEMBERED_CHARS for k in [*own.runs, *own.words]) and "short" in own.runs


def test_wrappers_without_a_content_element():
    for wrapper in WRAPPED:
        page = f"<html><body><nav><a href=a>Home</a><a href=b>About</a></nav>{wrapper % BODY}<footer>Foot of it</footer></body></html>"
        text = html_text.extract(page, html_text.Weights())
        assert text.startswith("Title of it\n\nThis is paragraph 0") and text.endswith("content element.") and "Home" not in text and "Foot" not in text, wrapper


def test_names_inside_an_article():
    page = "<body><article><h1>T</h1><p>First words.</p><div class='%s'><p>Inner words here.</p></div><p>Last words.</p></article></body>"
    for name in CHAPTERS:
        assert html_text.extract(page % name, html_text.Weights()) == "T\n\nFirst words.\n\nInner words here.\n\nLast words.", name
    for name in BESIDE:
        assert html_text.extract(page % name, html_text.Weights()) == "T\n\nFirst words.\n\nLast words.", name


def test_a_benchmark_in_parts_and_one_in_common(spark):
    """An opening that all items share leads nowhere; parts find what the whole does."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    opening = "which of the following statements is true of"
    items = [(i, f"{opening} {' '.join(word() for _ in range(14))}") for i in range(150)] + [(150, None), (151, opening), (None, opening + " it all")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    texts = [items[7][1], f"{opening} nothing else", "clean words only here and there", None, "", f"x {items[3][1]} y {items[9][1]} z", opening.upper()]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)] + [(0, texts[0], "mine")], "doc_id bigint, text string, leaks string")
    of = lambda df: sorted((r.doc_id, sorted((str(x.item), x.matched_words) for x in r.leaks)) for r in df.collect())
    whole = of(decontaminate.leaks(docs, bench))
    assert whole == of(decontaminate.leaks(docs, bench, part_words=500))
    leaked = dict(whole)
    names = lambda i: {n for n, _ in leaked[i]}
    assert names(0) == {"7", "151", "None"} and names(1) == names(6) == {"151", "None"} and names(5) == {"3", "9", "151", "None"}
    assert leaked[2] == leaked[3] == leaked[4] == [] and len(whole) == len(texts) + 1
    every = decontaminate.Index(next(decontaminate.parts(bench)))
    assert any(len(own) > decontaminate.COMMON for own in every.owners.values())
    assert decontaminate.leaks(docs, bench.filter("false"), part_words=1).filter("size(leaks) > 0").count() == 0
    assert decontaminate.clean(docs, bench, part_words=500).count() == 3


def test_ids_are_packed_and_unpacked_at_any_width(monkeypatch):
    own = bpe.encoder(PATH)
    assert own.id_bytes == 2
    for width in (1, 2, 3, 4):
        monkeypatch.setattr(own, "id_bytes", width)
        most = min((1 << 8 * width) - 1, (1 << 31) - 1)
        for ids in ([], [0], [most], [0, 1, most, most // 2, 0, most - 1]):
            packed = own.pack(array("i", ids).tobytes())
            assert len(packed) == width * len(ids) and array("i", own.unpack(packed)).tolist() == ids


def test_long_texts_take_two_bytes_a_token_between_tasks(spark, monkeypatch):
    """Ids were shuffled twice and written once in four bytes, the decoded text beside them."""
    library, rng, plans, plain = Tokenizer.from_file(PATH), random.Random(4), [], bpe.keep
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=4_000)) for _ in range(8)] + ["".join(rng.choices("abcd", k=40_000))]
    rows = [(i, t) for i, t in enumerate([*texts, texts[0], texts[0], "short", None])]
    files = []

    def seen(df, *rest, **more):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan())
        kept = plain(df, *rest, **more)
        files.extend(kept.inputFiles())
        return kept

    def sizes(node):
        own = [node.metrics().apply("dataSize").value()] if node.nodeName() == "Exchange" else []
        children = node.children()
        return own + [size for k in range(children.size()) for size in sizes(children.apply(k))]

    monkeypatch.setattr(bpe, "keep", seen)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        coded = bpe.encode(spark.createDataFrame(rows, "doc_id int, text string"), PATH, decoded="decoded", leaf_chars=5_000)
        coded = coded.select("doc_id", "ids", "decoded")
        got = {r.doc_id: r for r in coded.collect()}
        plans.append(coded._jdf.queryExecution().executedPlan())
    finally:
        for name in conf:
            spark.conf.unset(name)
    for i, text in rows:
        assert got[i].ids == library.encode(text or "", add_special_tokens=False).ids
        assert got[i].decoded == library.decode(got[i].ids, skip_special_tokens=False)
    n = sum(len(got[i].ids) for i in range(len(texts)))
    to_texts, from_leaves = sizes(plans[0])[:2]
    assert 2 * n < to_texts < 2 * n + 20_000
    # The long word's 40,000 symbols are packed too.
    assert from_leaves < sum(len(t or "") for _, t in rows) + 40_000 + 20_000
    assert 2 * n < sum(sizes(plans[1])) < 2 * n + 20_000
    assert sum(Path(unquote(urlparse(f).path)).stat().st_size for f in files) < 2 * n + 20_000
