"""Quality rules as a short-circuit cascade, in built-in functions only.

Each rule is a condition under which a text is rejected. On a sample each rule is
timed and its rejections are counted; rules then run in order of rejections per
second, and a text that one rule rejects is not shown to the next (a CASE stops at
the first branch that holds). The order decides the cost, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm.samples import by_least_hash
from glossmill.sources.workspace import keep

#: Texts on which costs are estimated: so many distinct ones, those whose hashes are least.
SAMPLE_ROWS = 2_000
#: Words of a window that must not come twice.
WINDOW = 8
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``fails``: the condition, over the prepared columns."""

    name: str
    fails: Column


def rules() -> list[Rule]:
    """What is rejected beside the base rules; texts of fewer than 20 words never come here.

    They look at the text, and at ``words`` and ``n_words`` as ``prepare`` adds them.
    """
    text, n = F.coalesce(F.col("text"), F.lit("")), F.greatest("n_words", F.lit(1))
    chars = F.greatest(F.length(F.array_join("words", "")), F.lit(1))
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    lines = F.size(F.split(text, "\n"))
    return [
        Rule("symbols", F.regexp_count(text, F.lit(_SYMBOLS)) > 0.1 * n),
        Rule("capitals", F.regexp_count(text, F.lit(r"\p{Lu}")) > 0.4 * letters),
        Rule("calls", F.regexp_count(text, F.lit("!")) > 0.1 * n),
        Rule("letters", letters < 0.6 * chars),
        Rule("word_length", (chars > 15 * n) | (chars < 2 * n)),
        Rule("same_words", _repeated_neighbours(F.col("words")) > 0.2 * n),
        Rule("same_lines", (lines >= 10) & (_repeated_lines(text) > 0.5 * lines)),
    ]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def _repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return F.size(lines) - F.size(F.array_distinct(lines))


def _repeated_neighbours(words: Column) -> Column:
    """Words that the next word equals."""
    alike = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.coalesce(a == b, F.lit(False)))
    return F.size(F.filter(alike, lambda same: same))


def prepare(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``text`` (a copy under that name), ``words`` and ``n_words``."""
    df = df if text == "text" else df.withColumn("text", F.col(text))
    return df.withColumn("words", _words(F.col("text"))).withColumn("n_words", F.size("words").cast("bigint"))


def _pairs(hashes: Column, step: int) -> Column:
    """Each hash with the one ``step`` further on."""
    shifted = F.slice(hashes, F.lit(step + 1), F.size(hashes))
    return F.zip_with(hashes, shifted, lambda a, b: F.xxhash64(a, b))


def with_repeats(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: the words that stand in an 8-word window which comes twice or more.

    Windows are hashed by doubling, words to 2, 4 and 8. Where no hash repeats the
    answer is 0; else hashes are sorted with their places, and neighbours with equal
    hashes are compared as words.
    """
    n = F.col("n_words").cast("int")
    df = df.withColumn("__h1", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("__h2", _pairs(F.col("__h1"), 1)).withColumn("__h4", _pairs(F.col("__h2"), 2))
    windows = F.when(n >= WINDOW, F.slice(_pairs(F.col("__h4"), 4), F.lit(1), F.greatest(n - WINDOW + 1, F.lit(0))))
    df = df.withColumn("__windows", F.coalesce(windows, F.array().cast("array<bigint>")))
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("__sorted", F.when(repeats, F.sort_array(placed)))

    def same(x: Column, at: Column) -> Column:
        other = F.try_element_at(F.col("__sorted"), at)
        window = lambda s: F.slice(F.col("words"), s["i"] + 1, F.lit(WINDOW))
        return F.coalesce((other["h"] == x["h"]) & (window(other) == window(x)), F.lit(False))

    # try_element_at counts from 1, and 0 is not allowed: -size - 1 is as far out as size + 1.
    before = lambda i: F.when(i == 0, F.lit(1 << 30)).otherwise(i)
    hits = F.transform("__sorted", lambda x, i: F.when(same(x, before(i)) | same(x, i + 2), x["i"]))
    df = df.withColumn("__places", F.sort_array(F.array_compact(hits)))
    steps = F.zip_with("__places", F.slice("__places", F.lit(2), F.size("__places")), lambda p, q: F.least(F.lit(WINDOW), F.coalesce(q - p, F.lit(WINDOW))))
    total = F.aggregate(steps, F.lit(0), lambda s, x: s + x)
    df = df.withColumn("n_repeat_words", F.when(F.size("__places") > 0, total).otherwise(0).cast("bigint"))
    return df.drop("__h1", "__h2", "__h4", "__windows", "__sorted", "__places")


def measures(df: DataFrame) -> DataFrame:
    """Add the base counts and ``base_failed`` to a prepared table."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = df.withColumn("word_chars", F.length(F.array_join("words", "")).cast("bigint"))
    df = df.withColumn("n_symbols", F.regexp_count(text, F.lit(_SYMBOLS)).cast("bigint"))
    df = with_repeats(df.withColumn("n_dup_lines", _repeated_lines(text).cast("bigint")))
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def order(df: DataFrame, candidates: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules of a prepared table by rejections per second on a sample, most first.

    Which rows are in the sample depends on their text alone. An empty table leaves
    the order as it is.
    """
    sample = keep(by_least_hash(df.select("text", "words", "n_words"), "text", sample_rows), "rules")
    if not sample.agg(F.count("*")).first()[0]:
        return list(candidates)

    def measured(*columns: Column) -> tuple[int, float]:
        start = time.perf_counter()
        found = sample.agg(F.count("*"), *columns).first()
        return found[-1], time.perf_counter() - start

    # The first time counts the start of things; the middle one of three more is a rule's.
    measured()
    base = median(measured()[1] for _ in range(3))
    rated = []
    for number, rule in enumerate(candidates):
        measured(F.count_if(rule.fails))
        runs = [measured(F.count_if(rule.fails)) for _ in range(3)]
        rated.append((-runs[0][0] / max(median(took for _, took in runs) - base, 0.001), number, rule))
    return [rule for _, _, rule in sorted(rated, key=lambda r: r[:2])]


def rejected_by(ordered: list[Rule]) -> Column:
    """The name of the first rule that rejects a text of a prepared table, or null."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(ordered):
        verdict = F.when(rule.fails, F.lit(rule.name)).otherwise(verdict)
    return verdict


def judge(df: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add the base counts, ``base_failed`` and ``kept``.

    Columns of these names are replaced, as are ``words`` and ``n_words``; a column ``text`` that is not the one
    asked for stays as it is. A null text counts as empty and fails by its length. Rows pass one by one: no shuffle.
    """
    others = text != "text"
    mine = others and "text" in df.columns
    prepared = prepare(df.withColumn("__mine", F.col("text")) if mine else df, text)
    ordered = order(prepared, rules(), sample_rows)
    judged = measures(prepared).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(rejected_by(ordered).isNull()))
    if mine:
        return judged.withColumn("text", F.col("__mine")).drop("__mine")
    return judged.drop("text") if others else judged
