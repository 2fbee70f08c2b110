"""Edits by position. Offsets count code points, from 0, end exclusive."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.bitmaps import BITMAP_BITS, is_set

_BITS = 8
_BLOCK = 1 << _BITS
#: Paths are marked by their hash in so many bits, which are sent to every task: 16 MB, however many paths.
MARK_BITS = 1 << 27


def _marked(files: DataFrame, spans: DataFrame) -> DataFrame:
    """``(path, content, marked)``: files that have no spans are almost all not marked, those that have some all are."""
    slot = F.pmod(F.xxhash64("path"), F.lit(MARK_BITS))
    bucket, position = F.floor(slot / BITMAP_BITS).alias("bucket"), F.pmod(slot, F.lit(BITMAP_BITS))
    bitmaps = spans.groupBy(bucket).agg(F.bitmap_construct_agg(position).alias("bitmap"))
    placed = files.select("path", "content", bucket).join(F.broadcast(bitmaps), "bucket", "left")
    return placed.select("path", "content", F.coalesce(is_set(F.col("bitmap"), position), F.lit(False)).alias("marked"))


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s:.){{1,{_BLOCK}}}"), F.lit(0))


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end`` out of fixed-size blocks.

    ``substring`` counts characters from the start of its string, so cutting a
    long text many times would read it as often. A block is short.
    """
    first, last = F.shiftright(start, _BITS), F.shiftright(end, _BITS)
    offset = start.bitwiseAND(_BLOCK - 1) + 1
    head = F.substring(F.get(blocks, first), offset, end - start)
    across = F.concat(
        F.substring(F.get(blocks, first), offset, F.lit(_BLOCK)),
        F.array_join(F.slice(blocks, first + 2, last - first - 1), ""),
        F.substring(F.coalesce(F.get(blocks, last), F.lit("")), F.lit(1), end.bitwiseAND(_BLOCK - 1)),
    )
    return F.when(start == end, F.lit("")).when(first == last, head).otherwise(across)


def _gathered(batches: Iterator[Any]) -> Iterator[Any]:
    """Of each batch a row for each path: its different spans, as lists side by side."""
    import pyarrow as pa

    names = ["start", "end", "replacement"]
    for batch in batches:
        distinct = pa.Table.from_batches([batch]).group_by(["path", *names], use_threads=False).aggregate([])
        listed = distinct.group_by("path", use_threads=False).aggregate([(name, "list") for name in names])
        yield from listed.select(["path", *(f"{name}_list" for name in names)]).rename_columns(["path", *names]).to_batches()


def _spans_of(spans: DataFrame) -> DataFrame:
    """``(path, spans)``, a file's different spans in order.

    A file's spans mostly come one after the other. They are put together before the shuffle, in lists: a row for
    each of them would be sorted, and is several times as long as what it says.
    """
    plain = spans.select("path", "start", "end", F.coalesce("replacement", F.lit("")).alias("replacement"))
    kinds = dict(plain.dtypes)
    listed = plain.mapInArrow(_gathered, "path string, " + ", ".join(f"`{c}` array<{kinds[c]}>" for c in plain.columns[1:]))
    # Side by side they are shorter than structs, and are made into these after the shuffle.
    lists = F.collect_list(F.struct("start", "end", "replacement"))
    zipped = F.transform(lists, lambda part: F.arrays_zip(part["start"], part["end"], part["replacement"]))
    named = F.flatten(zipped).cast(f"array<struct<start:{kinds['start']},end:{kinds['end']},replacement:string>>")
    sorted_spans = listed.groupBy("path").agg(F.array_sort(named).alias("spans"))
    # The same span from several rows is one.
    first = F.filter("spans", lambda span, i: (i == 0) | ~span.eqNullSafe(F.get(F.col("spans"), i - 1)))
    return sorted_spans.withColumn("spans", first)


def apply_spans(
    files: DataFrame, spans: DataFrame, accept: Callable[[Column, Column], Column] | None = None, sparse: bool = False
) -> DataFrame:
    """``(path, content, n_spans, applied)``: every span replaced by its text.

    Equal spans are one edit, and a null replacement is an empty one. A file with
    spans that overlap, leave the text or have no start or end is not edited but marked ``applied = false``; one without
    spans stays as it is.
    ``accept`` judges a span by the text it covers and its replacement; a span it
    turns down is left out, but places are judged before, those of such spans too. Files are shuffled once. A group of spans is one
    file's, and its result one row.
    With ``sparse``, for spans in a few of many files, the result is the same, but
    files without spans are told apart before the shuffle and pass beside it;
    ``files`` is then read twice.
    """
    if sparse:
        marked = _marked(files, spans)
        untouched = marked.where("not marked").select("path", "content", F.lit(0).alias("n_spans"), F.lit(True).alias("applied"))
        return apply_spans(marked.where("marked"), spans, accept).unionByName(untouched)
    cut = (
        files.select("path", "content")
        .join(_spans_of(spans), "path", "left")
        .withColumn("size", F.length("content"))
        .withColumn("blocks", F.when(F.col("spans").isNotNull(), _blocks(F.col("content"))))
    )
    blocks = F.col("blocks")

    def after_last(span: Column, index: Column) -> Column:
        previous = F.coalesce(F.get(F.col("spans"), index - 1)["end"], F.lit(0))
        return F.struct(previous.alias("after"), span.alias("span"))

    def misplaced(edit: Column) -> Column:
        span = edit["span"]
        wrong = (span["start"] < edit["after"]) | (span["end"] < span["start"]) | (span["end"] > F.col("size"))
        return F.coalesce(wrong, F.lit(True))

    # Places come first: whether a span is wanted is asked only where all of a file's spans can be.
    cut = cut.withColumn("applied", F.coalesce(~F.exists(F.transform("spans", after_last), misplaced), F.lit(True)))
    if accept is not None:

        def taken(span: Column) -> Column:
            return accept(_between(blocks, span["start"], span["end"]), span["replacement"])

        cut = cut.withColumn("spans", F.when(F.col("applied"), F.filter("spans", taken)).otherwise(F.col("spans")))

    # Each span with the end of the one before it: the text between is kept.
    cut = cut.select(
        "path",
        "content",
        "size",
        "blocks",
        "applied",
        F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"),
        F.transform("spans", after_last).alias("edits"),
        F.coalesce(F.try_element_at("spans", F.lit(-1))["end"], F.lit(0)).alias("last"),
    )

    def piece(edit: Column) -> Column:
        span = edit["span"]
        return F.concat(_between(blocks, edit["after"], span["start"]), span["replacement"])

    edited = F.concat(
        F.array_join(F.transform("edits", piece), ""), _between(blocks, F.col("last"), F.col("size"))
    )
    return cut.select(
        "path",
        F.when(F.col("applied") & (F.col("n_spans") > 0), edited).otherwise(F.col("content")).alias("content"),
        "n_spans",
        "applied",
    )


def extract_selections(files: DataFrame, selections: DataFrame, *keep: str) -> DataFrame:
    """``(path, *keep, start, end, text)`` for every selection that is not empty.

    Only the selected text leaves the join.
    """
    picked = selections.where(F.col("end") > F.col("start"))
    return files.join(picked, "path").select(
        "path",
        *keep,
        "start",
        "end",
        F.substring("content", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"),
    )


def replace_selections(files: DataFrame, replacements: DataFrame) -> DataFrame:
    """``apply_spans`` with ``(path, start, end, text)`` rows."""
    return apply_spans(files, replacements.withColumnRenamed("text", "replacement"))
