"""Lines and chunks as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.lines import bounded_chunk_texts, chunk_texts, count_lines, split_lines
from glossmill.functions.text import leading_space, trailing_space

_BITS = 8


def file_lines(files: DataFrame) -> DataFrame:
    """``(path, line_index, line)``, one row per line."""
    return files.select("path", F.posexplode(split_lines(F.col("content"))).alias("line_index", "line"))


def _texts(min_lines: int, max_lines: int | None) -> Column:
    """A file's chunks: of ``min_lines`` at least or, if it is given, of ``max_lines`` at most."""
    content = F.col("content")
    return chunk_texts(content, min_lines) if max_lines is None else bounded_chunk_texts(content, max_lines)


def _with_texts(files: DataFrame, min_lines: int, max_lines: int | None) -> DataFrame:
    """Adds ``texts``, a file's chunks, and ``counts``, their numbers of lines.

    Works inside the row: no shuffle.
    """
    texts = files.withColumn("texts", _texts(min_lines, max_lines))
    return texts.withColumn("counts", F.transform("texts", count_lines))


def _total(values: Column, start: Column, length: Column) -> Column:
    return F.aggregate(F.slice(values, start + 1, length), F.lit(0), lambda acc, n: acc + n)


def chunks(files: DataFrame, min_lines: int, *keep: str, max_lines: int | None = None) -> DataFrame:
    """``(path, *keep, chunk_index, start_line, end_line, text)``.

    Chunks have ``min_lines`` lines at least, but for a file's last one, and no upper bound. With ``max_lines``
    there are as few as can be of that many lines at most; only a stretch without a break point is longer.

    Line numbers count from 0, ``end_line`` is exclusive. The texts of one file
    joined by a line end give back its content.
    """
    counts, blocks = F.col("counts"), F.col("blocks")
    # A chunk starts after all lines before it: whole blocks of chunks, then the
    # chunks of its own block. That is little work even in a file of thousands.
    numbered = _with_texts(files, min_lines, max_lines).withColumn(
        "blocks",
        F.transform(
            F.sequence(F.lit(0), F.shiftright(F.size(counts) - 1, _BITS)),
            lambda block: _total(counts, F.shiftleft(block, _BITS), F.lit(1 << _BITS)),
        ),
    )

    def piece(text: Column, index: Column) -> Column:
        block = F.shiftright(index, _BITS)
        inside = index.bitwiseAND((1 << _BITS) - 1)
        start = _total(blocks, F.lit(0), block) + _total(counts, F.shiftleft(block, _BITS), inside)
        return F.struct(
            index.alias("chunk_index"),
            start.alias("start_line"),
            F.get(counts, index).alias("lines"),
            text.alias("text"),
        )

    return numbered.select("path", *keep, F.inline(F.transform("texts", piece))).select(
        "path",
        *keep,
        "chunk_index",
        "start_line",
        (F.col("start_line") + F.col("lines")).alias("end_line"),
        "text",
    )


def break_points(files: DataFrame) -> DataFrame:
    """``(path, line_index)`` of every declaration line after a blank line: where
    chunks start if one line is enough for a chunk."""
    starts = chunks(files, 1).where("start_line > 0")
    return starts.select("path", F.col("start_line").alias("line_index"))


def chunk_edges(files: DataFrame, min_lines: int, edges: bool, max_lines: int | None = None) -> DataFrame:
    """Adds ``n_chunks`` and, if asked for, ``edges``: each chunk's own leading
    and trailing white space, which a model's trimmed answer has lost."""
    cut = files.withColumn("texts", _texts(min_lines, max_lines))
    cut = cut.withColumn("n_chunks", F.size("texts"))
    if edges:
        cut = cut.withColumn(
            "edges",
            F.transform(
                "texts",
                lambda text: F.struct(
                    leading_space(text).alias("lead"), trailing_space(text).alias("trail")
                ),
            ),
        )
    return cut.drop("texts")


def deal(pieces: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal chunk rows out one by one, so that the chunks of a very long file do
    not stay in one task. Before requests are built: they repeat the text."""
    spark = pieces.sparkSession
    # A number of its own: without one, adaptive execution puts small rows into a few tasks, but a call costs seconds.
    usual = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return pieces.repartition(partitions or usual, "path", "chunk_index")


def rejoin(pieces: DataFrame, column: str = "text") -> DataFrame:
    """``(path, content)`` from chunk rows, in order.

    A group is one file, and the result is that file's text in one row: what is
    gathered is never more than a row of the result holds. It is gathered as a set, so
    copies of a row are one; of several pieces of one chunk the least counts.
    """
    in_order = F.array_sort(F.collect_set(F.struct("chunk_index", F.coalesce(column, F.lit("")).alias("piece"))))
    gathered = pieces.groupBy("path").agg(in_order.alias("pieces"))

    def first_of_chunk(piece: Column, index: Column) -> Column:
        return (index == 0) | (F.get(F.col("pieces"), index - 1)["chunk_index"] != piece["chunk_index"])

    first = F.filter("pieces", first_of_chunk)
    return gathered.select("path", F.array_join(F.transform(first, lambda p: p["piece"]), "\n").alias("content"))
