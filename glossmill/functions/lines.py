"""Lines, declarations and the cuts between chunks, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions.text import JS_WS_CLASS

# White space within a line.
LINE_SPACE = "[" + JS_WS_CLASS.replace(r"\x{09}-\x{0D}", r"\x{09}\x{0B}-\x{0D}") + "]"
_S = LINE_SPACE

# Starts of lines that open a function, a method or a class. The
# modifier rule reads "words and spaces up to the parenthesis" one word after the
# other, so a line is read once however long it is.
DECLARATIONS = (
    rf"(?:export{_S}++)?(?:default{_S}++)?(?:async{_S}++)?function{_S}++[^\n]",
    rf"(?:export{_S}++)?(?:default{_S}++)?class{_S}++[^\n]",
    rf"def{_S}++[^\n]",
    rf"class{_S}++[^\n]",
    rf"(?:public|private|protected|static|abstract|final)\w*+(?:{_S}++\w++)++{_S}*+\(",
    rf"(?:void|int|bool|auto|std::|[A-Z]\w*+){_S}++\w++{_S}*+\(",
)
_DECLARATION = rf"{_S}*+(?:{'|'.join(DECLARATIONS)})"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def count_lines(text: Column) -> Column:
    return F.size(split_lines(text))


def is_declaration(line: Column) -> Column:
    """Whether a line opens a declaration; indented ones count."""
    return line.rlike(rf"\A{_DECLARATION}")


def chunk_texts(text: Column, min_lines: int) -> Column:
    """The text cut into chunks, an array; joined by a line end they are the text.

    Each cut is the least break point that leaves ``min_lines`` lines or more
    behind it, a break point being a declaration line after a blank line. So a
    chunk is that many lines but one, then lines up to a blank line before a
    declaration, or up to the end. Lines are taken one by one and none is taken
    back, so a long text costs neither stack nor a second look.
    """
    ahead = rf"{LINE_SPACE}*+\n{_DECLARATION}"
    chunk = (
        rf"(?:\A|(?!\z))((?:[^\n]*+\n){{0,{min_lines - 1}}}+(?:(?!{ahead})[^\n]*+\n)*+"
        rf"(?:{LINE_SPACE}*+(?=\n{_DECLARATION})|[^\n]*+\z))(?:\n|\z)"
    )
    return F.when(
        count_lines(text) > min_lines, F.regexp_extract_all(text, F.lit(chunk), F.lit(1))
    ).otherwise(F.array(text))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bounded_chunk_texts(text: Column, limit: int, unit: str = "lines") -> Column:
    """The text cut into as few chunks as can be, none of them above ``limit`` where a break point allows it.

    ``unit`` is ``lines`` or ``characters``. Cuts are at break points only, so a stretch without one is a chunk
    whatever its size. From each cut the next is the last break point within the limit, or else the first one
    there is; no other choice needs fewer chunks. Joined by a line end the chunks are the text.
    """
    if unit not in ("lines", "characters"):
        raise ValueError(f"unit must be 'lines' or 'characters', not {unit!r}")
    # Pieces are joined by a line end, which is a character and begins no line that was not counted.
    size, joint = (count_lines, 0) if unit == "lines" else (F.length, 1)

    def state(starts: Column, held: Column) -> Column:
        return F.struct(starts.alias("starts"), held.alias("held"))

    def step(acc: Column, piece: Column) -> Column:
        whole = acc["held"] + joint + piece["size"]
        fits = (whole <= limit) & (F.size(acc["starts"]) > 0)
        starting = state(F.concat(acc["starts"], F.array(piece["index"])), piece["size"])
        return F.when(fits, state(acc["starts"], whole)).otherwise(starting)

    def starts(pieces: Column) -> Column:
        sized = F.transform(pieces, lambda piece, index: F.struct(index.alias("index"), size(piece).alias("size")))
        return F.aggregate(sized, state(F.array().cast("array<int>"), F.lit(0)), step, lambda acc: acc["starts"])

    def texts(cut: Column) -> Column:
        def chunk(start: Column, index: Column) -> Column:
            end = F.coalesce(F.get(cut["starts"], index + 1), F.size(cut["pieces"]))
            return F.array_join(F.slice(cut["pieces"], start + 1, end - start), "\n")

        return F.transform(cut["starts"], chunk)

    def cut(pieces: Column) -> Column:
        return bound(F.struct(pieces.alias("pieces"), starts(pieces).alias("starts")), texts)

    return F.when(size(text) > limit, bound(chunk_texts(text, 1), cut)).otherwise(F.array(text))
