r"""Text clean-up as column expressions.

Loops over a group are written possessively (``(?:...)*+``): the JVM's regex
engine recurses once per turn of a plain group loop and runs out of stack on a
long file, while a possessive loop is iterative. "Any character" is ``(?s:.)``
everywhere: the class of a set and its complement makes the threads of an
executor wait for each other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What JavaScript's trim() strips, as characters and as the inside
# of a regex class that the JVM and RE2 read alike.
JS_WS = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
JS_WS_CLASS = (
    r"\x{09}-\x{0D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)


def js_trim(text: Column) -> Column:
    return F.trim(text, F.lit(JS_WS))


def js_trim_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(JS_WS))


def is_blank(text: Column) -> Column:
    return js_trim(text) == F.lit("")


def decode_utf8(raw: Column) -> Column:
    """Bytes to text: malformed sequences become U+FFFD, a leading BOM goes."""
    text = F.make_valid_utf8(raw.cast("string"))
    return F.when(F.startswith(text, F.lit("\ufeff")), F.substring(text, F.lit(2), F.length(text))).otherwise(text)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, the unit JavaScript's ``length`` counts."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def normalise_blank_lines(text: Column, source: Column | None = None) -> Column:
    """Three or more line ends in a row become two; the end is trimmed to one.

    Most texts have no carriage return, and then a plain run of line feeds is the
    faster search. ``source`` is the column ``text`` was made from, if asking that
    one is cheaper.
    """
    returns = F.contains(text if source is None else source, F.lit("\r"))
    run = F.when(returns, F.lit(r"(?:\r?\n){3,}+")).otherwise(F.lit(r"\n{3,}+"))
    squeezed = F.regexp_replace(text, run, F.lit("\n\n"))
    return F.concat(js_trim_end(squeezed), F.lit("\n"))


def strip_code_fences(text: Column) -> Column:
    """Drop one opening fence at the start, one closing fence at the end, trim."""
    opened = F.regexp_replace(text, r"\A```\w*\n?", "")
    return js_trim(F.regexp_replace(opened, r"\n?```\z", ""))


def leading_space(text: Column) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - F.length(F.ltrim(text, F.lit(JS_WS))))


def trailing_space(text: Column) -> Column:
    """White space after the last other character; blank text has none."""
    kept = F.length(js_trim_end(text))
    return F.when(kept == 0, F.lit("")).otherwise(F.substring(text, kept + 1, F.length(text)))
