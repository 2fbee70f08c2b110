"""Judging a change: length guard, line counts, code preservation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.comments import strip_comments, without_docstrings
from glossmill.functions.lines import LINE_SPACE, bound, count_lines, split_lines
from glossmill.functions.text import js_trim, utf16_length


def length_guard(source_length: Column, output_length: Column, ratio: float) -> Column:
    """Whether an output is long enough to be trusted; equality passes."""
    return output_length.cast("double") >= source_length.cast("double") * F.lit(float(ratio))


def long_enough(before: Column, after: Column, ratio: float) -> Column:
    """``length_guard`` on the trimmed lengths of two texts."""
    return length_guard(utf16_length(js_trim(before)), utf16_length(js_trim(after)), ratio)


def guarded(pairs: DataFrame, ratio: float) -> DataFrame:
    """Adds ``accepted`` to ``(before, after)`` rows."""
    return pairs.withColumn("accepted", long_enough(F.col("before"), F.col("after"), ratio))


def line_changes(before: Column, after: Column) -> Column:
    """``(lines_added, lines_removed)``, counting lines as a multiset.

    Both texts are in the row, so the lines are sorted and counted inside it: no
    line is shuffled, and a line that repeats everywhere makes no hot key. What is
    summed up is how far the counts of each line are apart, added and removed
    together; their difference is that of the numbers of lines.
    """

    def tagged(text: Column, weight: int) -> Column:
        return F.transform(
            split_lines(text), lambda line: F.struct(line.alias("line"), F.lit(weight).alias("weight"))
        )

    def state(line: Column, net: Column, apart: Column) -> Column:
        return F.struct(line.alias("line"), net.alias("net"), apart.alias("apart"))

    def step(acc: Column, item: Column) -> Column:
        return F.when(
            acc["line"] == item["line"], state(acc["line"], acc["net"] + item["weight"], acc["apart"])
        ).otherwise(state(item["line"], item["weight"], acc["apart"] + F.abs(acc["net"])))

    def finish(acc: Column) -> Column:
        apart, more = acc["apart"] + F.abs(acc["net"]), count_lines(after) - count_lines(before)
        half = lambda n: F.shiftright(n, 1)
        return F.struct(half(apart + more).alias("lines_added"), half(apart - more).alias("lines_removed"))

    zero = F.lit(0)
    lines = F.sort_array(F.concat(tagged(before, -1), tagged(after, 1)))
    counted = F.aggregate(lines, state(F.lit(None).cast("string"), zero, zero), step, finish)
    same = F.struct(zero.alias("lines_added"), zero.alias("lines_removed"))
    return F.when(before == after, same).otherwise(counted)


def review(pairs: DataFrame) -> DataFrame:
    """Adds ``lines_added``, ``lines_removed`` and ``changed`` to ``(before, after)`` rows."""
    counted = pairs.withColumn("changes", line_changes(F.col("before"), F.col("after")))
    return counted.select(
        *pairs.columns,
        F.col("changes.lines_added").alias("lines_added"),
        F.col("changes.lines_removed").alias("lines_removed"),
        (~F.col("before").eqNullSafe(F.col("after"))).alias("changed"),
    )


def _code_text(bare: Column) -> Column:
    """Text without blank lines and space at line ends.

    A run of spaces is looked at from its first one only, however long it is, and
    plain characters are passed over before anything else is asked of them. So are
    plain spaces before them: the class of all spaces is a slow one.
    """
    first = rf"(?<![ \t])(?![ \t]++[!-~])(?:(?<=[!-~])|(?<!{LINE_SPACE}))"
    line_ends = rf"(?![!-~]){first}(?:\n|(?![!-~]){LINE_SPACE}*+\n)++"
    return F.ltrim(F.regexp_replace(bare, line_ends, "\n"), F.lit("\n"))


def _first_change(before: Column, after: Column, text: Column) -> Column:
    """Where two code texts part: the number of the code line, the line on either side, and where it stands in ``text``."""

    def lines(code: Column) -> Column:
        return F.split(F.rtrim(code, F.lit("\n")), "\n", -1)

    def place(both: Column) -> Column:
        one, other = both["one"], both["other"]
        at = F.array_position(F.zip_with(one, other, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int") - 1
        return F.struct(at.alias("code_line"), F.get(one, at).alias("before"), F.get(other, at).alias("after"), other.alias("code"))

    def found(change: Column) -> Column:
        # Of the lines that hold this code, the one that as many came before as among the code lines.
        earlier = F.size(F.filter(F.slice(change["code"], F.lit(1), F.greatest(change["code_line"], F.lit(0))), lambda c: c == change["after"]))
        numbered = F.transform(split_lines(text), lambda line, i: F.struct(i.alias("i"), F.contains(line, change["after"]).alias("holds")))
        line = F.get(F.filter(numbered, lambda x: x["holds"]), earlier)["i"]
        return F.struct(change["code_line"].alias("code_line"), change["before"].alias("before"), change["after"].alias("after"), line.alias("line"))

    both = F.struct(lines(before).alias("one"), lines(after).alias("other"))
    return bound(both, lambda b: bound(place(b), found))


def _worked_out(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once for each row, however often they are used.

    Where two Python functions follow each other the optimizer puts the arguments of both into one step, and with
    them a copy of the text between them for every use. What comes out of a list it takes as it is.
    """
    return df.select("*", F.inline(F.array(F.struct(*(value.alias(name) for name, value in columns.items())))))


def preservation_audit(pairs: DataFrame, places: bool = False) -> DataFrame:
    """Adds ``code_kept``, ``lines_kept`` and their conjunction ``preserved`` to
    ``(language, before, after)`` rows: a documented text must hold the same code,
    comments, docstrings, blank lines and space at line ends apart, and at least as many lines.

    Equal texts are asked no more, others are compared without comments. Only python that
    still differs is compared without docstrings, which are statements by themselves and
    nothing else; a body that has nothing but one counts as not empty.

    With ``places`` there is also ``change``, null where the code was kept: ``code_line`` counts the lines that
    hold code, from 0, up to the first that differs; ``before`` and ``after`` are that line on either side, null
    where a side has ended; ``line`` is its place in the text after, null if a comment stood within it.
    """
    before, after, language = F.col("before"), F.col("after"), F.col("language")
    differ = before != after
    bare = _worked_out(
        pairs,
        __before=F.when(differ, strip_comments(before, language)),
        __after=F.when(differ, strip_comments(after, language)),
    )
    one, other = F.col("__before"), F.col("__after")
    judged = _worked_out(bare, __same=~differ | (one == other) | (_code_text(one) == _code_text(other)))
    # Python's code without docstrings is worked out only where the code with them differs.
    again = ~F.col("__same") & (language == "python")
    pure = _worked_out(
        judged,
        **{
            f"{c}_pure": without_docstrings(F.when(again, F.col(c)), F.lit("python"), hold=True)
            for c in ("__before", "__after")
        },
    )
    ours, theirs = F.col("__before_pure"), F.col("__after_pure")
    same = F.col("__same") | F.coalesce(_code_text(ours) == _code_text(theirs), F.lit(False))
    audited = _worked_out(pure, code_kept=same).withColumn("lines_kept", count_lines(after) >= count_lines(before))
    added = audited.withColumn("preserved", F.col("code_kept") & F.col("lines_kept"))
    helpers = ["__before", "__after", "__same", "__before_pure", "__after_pure"]
    if not places:
        return added.drop(*helpers)
    lost = ~F.col("code_kept")
    change = bound(
        F.struct(_code_text(F.coalesce(ours, one)).alias("one"), _code_text(F.coalesce(theirs, other)).alias("other")),
        lambda code: _first_change(code["one"], code["other"], after),
    )
    return added.withColumn("change", F.when(lost, change)).drop(*helpers)
