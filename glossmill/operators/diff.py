"""Ordered changes between two texts, and taking some of them.

Lines that stand once in both texts are anchors; of these the longest sequence that
keeps its order on both sides is matched, and the stretches between are treated alike,
where other lines stand once. What is left unmatched, in runs, are the hunks. A hunk is
also a span of the text before with its replacement, so the hunks that somebody
approved are applied like any spans: all of them give the text after, none the text before.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.operators.edits import apply_spans

_HUNK = (
    "array<struct<before_line:int,lines_removed:int,after_line:int,lines_added:int,"
    "start:int,end:int,removed:string,replacement:string>>"
)


def _lines(text: str) -> list[str]:
    """Lines with their ends; joined they are the text."""
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def _in_order(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tops, ends, before = [], [], []
    for i, place in enumerate(places):
        at = bisect_left(tops, place)
        before.append(ends[at - 1] if at else -1)
        tops[at : at + 1], ends[at : at + 1] = [place], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _once(lines: list[str], low: int, high: int) -> dict[str, int]:
    """Lines that stand once in a stretch, with their places."""
    seen: dict[str, int] = {}
    for i in range(low, high):
        seen[lines[i]] = -1 if lines[i] in seen else i
    return {line: i for line, i in seen.items() if i >= 0}


def matched(before: list[str], after: list[str]) -> list[tuple[int, int]]:
    """Places of lines that stay, in order on both sides."""
    out, todo = [], [(0, len(before), 0, len(after))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and before[a] == after[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and before[b - 1] == after[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = _once(before, a, b), _once(after, c, d)
        both = [(i, theirs[line]) for line, i in ours.items() if line in theirs]
        anchors = [both[k] for k in _in_order([j for _, j in both])]
        out += anchors
        if anchors:
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


def changed_runs(before: str, after: str) -> list[dict]:
    """The hunks between two texts."""
    ours, theirs = _lines(before), _lines(after)
    out, i, j, at = [], 0, 0, 0
    for k, m in [*matched(ours, theirs), (len(ours), len(theirs))]:
        removed, added = "".join(ours[i:k]), "".join(theirs[j:m])
        if i < k or j < m:
            out.append(
                {
                    "before_line": i,
                    "lines_removed": k - i,
                    "after_line": j,
                    "lines_added": m - j,
                    "start": at,
                    "end": at + len(removed),
                    "removed": removed,
                    "replacement": added,
                }
            )
        if k < len(ours):
            at += len(removed) + len(ours[k])
        i, j = k + 1, m + 1
    return out


def changes(before: Column, after: Column) -> Column:
    """The hunks between two texts, an array; none between equal ones, null where either is null."""

    @F.arrow_udf(_HUNK)
    def hunks_of(ours, theirs):
        import pyarrow as pa

        numbers = ("before_line", "lines_removed", "after_line", "lines_added", "start", "end")
        kind = pa.list_(pa.struct([(n, pa.int32()) for n in numbers] + [("removed", pa.string()), ("replacement", pa.string())]))
        pairs = zip(ours.to_pylist(), theirs.to_pylist(), strict=True)
        return pa.array([None if a is None or b is None else changed_runs(a, b) for a, b in pairs], kind)

    differ = before != after
    found = hunks_of(F.when(differ, before), F.when(differ, after))
    return F.when(before == after, F.array().cast(_HUNK)).otherwise(found)


def hunks(pairs: DataFrame, *keep: str) -> DataFrame:
    """``(path, *keep, hunk, before_line, lines_removed, after_line, lines_added, start, end, removed, replacement)``.

    One row for each hunk of ``(path, before, after)`` rows; ``hunk`` counts them from 0 for each path. Lines
    count from 0, ``start`` and ``end`` are code points of ``before``. Works inside the row: no shuffle.
    """
    found = pairs.select("path", *keep, F.posexplode(changes(F.col("before"), F.col("after"))).alias("hunk", "change"))
    return found.select("path", *keep, "hunk", "change.*")


def apply_hunks(files: DataFrame, hunks: DataFrame, approvals: DataFrame | None = None) -> DataFrame:
    """``apply_spans`` with those hunks that ``approvals`` names by ``path`` and ``hunk``; without it, all of them.

    ``files`` are the texts before. Files without an approved hunk stay as they are.
    """
    chosen = hunks if approvals is None else hunks.join(approvals.select("path", "hunk").distinct(), ["path", "hunk"], "left_semi")
    return apply_spans(files, chosen.select("path", "start", "end", "replacement"))
