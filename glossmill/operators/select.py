"""Which files a run takes, and in which order."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.config import SKIP_PATTERNS
from glossmill.functions.languages import SCOPES
from glossmill.functions.text import is_blank

_GLOB_TOKEN = re.compile(r"\*\*|\*|\?|\[!?[^\]]+\]|\{[^{}]*\}|[^*?\[{]+|.", re.DOTALL)


def glob_regex(pattern: str) -> str:
    """A folder pattern (``*``, ``**``, ``?``, ``[ab]``, ``{a,b}``) as a regex."""

    def convert(token: str) -> str:
        if token == "**":
            return ".*"
        if token == "*":
            return "[^/]*"
        if token == "?":
            return "[^/]"
        if len(token) > 2 and token[0] == "[":
            return "[" + token[1:-1].replace("!", "^", token[1] == "!").replace("\\", r"\\") + "]"
        if len(token) > 1 and token[0] == "{":
            return "(?:" + "|".join(glob_regex(part) for part in token[1:-1].split(",")) + ")"
        return re.escape(token)

    return "".join(convert(token) for token in _GLOB_TOKEN.findall(pattern))


def in_skipped_folder(path: Column, patterns: Iterable[str] = SKIP_PATTERNS) -> Column:
    """Whether any folder of the path equals, or matches, one of the patterns."""
    folders = "|".join(glob_regex(p.strip("/")) for p in patterns)
    return path.rlike(rf"(?:\A|/)(?:{folders})/") if folders else F.lit(False)


def supported(language: Column, scope: str) -> Column:
    return language.isin(*SCOPES[scope])


def select_files(
    files: DataFrame,
    scope: str = "generate",
    skip_patterns: Iterable[str] = SKIP_PATTERNS,
) -> DataFrame:
    """Files of a supported language outside the skipped folders."""
    return files.where(supported(F.col("language"), scope) & ~in_skipped_folder(F.col("path"), skip_patterns))


def ordered(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Files in the order a reader expects (letters before case), the first
    ``limit`` of them if given. Sorting comes first, so a limit is deterministic.
    """
    listing = files.orderBy(F.collate(F.col("path"), "UNICODE"), F.col("path"))
    return listing if limit is None else listing.limit(limit)


def not_blank(files: DataFrame) -> DataFrame:
    """Files with anything to send; a blank one needs no request and no write."""
    return files.where(~is_blank(F.col("content")))


def plan_summary(files: DataFrame) -> DataFrame:
    """Files per language a run would touch; the row without language is the total."""
    return files.rollup("language").agg(F.count("*").alias("files"))
